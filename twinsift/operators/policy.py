"""Which member of a group stays, which may go, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.features import any_of, jaccard, name_tokens, phash_distance, stem
from ..functions.keep import is_copy_name, is_protected
from ..settings import Settings

MEDIA = ("Image", "Video", "Audio")


def keepers(members: DataFrame) -> DataFrame:
    """``(group_id, path, keep_score)``: per group the best score, ties to the oldest creation, then the smallest path.

    One ordered struct under ``min``, merged map-side, so huge groups cost one row per task.
    """
    high = F.lit(float("inf"))
    key = F.struct((-F.coalesce("keep_score", F.lit(-1))).alias("s"), F.coalesce("ctime", high).alias("c"), F.col("path").alias("path"), F.col("phash").alias("phash"))
    g = members.groupBy("group_id").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n_files"), F.max(F.coalesce(F.col("category").isin(*MEDIA), F.lit(False))).alias("media"))
    return g.select("group_id", F.col("k.path").alias("keeper"), (-F.col("k.s")).alias("best_score"), F.col("k.phash").alias("keeper_phash"), "n_files", "media")


def selected(members: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(group_id, path, gap, suggestion)`` by cleanup mode.

    Links stay. Locked files, system files and keepers stay. Exact copies go when they are worse than the keeper by the
    gap. Near copies are for review, unless the mode lets obvious copies go.
    """
    base = settings.delete_gap
    gap = max(5, base - 10) if settings.cleanup_mode == "AGGRESSIVE" else base
    media_gap = max(5, base - 5)
    m = members.join(keepers(members), "group_id").withColumn("gap", F.col("best_score") - F.coalesce("keep_score", F.lit(-1)))
    stay = F.col("is_locked") | F.col("is_system") | (F.col("path") == F.col("keeper"))
    copy = is_copy_name(stem(F.coalesce("name", F.lit(""))))
    if settings.cleanup_mode == "AGGRESSIVE":
        goes = (F.col("score") >= 90) & copy & (F.col("gap") >= gap)
    elif settings.cleanup_mode == "MEDIA-FOCUSED":
        seen = F.col("phash").isNotNull() & F.col("keeper_phash").isNotNull() & (phash_distance(F.col("phash"), F.col("keeper_phash")) <= 8)
        goes = F.col("media") & seen & copy & (F.col("gap") >= media_gap)
    else:
        goes = F.lit(False)
    exact_gap = F.when(F.col("media"), media_gap).otherwise(gap) if settings.cleanup_mode == "MEDIA-FOCUSED" else F.lit(gap)
    exact = F.when(F.col("gap") >= exact_gap, "DELETE").otherwise("KEEP")
    near = F.when(F.coalesce(goes, F.lit(False)), "DELETE").otherwise("REVIEW")
    word = F.when((F.col("n_files") < 2) | (F.col("group_type") == "hardlink") | stay, "KEEP").when(F.col("group_type") == "exact", exact).otherwise(near)
    return m.select("group_id", "path", "gap", word.alias("suggestion"))


def selected_basic(members: DataFrame, delete_gap: int = 15) -> DataFrame:
    """The simpler rule: of exact and linked groups all but the keeper go, of near groups those worse by the gap."""
    m = members.join(keepers(members), "group_id").withColumn("gap", F.col("best_score") - F.coalesce("keep_score", F.lit(-1)))
    goes = F.when(F.col("group_type").isin("exact", "hardlink"), True).otherwise(F.col("gap") >= delete_gap)
    return m.select("group_id", "path", F.when((F.col("path") != F.col("keeper")) & goes, "DELETE").otherwise("KEEP").alias("suggestion"))


def overridden(selection: DataFrame, overrides: DataFrame) -> DataFrame:
    """``selection`` with the marks of ``overrides (group_id, path, action)``: KEEP, DELETE, REVIEW or TOGGLE."""
    o = overrides.groupBy("group_id", "path").agg(F.max(F.upper("action")).alias("action"))
    toggled = F.when(F.col("suggestion") == "DELETE", "KEEP").otherwise("DELETE")
    return selection.join(o, ["group_id", "path"], "left").select("group_id", "path", F.when(F.col("action") == "TOGGLE", toggled).otherwise(F.coalesce("action", "suggestion")).alias("suggestion"))


def deletion_plan(members: DataFrame, selection: DataFrame) -> DataFrame:
    """``(group_id, path, size, allowed, reason)`` of every file marked DELETE. A plan: nothing is ever deleted here.

    Locked, system and symbolic-link files, members of link groups and of groups that are not exact are not allowed.
    """
    marked = selection.where(F.col("suggestion") == "DELETE").select("group_id", "path")
    reason = F.when(F.col("group_type") == "hardlink", "hard links share their content").when(F.coalesce(F.col("group_type") != "exact", F.lit(True)), "not an exact copy").when(F.col("is_locked"), "locked").when(F.col("is_system"), "system file").when(F.col("is_symlink"), "symbolic link")
    m = members.select("group_id", "path", "size", "group_type", "is_locked", "is_system", "is_symlink").join(marked, ["group_id", "path"])
    return m.select("group_id", "path", "size", reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def after_deletion(members: DataFrame, plan: DataFrame) -> DataFrame:
    """Groups of at least two members once the allowed deletions are done: ``(group_id, n_files)``."""
    left = members.select("group_id", "path").join(plan.where("allowed").select("group_id", "path"), ["group_id", "path"], "left_anti")
    return left.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") > 1)


def _first_pattern(name_stem: Column) -> Column:
    s = F.lower(name_stem)
    return F.coalesce(*[F.when(s.contains(p), F.lit(p.strip())) for p in K.COPY_PATTERNS])


def why_keep(members: DataFrame, needed_folders: DataFrame, scores: DataFrame) -> DataFrame:
    """``(group_id, path, why)``: up to three reasons for a member's mark, in a fixed order.

    ``needed_folders (parent)`` are folders with files of installed software; ``scores (path, path_score)`` path scores.
    Name similarity looks at the first five other members by place.
    """
    m = members.withColumn("tokens", name_tokens(F.coalesce("name", F.lit(""))))
    first = Window.partitionBy("group_id").orderBy("idx", "path")
    six = m.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 6).select("group_id", F.col("_n").alias("at"), F.col("path").alias("other"), F.col("tokens").alias("other_tokens"))
    few = six.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("at", "other", "other_tokens"))).alias("few"))
    rows = m.join(few, "group_id").join(needed_folders.select("parent", F.lit(True).alias("needed")), "parent", "left").join(scores.select("path", "path_score"), "path", "left")
    others = F.slice(F.filter("few", lambda o: o.other != F.col("path")), 1, 5)
    best = F.get(F.filter(F.transform(others, lambda o: jaccard(F.col("tokens"), o.other_tokens)), lambda s: s > 0.5), F.lit(0))
    pattern = _first_pattern(stem(F.coalesce("name", F.lit(""))))
    protected = is_protected(F.col("path"))
    reasons = F.array_compact(F.array(
        F.when(pattern.isNotNull(), F.concat(F.lit("name contains '"), pattern, F.lit("'"))),
        F.when(F.col("is_locked"), F.lit("in use")),
        F.when(F.col("is_system"), F.lit("system file")),
        F.when(protected, F.lit("folder of installed software")).when(F.coalesce("needed", F.lit(False)), F.lit("folder with program files")),
        F.when(F.col("path_score") < 0, F.lit("poor location")).when(F.col("path_score") > 0, F.lit("good location")),
        F.when(best.isNotNull(), F.concat(F.lit("name agrees by "), F.round(100 * best).cast("bigint").cast("string"), F.lit(" %"))),
    ))
    return rows.select("group_id", "path", F.when(F.size(reasons) > 0, F.concat_ws("; ", F.slice(reasons, 1, 3))).otherwise("by score").alias("why"))
