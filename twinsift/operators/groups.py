"""Groups of files that belong together by equal keys, and what they cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.features import partial_digest, quick_digest
from .ranks import place_within


def keys_held_by_many(files: DataFrame, *keys: str) -> DataFrame:
    """``(keys, n_files, total_bytes, reclaimable_bytes)`` of the keys that two or more files hold; null keys hold nothing.

    Partial counts are merged map-side, so a key that holds most files costs one row per task.
    """
    have = files.dropna(subset=list(keys))
    agg = have.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"), F.max("size").alias("largest"))
    return agg.where(F.col("n_files") > 1).select(*keys, "n_files", "total_bytes", (F.col("total_bytes") - F.col("largest")).alias("reclaimable_bytes"))


def size_groups(files: DataFrame) -> DataFrame:
    return keys_held_by_many(files.where(F.col("size") > 0).withColumn("size_key", F.col("size")), "size_key").withColumnRenamed("size_key", "size").select("size", "n_files")


def hardlink_groups(files: DataFrame) -> DataFrame:
    """Files that share device and inode."""
    return keys_held_by_many(files.where(F.col("inode") > 0), "device", "inode")


def exact_groups(files: DataFrame, *digests: str) -> DataFrame:
    """Files of equal size and digests."""
    return keys_held_by_many(files.where(F.col("size") > 0).withColumn("size_key", F.col("size")), "size_key", *digests).withColumnRenamed("size_key", "size")


def without_members(files: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """The files that are in none of the groups (anti-join on the group keys)."""
    return files.join(groups.select(*keys), list(keys), "left_anti")


def with_count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with the number of rows that share its keys: map-side counts joined back, which AQE can split where a key is hot; a window would gather it."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)


def staged_digests(files: DataFrame) -> DataFrame:
    """``(path, size, quick, partial, full)``: a dearer digest only where the cheaper ones leave a file undecided.

    Stage 1: the first bytes, for files whose size is shared. Stage 2: head and tail, for large files whose size and quick
    digest are shared. Stage 3: the whole, for what is still shared. Small files' quick digest is their full one. Content
    is digested in the scan that reads it and doesn't travel; what is staged is which digests a file has.
    """
    small, large = F.col("size") <= K.QUICK_BYTES, F.col("size") > K.PARTIAL_ABOVE
    one = files.where(F.col("size") > 0).select("path", "size", quick_digest(F.col("content")).alias("quick"), F.when(large, partial_digest(F.col("content"))).alias("partial"), F.md5("content").alias("full"))
    a = with_count(one, ["size"], "n1").withColumn("quick", F.when(F.col("n1") > 1, F.col("quick")))
    b = with_count(a.withColumn("k2", F.coalesce("quick", F.lit(""))), ["size", "k2"], "n2").withColumn("many", F.col("quick").isNotNull() & (F.col("n2") > 1)).withColumn("partial", F.when(F.col("many"), F.col("partial")))
    c = with_count(b.withColumn("k3", F.coalesce("partial", F.lit(""))), ["size", "k3"], "n3").withColumn("more", F.col("many") & (~large | (F.col("n3") > 1)))
    return c.select("path", "size", "quick", "partial", F.when(small, F.col("quick")).when(F.col("more"), F.col("full")).alias("full"))


def group_totals(members: DataFrame) -> DataFrame:
    """Per group: members, bytes, and what would be freed if only the largest stayed (0 for a single member)."""
    size = F.coalesce("size", F.lit(0))
    g = members.groupBy("group_id", "group_type").agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("total_bytes"), F.max(size).alias("largest"))
    return g.select("group_id", "group_type", "n_files", "total_bytes", F.when(F.col("n_files") < 2, 0).otherwise(F.col("total_bytes") - F.col("largest")).cast("bigint").alias("reclaimable_bytes"))


def risk_levels(members: DataFrame) -> DataFrame:
    """LOW for links; HIGH for anything not exact; else MEDIUM with a locked member, HIGH with a system file, else LOW."""
    g = members.groupBy("group_id", "group_type").agg(F.bool_or("is_locked").alias("locked"), F.bool_or("is_system").alias("system"))
    level = F.when(F.col("group_type") == "hardlink", "LOW").when(F.coalesce(F.col("group_type") != "exact", F.lit(True)), "HIGH").when(F.col("locked"), "MEDIUM").when(F.col("system"), "HIGH").otherwise("LOW")
    return g.select("group_id", "group_type", level.alias("risk_level"))


def ranked(members: DataFrame) -> DataFrame:
    """Groups with their place in the report: exact and links first, then by score, ties by id.
    """
    g = members.groupBy("group_id", "group_type", "score").agg(F.count(F.lit(1)).alias("n_files"))
    exact = F.coalesce(F.col("group_type").isin("exact", "hardlink"), F.lit(False))
    order = [F.when(exact, 0).otherwise(1).asc(), F.col("score").desc_nulls_last(), F.col("group_id").asc()]
    return place_within(g.withColumn("all", F.lit(1)), ["all"], order, "place").select("place", "group_id", "group_type", "score", "n_files")


def neighbours(places: DataFrame) -> DataFrame:
    """``(group_id, previous_id, next_id)`` in report order, for stepping from group to group; null at the ends."""
    at = lambda n, step: places.select((F.col("place") + step).alias("place"), F.col("group_id").alias(n))
    return places.select("place", "group_id").join(at("previous_id", 1), "place", "left").join(at("next_id", -1), "place", "left").select("group_id", "previous_id", "next_id")


def verified(files: DataFrame) -> DataFrame:
    """``(path, first_path, verified)`` of files of equal size and ``hash``, each against the first of its group.

    With ``content`` a second, longer digest of all of it decides, so that no content travels; without it the
    ``sha256_hash`` does, and a missing one verifies nothing. Empty files and files without a hash are in no group.
    """
    proof = F.sha2("content", 512) if "content" in files.columns else F.col("sha256_hash")
    c = files.where((F.col("size") > 0) & F.col("hash").isNotNull()).select("path", "size", "hash", proof.alias("proof"))
    first = c.groupBy("size", "hash").agg(F.min(F.struct("path", "proof")).alias("f"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return c.join(first, ["size", "hash"]).select("path", F.col("f.path").alias("first_path"), F.coalesce(F.col("proof") == F.col("f.proof"), F.lit(False)).alias("verified"))
