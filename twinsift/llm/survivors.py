"""Problem 1: the best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.readings import clean_path, usable_mtime, usable_score
from ..operators.versions import latest

#: Trust of a suggestion, best first; anything else (missing, blank, unknown words) stands between REVIEW and DELETE.
TRUST = {"KEEP": 0, "REVIEW": 1, "DELETE": 3}
NO_SUGGESTION = 2


def saved_groups(groups: DataFrame) -> DataFrame:
    """``(group_id, files, marks)``: of each group the row with the latest ``saved_at``; ``marks`` are the suggestions as sorted entries."""
    marks = F.array_sort(F.map_entries("suggestions"))
    return latest(groups.select("group_id", "saved_at", "files", marks.alias("marks")), "group_id", "saved_at", ["group_id", "files", "marks"])


def group_members(groups: DataFrame) -> DataFrame:
    """``(group_id, path, trust)``: the distinct paths of each group's current row, each at its first index.

    Null and blank paths and null or empty lists give no member. Lists and suggestions are exploded once each and meet
    again on (group, index): linear in their lengths, and no key of these shuffles is hot even if one list is huge.
    """
    now = saved_groups(groups)
    listed = now.select("group_id", F.posexplode("files").alias("idx", "path")).select("group_id", "idx", clean_path(F.col("path")).alias("path")).where(F.col("path").isNotNull())
    first = listed.groupBy("group_id", "path").agg(F.min("idx").alias("idx"))
    words = now.select("group_id", F.explode("marks").alias("m")).select("group_id", F.col("m.key").alias("idx"), F.upper(F.btrim(F.col("m.value"), F.lit(" \t"))).alias("word"))
    trust = F.coalesce(*[F.when(F.col("word") == w, F.lit(t)) for w, t in TRUST.items()], F.lit(NO_SUGGESTION))
    return first.join(words, ["group_id", "idx"], "left").select("group_id", "path", trust.alias("trust"))


def surviving_fields(groups: DataFrame, files: DataFrame) -> DataFrame:
    """``(group_id, field_name, file_id)``: which member each field of the surviving record is taken from.

    Members are the distinct listed files that ``file_records`` knows, in the order suggestion (KEEP, REVIEW, none,
    DELETE), highest usable keep_score, latest usable mtime, smallest path. ``path`` comes from the first member,
    ``keep_score`` and ``mtime`` from the member with the highest score and the latest time, ``category`` from the first
    member with a category other than null, blank or "unknown". Groups with fewer than two members, and fields that no
    member can fill, have no row.

    Every member becomes one row per field it can fill, with that field's order as sort columns; a single window per
    (group, field) ranks them. Only ranks 1 and 2 are kept, which Spark turns into a group limit *before* the shuffle:
    a task sends at most two rows of a group and field, so a group that holds a third of all members stays small.
    Rank 2 of ``path`` tells the groups of two or more members.
    """
    members = group_members(groups)
    known = latest(files.select(clean_path(F.col("path")).alias("path"), "file_id", "keep_score", "mtime", "category", "scanned_at"), "path", "scanned_at", ["path", "file_id", "keep_score", "mtime", "category", "scanned_at"])
    category = F.lower(F.btrim(F.col("category"), F.lit(" \t")))
    known = known.select("path", "file_id", usable_score(F.col("keep_score")).cast("double").alias("score"), usable_mtime(F.col("mtime"), F.col("scanned_at")).alias("seen"), ((category != "") & (category != "unknown")).alias("named"))
    rows = members.join(known, "path").select(
        "group_id", "file_id", "path", "trust",
        F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("o_score"), F.coalesce(-F.col("seen"), F.lit(float("inf"))).alias("o_seen"),
        F.explode(F.filter(F.array(
            F.struct(F.lit("path").alias("field_name"), F.lit(0.0).alias("lead"), F.lit(True).alias("fits")),
            F.struct(F.lit("keep_score").alias("field_name"), (-F.col("score")).alias("lead"), F.col("score").isNotNull().alias("fits")),
            F.struct(F.lit("mtime").alias("field_name"), (-F.col("seen")).alias("lead"), F.col("seen").isNotNull().alias("fits")),
            F.struct(F.lit("category").alias("field_name"), F.lit(0.0).alias("lead"), F.coalesce("named", F.lit(False)).alias("fits")),
        ), lambda f: f.fits)).alias("f"),
    ).select("*", "f.field_name", "f.lead")
    order = Window.partitionBy("group_id", "field_name").orderBy("lead", "trust", "o_score", "o_seen", "path")
    top = rows.select("group_id", "field_name", "file_id", "lead", "trust", "o_score", "o_seen", "path").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2)
    second = F.max(F.when(F.col("field_name") == "path", F.col("rank"))).over(Window.partitionBy("group_id"))
    return top.select("group_id", "field_name", "file_id", "rank", second.alias("members")).where((F.col("members") >= 2) & (F.col("rank") == 1)).select("group_id", "field_name", "file_id")


SURVIVORS_SQL = r"""
with g as (select * from (select *, row_number() over (partition by group_id order by saved_at desc) rn from dup_groups) where rn = 1),
l as (select group_id, suggestions, unnest(files) f, generate_subscripts(files, 1) - 1 i from g),
p as (select group_id, any_value(suggestions) s, trim(f, ' ' || chr(9)) path, min(i) i from l where trim(f, ' ' || chr(9)) <> '' group by group_id, trim(f, ' ' || chr(9))),
cur as (select * from (select *, row_number() over (partition by file_id order by scanned_at desc) rn from file_records) where rn = 1),
m as (select p.group_id, c.file_id, p.path,
    case upper(trim(p.s[p.i::int], ' ' || chr(9))) when 'KEEP' then 0 when 'REVIEW' then 1 when 'DELETE' then 3 else 2 end tr,
    case when keep_score between 0 and 200 then keep_score end ks,
    case when mtime > 0 and not isnan(mtime) and mtime <= epoch_us(scanned_at) / 1e6 then mtime end mt,
    lower(trim(category, ' ' || chr(9))) cat
  from p join cur c on p.path = trim(c.path, ' ' || chr(9))),
n as (select *, count(*) over (partition by group_id) c, row_number() over (partition by group_id order by tr, ks desc nulls last, mt desc nulls last, path) o from m),
k as (select * from n where c >= 2)
select group_id, 'path' field_name, arg_min(file_id, o) file_id from k group by 1
union all select group_id, 'keep_score', file_id from (select *, row_number() over (partition by group_id order by ks desc, o) r from k where ks is not null) where r = 1
union all select group_id, 'mtime', file_id from (select *, row_number() over (partition by group_id order by mt desc, o) r from k where mt is not null) where r = 1
union all select group_id, 'category', file_id from (select *, row_number() over (partition by group_id order by o) r from k where cat <> '' and cat <> 'unknown') where r = 1
"""
