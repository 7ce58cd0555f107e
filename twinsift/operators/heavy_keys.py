"""Per-key results when a few keys hold most rows (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.readings import digest, usable_mtime
from .versions import current_files


def combine_per_key(df: DataFrame, keys: list[str], **states: Column) -> DataFrame:
    """Per-key results by map-side combining.

    ``states`` are algebraic aggregates (``count``, ``sum``, ``min``, ``max``, and ``min``/``max`` of an ordered struct
    for an arg-min/arg-max): Spark keeps a bounded hash or sorted run of key states per input partition, spills it when
    memory ends, and shuffles only one partial state per key and partition. A key that holds half of all rows thus
    reaches its reducer as at most one small row per map task; no salting is needed and no task sees the raw group.
    """
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in states.items()])


def newest_per_content_key(files: DataFrame) -> DataFrame:
    """``(size, quick_hash, file_id)``: per key held by two or more files the file with the latest usable mtime.

    Sizes must be above 0 and ``quick_hash`` a digest (returned as 32 lower-case hex digits). Of equally new files the
    smallest ``file_id`` is taken; a key without any usable mtime has no row. Nulls in any column leave the row out of
    what it can't contribute to; an empty table gives an empty result; extra columns are ignored.
    """
    now = current_files(files, "size", "quick_hash", "mtime", "scanned_at")
    keyed = now.where(F.col("size") > 0).select("size", digest(F.col("quick_hash")).alias("quick_hash"), usable_mtime(F.col("mtime"), F.col("scanned_at")).alias("seen"), "file_id").where(F.col("quick_hash").isNotNull())
    newest = F.max(F.when(F.col("seen").isNotNull(), F.struct("seen", (-F.col("file_id")).alias("neg_id"))))
    merged = combine_per_key(keyed, ["size", "quick_hash"], files=F.count(F.lit(1)), newest=newest)
    return merged.where((F.col("files") >= 2) & F.col("newest").isNotNull()).select("size", "quick_hash", (-F.col("newest.neg_id")).alias("file_id"))


NEWEST_SQL = r"""
with cur as (
  select * from (select file_id, size, mtime, scanned_at, lower(replace(quick_hash, '-', '')) q,
    row_number() over (partition by file_id order by scanned_at desc) rn from file_records) where rn = 1 and size > 0),
dig as (select *, regexp_extract(q, '(^|[^0-9a-f])([0-9a-f]{32})($|[^0-9a-f])', 2) d from cur),
ok as (select size, d quick_hash, file_id, case when mtime > 0 and not isnan(mtime) and mtime <= epoch_us(scanned_at) / 1e6 then mtime end m
  from dig where d <> '' and d <> repeat(left(d, 1), 32)),
k as (select size, quick_hash, max(m) top from ok group by 1, 2 having count(*) >= 2)
select ok.size, ok.quick_hash, min(ok.file_id) file_id from ok join k on ok.size = k.size and ok.quick_hash = k.quick_hash and ok.m = k.top group by 1, 2
"""
