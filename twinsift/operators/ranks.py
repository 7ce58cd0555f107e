"""Places and predecessors inside groups of any size.

A window over a group sorts the whole group in one task. Here rows are range-partitioned by group and order, so that a
large group spreads over neighbouring partitions; windows then see one group's rows of one partition, and what crosses
the partitions' borders is one row per group and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import cut


def _partitioned(df: DataFrame, keys: list) -> DataFrame:
    """Written before use: the partition numbers must not change between the two times they are read."""
    return cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))


def place_within(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row inside its group, from 1 on. ``order`` should be total; groups may be null."""
    parts = _partitioned(df, [*by, *order])
    inside = parts.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    o = offsets.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), "_offset")
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return inside.join(o, same).select(*df.columns, (F.col("_at") + F.col("_offset")).cast("bigint").alias(name))


def previous(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the value of the row before in its group by ascending ``order``, null for the first. ``order`` should be total; keys are not null."""
    parts = _partitioned(df, [*by, *order])
    w = Window.partitionBy(*by, "_part").orderBy(*order)
    inside = parts.withColumn("_first", F.row_number().over(w) == 1).withColumn("_lag", F.lag(value).over(w))
    last = parts.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*[F.col(c).desc() for c in order]))).where(F.col("_r") == 1)
    edge = last.select(*by, "_part", value).withColumn("_border", F.lead("_part").over(Window.partitionBy(*by).orderBy("_part"))).where(F.col("_border").isNotNull())
    e = edge.select(*by, F.col("_border").alias("_part"), F.col(value).alias("_before"))
    return inside.join(e, [*by, "_part"], "left").select(*df.columns, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")).alias(name))
