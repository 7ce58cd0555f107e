"""Which row of a repeatedly delivered record counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, version: str, columns: Sequence[str]) -> DataFrame:
    """One row per ``key``: the one with the largest ``version``.

    The whole row travels as one ordered struct under ``max``, so each task first merges its own rows and a key that
    holds most of the table costs one partial state per task, not one huge window partition. Rows that tie on ``version``
    are decided by their remaining columns in the given order; null versions lose; rows without a key are left out.
    ``columns`` must be orderable (no maps).
    """
    rest = [c for c in columns if c not in (key, version)]
    row = F.max(F.struct(F.col(version), *[F.col(c) for c in rest])).alias("_row")
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(row)
    return picked.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in dict.fromkeys([key, *columns])])


def current_files(files: DataFrame, *columns: str, key: str = "file_id") -> DataFrame:
    """The current rows of ``file_records``: per file the row with the latest ``scanned_at``."""
    return latest(files, key, "scanned_at", [key, *columns])
