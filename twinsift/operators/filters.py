"""Which files take part, and which groups are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.features import any_of, parent_dir, path_has
from ..functions.keep import is_system_path


def size_between(files: DataFrame, low: int = 1, high: int = 0) -> DataFrame:
    """Sizes from ``low`` to ``high``; 0 as upper end means no end."""
    return files.where((F.col("size") >= low) & ((F.col("size") <= high) if high else F.lit(True)))


def excluding(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Paths that contain none of the patterns, in any case."""
    return files.where(~any_of([F.lower("path").contains(p.lower()) for p in patterns])) if patterns else files


def outside_system(files: DataFrame) -> DataFrame:
    return files.where(~is_system_path(F.col("path")))


def outside_temp(files: DataFrame) -> DataFrame:
    """Files none of whose folders is named like a temporary one."""
    return files.where(~path_has(parent_dir(F.col("path")), K.TEMP_TOKENS, "segment"))


def shown_groups(members: DataFrame, group_type: str | None = None, text: str = "") -> DataFrame:
    """Groups of a type with at least one member whose path contains a text, in any case."""
    groups = members.select("group_id", "group_type", "score").distinct()
    if group_type:
        groups = groups.where(F.col("group_type") == group_type)
    hit = members.where(F.lower("path").contains(text.lower())).select("group_id").distinct()
    return groups.join(hit, "group_id", "left_semi")


def revalidated(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, state, hash)`` of an earlier scan against a later one: unchanged, changed (digest cleared) or gone.

    Changed means another size or a modification time more than a second off; a missing one on either side is a change
    if the other is there.
    """
    b = new.select("path", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"), F.lit(True).alias("there"))
    same = F.col("size").eqNullSafe(F.col("size_now")) & (F.coalesce(F.abs(F.col("mtime") - F.col("mtime_now")) <= 1, F.col("mtime").isNull() & F.col("mtime_now").isNull()))
    state = F.when(F.col("there").isNull(), "gone").when(same, "unchanged").otherwise("changed")
    return old.join(b, "path", "left").select("path", state.alias("state"), F.when(state == "unchanged", F.col("hash")).alias("hash"))
