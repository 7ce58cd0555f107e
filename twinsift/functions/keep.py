"""How much a file deserves to be kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .features import any_of, depth, path_has, stem, suffix


def is_copy_name(stem: Column) -> Column:
    s = F.lower(stem)
    return any_of([s.contains(p) for p in K.COPY_PATTERNS])


def name_keep_score(stem: Column) -> Column:
    s = F.lower(stem)
    numbered = F.when(s.rlike(r"\([0-9]+\)\s*$"), -20).when(s.rlike(r"[\s_\-][0-9]+\s*$"), -15).otherwise(0)
    descriptive = F.when((F.length(s) >= 10) & ~s.rlike(r"[_\-]{3,}"), 5).otherwise(0)
    total = F.when(is_copy_name(stem), -30).otherwise(0) + numbered + F.when(F.length(s) <= 2, -5).otherwise(0) + descriptive
    return F.when(stem.isNotNull(), total).cast("bigint")


def is_protected(path: Column) -> Column:
    p = F.lower(path)
    return any_of([p.contains(d.lower().replace("*", "")) for d in K.PROTECTED_DIRS])


def is_system_path(path: Column) -> Column:
    p = F.lower(path)
    return any_of([p.startswith(d.lower()) for d in K.SYSTEM_PREFIXES])


def needs_company(ext: Column) -> Column:
    """Whether a file of this extension marks its folder as one of installed software."""
    return F.lower(ext).isin(*K.NEEDED_EXTENSIONS)


def path_keep_score(path: Column, needed_sibling: Column, match: str = "substring") -> Column:
    """``needed_sibling``: whether the folder holds a file of installed software."""
    d = depth(path)
    return (
        F.when(is_protected(path), -60).otherwise(0)
        + F.when(needed_sibling, -40).otherwise(0)
        + F.when(path_has(path, K.TEMP_TOKENS, match), -25).otherwise(0)
        + F.when(path_has(path, K.PREFERRED_TOKENS, match), 10).otherwise(0)
        - F.when(d > 5, F.least((d - 5) * 2, F.lit(20))).otherwise(0)
        + F.when(d <= 4, 5).otherwise(0)
    ).cast("bigint")


def with_keep_score(files, match: str = "substring"):
    """A catalog of path, parent, name and flags with ``keep_score``; folders with installed software are found among its own files."""
    needed = files.where(needs_company(suffix(F.col("name")))).select("parent").distinct().withColumn("_needed", F.lit(True))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in files.columns else F.lit(False)
    score = keep_score(stem(F.coalesce("name", F.lit(""))), F.col("path"), F.coalesce("_needed", F.lit(False)), flag("is_locked"), flag("is_system"), match)
    return files.join(needed, "parent", "left").withColumn("keep_score", score).drop("_needed")


def keep_score(stem: Column, path: Column, needed_sibling: Column, locked: Column, system: Column, match: str = "substring") -> Column:
    total = 100 + name_keep_score(stem) + path_keep_score(path, needed_sibling, match) + F.when(locked, 20).otherwise(0) - F.when(system, 50).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(200), total)).cast("bigint")
