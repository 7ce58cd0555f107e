"""The similarity score of a pair, 0 to 100, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import ext_compat, jaccard, phash_distance

#: The most that the name ratio can add: pairs below min_score by more than this need no ratio.
NAME_POINTS = 25


def name_points(ratio: Column) -> Column:
    return F.when(ratio > 0.90, 25).when(ratio > 0.70, 18).when(ratio > 0.50, 10).otherwise(0)


def components(a: str, b: str, ratio: Column | None = None, cosine: Column | None = None) -> dict[str, Column]:
    """Points by component for two structs ``a`` and ``b``; ``ratio`` and ``cosine`` are optional extras."""
    x, y = lambda f: F.col(f"{a}.{f}"), lambda f: F.col(f"{b}.{f}")
    both = lambda f: x(f).isNotNull() & y(f).isNotNull()
    off = F.abs(x("size") - y("size")) / F.greatest(x("size"), y("size"), F.lit(1))
    overlap = jaccard(x("tokens"), y("tokens"))
    entropy_gap = F.abs(x("entropy") - y("entropy")) / F.greatest(x("entropy"), y("entropy"), F.lit(0.001))
    bits = phash_distance(x("phash"), y("phash"))
    hours = F.abs(x("mtime") - y("mtime")) / 3600
    known = lambda f: F.coalesce(x(f) != 0, F.lit(False)) & F.coalesce(y(f) != 0, F.lit(False))
    zero = F.lit(0)
    return {
        "size": F.when(x("size") == y("size"), 35).when(off <= 0.05, 15).when(off <= 0.10, 8).otherwise(0),
        "quick": F.when((x("quick_hash") == y("quick_hash")) & (x("size") == y("size")), 20).otherwise(0),
        "name": zero if ratio is None else name_points(ratio),
        "token": F.when(overlap > 0.7, 10).when(overlap > 0.4, 5).otherwise(0),
        "ext": F.when(x("ext") == y("ext"), 12).when(ext_compat(x("ext"), y("ext")) > 0, 5).otherwise(0),
        "magic": F.when(x("magic_type") == y("magic_type"), 8).otherwise(0),
        "dir": F.when((x("parent") == y("parent")) & (x("parent") != ""), 5).otherwise(0),
        "entropy": F.when(both("entropy") & (entropy_gap < 0.1), 5).otherwise(0),
        "phash": F.when(both("phash"), F.when(bits <= 8, 30).when(bits <= 16, 18).when(bits <= 24, 8).otherwise(0)).otherwise(0),
        "semantic": zero if cosine is None else F.when(cosine >= 0.92, 40).when(cosine >= 0.88, 30).when(cosine >= 0.85, 20).when(cosine >= 0.80, 12).when(cosine >= 0.75, 6).otherwise(0),
        "time": F.when(known("mtime"), F.when(hours < 1, 5).when(hours < 24, 3).when(hours < 168, 1).otherwise(0)).otherwise(0),
    }


def ruled_out(a: str, b: str) -> Column:
    """Pairs that score 0 whatever else agrees: sizes too far apart, or equal sizes with different partial or quick digests."""
    x, y = lambda f: F.col(f"{a}.{f}"), lambda f: F.col(f"{b}.{f}")
    off = F.abs(x("size") - y("size")) / F.greatest(x("size"), y("size"), F.lit(1))
    differ = F.coalesce(x("partial_hash") != y("partial_hash"), F.lit(False)) | F.coalesce(x("quick_hash") != y("quick_hash"), F.lit(False))
    return (off > 0.20) | ((x("size") == y("size")) & differ)


def pair_score(a: str, b: str, ratio: Column | None = None, cosine: Column | None = None) -> Column:
    """100 for equal full digests, 0 for ruled-out pairs, else the sum of the components, at most 100."""
    parts = list(components(a, b, ratio, cosine).values())
    same = F.coalesce(F.col(f"{a}.hash") == F.col(f"{b}.hash"), F.lit(False))
    return F.when(same, 100).when(ruled_out(a, b), 0).otherwise(F.least(F.lit(100), sum(parts[1:], parts[0]))).cast("bigint")
