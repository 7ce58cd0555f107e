"""Features of one file: path parts, type, digests, entropy, tokens, texts for people."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import constants as K


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# paths: segments are separated by slashes of either kind


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def suffix(name: Column) -> Column:
    """The last dot and what follows, lower-cased; empty for leading or trailing dots only."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    cut = F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)
    return F.when(cut != "", cut).otherwise(name)


def depth(path: Column) -> Column:
    """Segments, counting the root and the file itself."""
    return (F.size(F.filter(F.split(path, r"[/\\]"), lambda p: p != "")) + F.when(path.startswith("/"), 1).otherwise(0)).cast("bigint")


def segments(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), r"[/\\]"), lambda p: p != "")


def path_has(path: Column, tokens: tuple[str, ...], match: str = "substring") -> Column:
    """Whether a segment of the path contains (``substring``) or is (``segment``) one of the tokens."""
    parts = segments(path)
    if match == "segment":
        return F.arrays_overlap(parts, F.array(*map(F.lit, tokens)))
    return F.exists(parts, lambda p: any_of([p.contains(t) for t in tokens]))


# types


def magic_type(head: Column) -> Column:
    """Type by leading bytes, the first signature that fits; null if none does."""
    return F.coalesce(*[F.when(F.startswith(head, F.lit(sig)), F.lit(label)) for sig, label in K.MAGIC])


def plain_ext(ext: Column) -> Column:
    return F.regexp_replace(F.lower(ext), r"^\.+", "")


def category(magic: Column, ext: Column) -> Column:
    """Category by magic type, else by extension, else Other."""
    e = plain_ext(ext)
    rules = [F.when(magic.isin(*v), F.lit(k)) for k, v in K.MAGIC_CATEGORIES.items()] + [F.when(e.isin(*v), F.lit(k)) for k, v in K.EXT_CATEGORIES.items()]
    return F.coalesce(*rules, F.lit("Other"))


def ext_compat(a: Column, b: Column) -> Column:
    """1.0 for equal extensions, 0.9 within a group, else 0.0; a missing one is compatible with nothing but itself."""
    groups = F.create_map(*[F.lit(v) for i, g in enumerate(K.EXT_COMPATIBLE) for e in g for v in (e, i)])
    group = lambda e: F.try_element_at(groups, plain_ext(e))
    return F.when(a == b, 1.0).when(group(a) == group(b), 0.9).otherwise(0.0)


# digests of binary content


def quick_digest(content: Column) -> Column:
    return F.md5(F.substring(content, 1, K.QUICK_BYTES))


def partial_digest(content: Column) -> Column:
    n = F.octet_length(content)
    head = F.substring(content, 1, K.CHUNK_BYTES)
    tail = F.substring(content, n - K.CHUNK_BYTES + 1, F.lit(K.CHUNK_BYTES))
    return F.md5(F.when(n > K.CHUNK_BYTES, F.concat(head, tail)).otherwise(head))


@F.pandas_udf(DoubleType())
def entropy(head: pd.Series) -> pd.Series:
    """Bits per byte of binary values, rounded to 4 digits; 0 for empty ones, null for null."""

    def one(b):
        if b is None:
            return None
        if not len(b):
            return 0.0
        p = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
        p = p[p > 0] / len(b)
        return round(float(-(p * np.log2(p)).sum()), 4) + 0.0

    return head.map(one)


# names


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(stem(name)), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two sets of distinct elements; 0 if either is empty or null."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(0.0)


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sequence ratio 2M/T of two strings as ``difflib`` defines it; depends on the order of its arguments."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def bigram_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of the bigram counts of two strings, null if either has none."""
    from collections import Counter
    from math import sqrt

    def one(x: str | None, y: str | None) -> float | None:
        p, q = (Counter(map(str.__add__, t or "", (t or "")[1:])) for t in (x, y))
        norms = sum(n * n for n in p.values()) * sum(n * n for n in q.values())
        return sum(n * q[g] for g, n in p.items()) / sqrt(norms) if norms else None

    return pd.Series(list(map(one, a, b)), dtype="float64")


# vectors and perceptual hashes


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def phash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hex hashes; 64 if either can't be read."""
    bits = lambda c: F.when(c.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(c, 16, -10).cast("bigint"))
    return F.coalesce(F.bit_count(bits(a).bitwiseXOR(bits(b))), F.lit(64)).cast("bigint")


# texts for people


def format_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.format_string("%.1f KB", F.bround(n / 1024, 1)))
        .when(n < 1024**3, F.format_string("%.2f MB", F.bround(n / 1024**2, 2)))
        .when(n.isNotNull(), F.format_string("%.2f GB", F.bround(n / 1024**3, 2)))
    )


#: The first second that a date of four digits can't write.
LAST_SECOND = 253_402_300_800.0


def format_ts(ts: Column) -> Column:
    """A time in seconds as text; missing ones and 0 are N/A, and so is what lies after the year 9999 or is no number."""
    return F.when((ts != 0) & ~F.isnan(ts) & (ts < LAST_SECOND), F.date_format(F.timestamp_seconds(F.floor(ts)), "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("N/A"))
