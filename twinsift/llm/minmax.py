"""Problem 3: files whose name, size and extension differ by small changes, by min-max hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.versions import current_files
from ..plans.runtime import Workspace, cut
from .linkage import min_labels

#: Names agree from this Jaccard similarity of their pieces on.
AGREE = 0.7
#: Sizes may differ by this part of the larger one.
SIZE_SLACK = 0.05
#: Bands, and permutations per band. A permutation gives a minimum and a maximum, so a band holds twice as many values.
#: Two names of similarity s share a band with probability about s^4: at 0.7 all 24 bands miss 0.2 % of the pairs, at
#: 0.75 one in ten thousand, while names that share a tenth of their pieces meet in one of 400 cases.
BANDS, PERMUTATIONS = 24, 2
#: A size bucket of the band join spans this many times the allowed slack; names whose largest size comes within a slack
#: of the upper edge are looked up in the next bucket too.
BUCKET_SLACKS = 8
SEED = 20_240_229
_EMPTY = np.uint64(0)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (xor-shift and multiply), so that products of it behave like random ranks."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def min_max_bands(pieces: list[np.ndarray], bands: int = BANDS, permutations: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    """One 64-bit key per band for each non-empty set of integer pieces, as a matrix of sets x bands.

    Every permutation ranks all pieces once and keeps both the smallest and the largest rank of a set: two signature
    values for one evaluation. The two ends of a permutation are drawn without replacement from the union, so their mean
    estimates the similarity with less variance than two independent minima would.
    """
    flat = _mixed(np.concatenate(pieces).astype(np.uint64) + np.uint64(seed))
    starts = np.zeros(len(pieces), dtype=np.int64)
    np.cumsum([len(p) for p in pieces[:-1]], out=starts[1:])
    rng = np.random.default_rng(seed)
    keys = np.empty((len(pieces), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(pieces), b + 1, dtype=np.uint64)
            for _ in range(permutations):
                odd, add = rng.integers(1, 2**63, 2, dtype=np.uint64)
                ranks = _mixed(flat * (odd | np.uint64(1)) + add)
                for ends in (np.minimum.reduceat(ranks, starts), np.maximum.reduceat(ranks, starts)):
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ ends)
            keys[:, b] = key
    return keys


def name_pieces(name):
    """The pieces of a name as a column of distinct strings: 3-character substrings of its runs of a-z and 0-9, shorter runs whole.

    The part before the last dot counts, all of it if there is none.
    """
    base = F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"(?s)^(.*)\.", 1)).otherwise(name)
    runs = F.regexp_extract_all(F.lower(base), F.lit("[a-z0-9]+"), F.lit(0))
    cut_up = F.transform(runs, lambda r: F.when(F.length(r) < 3, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 2, F.lit(1))), lambda i: F.substring(r, i, F.lit(3)))))
    return F.array_distinct(F.flatten(cut_up))


def _codes(pieces):
    """Pieces as sorted integers, exactly: base 37 with 0 for an absent character."""
    digit = lambda p, k: F.instr(F.lit("0123456789abcdefghijklmnopqrstuvwxyz"), F.substring(p, F.lit(k), F.lit(1)))
    one = lambda p: (F.when(F.length(p) >= 1, digit(p, 1)).otherwise(0) * 37 + F.when(F.length(p) >= 2, digit(p, 2)).otherwise(0)) * 37 + F.when(F.length(p) >= 3, digit(p, 3)).otherwise(0)
    return F.array_sort(F.transform(pieces, one))


def ext_classes(files: DataFrame, ext_groups: DataFrame) -> DataFrame:
    """``files`` with ``ext_class``: extensions agree if they are equal, without case, dots and surrounding blanks, or share a group.

    An extension of several groups gives a row per group; files without an extension are left out. ``ext_groups`` is a
    fixed small table, which Spark broadcasts by its size and would shuffle if it grew.
    """
    plain = lambda c: F.btrim(F.translate(F.lower(F.btrim(c, F.lit(" \t"))), ".", ""), F.lit(" \t"))
    named = ext_groups.select(plain(F.col("ext")).alias("plain_ext"), "ext_group").where(F.col("ext_group").isNotNull()).distinct()
    return files.withColumn("plain_ext", plain(F.col("ext"))).where(F.col("plain_ext") != "").join(named, "plain_ext", "left").withColumn("ext_class", F.when(F.col("ext_group").isNotNull(), F.concat(F.lit("g:"), "ext_group")).otherwise(F.concat(F.lit("e:"), "plain_ext")))


def _band_rows(bands: int, permutations: int):
    """Arrow batches of names -> (key, name_id): a key per band, with class of extension and size bucket mixed in."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            keys = min_max_bands(b["pieces"].tolist(), bands, permutations)
            bucket = b["bucket"].to_numpy(dtype=np.int64)
            block = b["ext_hash"].to_numpy(dtype=np.int64).astype(np.uint64)
            with np.errstate(over="ignore"):
                for at, who in ((bucket, np.ones(len(b), dtype=bool)), (bucket + 1, b["reaches"].to_numpy(dtype=bool))):
                    if who.any():
                        salted = _mixed(_mixed(block[who] + at[who].astype(np.uint64))[:, None] ^ keys[who])
                        yield pd.DataFrame({"key": salted.astype(np.int64).ravel(), "name_id": np.repeat(b["name_id"].to_numpy()[who], bands)})

    return rows


#: Logarithm of the size ratio that is allowed, a hair wider: rounding can't lose a pair, and the exact check follows.
_SLACK = -math.log1p(-SIZE_SLACK) + 1e-9


def _step(size, slacks: int):
    """The bucket of a size when a bucket spans so many slacks."""
    return F.floor(F.log(size.cast("double")) / F.lit(_SLACK * slacks)).cast("bigint")


def near_names(files: DataFrame, ext_groups: DataFrame, bands: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """``(file_id_a, file_id_b)``, a < b: pairs of current files that agree in name, size and extension.

    A name is hashed once for all its files of an extension class and a size bucket, however many sizes they have, so a
    popular name costs one signature and its files never meet in the band join. Bands are joined within extension class
    and size bucket and the names of candidates are checked exactly. Pairs of names then become pairs of sizes by a join
    on buckets one slack wide, which spreads a name with many sizes and forms little more than the pairs that agree, and
    these become the pairs of files that the result asks for. Missing names, extensions and sizes, sizes up to 0, and
    names without any piece give no pair. No bucket is capped.
    """
    with Workspace(files.sparkSession, "names") as work:
        now = current_files(files, "name", "size", "ext", "scanned_at").where((F.col("size") > 0) & F.col("name").isNotNull() & F.col("ext").isNotNull())
        read = ext_classes(now, ext_groups).select("file_id", "size", "ext_class", _codes(name_pieces(F.col("name"))).alias("pieces")).where(F.size("pieces") > 0)
        keyed = work.keep(read.withColumn("bucket", _step(F.col("size"), BUCKET_SLACKS)))
        of_name = ["ext_class", "pieces", "bucket"]
        reaches = F.floor((F.log(F.max("size").cast("double")) + F.lit(_SLACK)) / F.lit(_SLACK * BUCKET_SLACKS)) > F.col("bucket")
        # the smallest id of a name's files names it; a file whose extension has several groups takes part in several names
        names = work.keep(keyed.groupBy(*of_name).agg(F.min("file_id").alias("first"), reaches.alias("reaches")).select(F.xxhash64("first", "ext_class", "bucket").alias("name_id"), F.xxhash64("ext_class").alias("ext_hash"), *of_name, "reaches"))
        rows = names.select("name_id", "ext_hash", "pieces", "bucket", "reaches").mapInPandas(_band_rows(bands, permutations), "key bigint, name_id bigint")
        left, right = rows.alias("l"), rows.alias("r")
        met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.name_id") < F.col("r.name_id"))).select(F.col("l.name_id").alias("a"), F.col("r.name_id").alias("b")).distinct()
        side = lambda x: names.select(F.col("name_id").alias(x), F.col("ext_class").alias(f"ext_{x}"), F.col("pieces").alias(f"pieces_{x}"))
        common = F.size(F.array_intersect("pieces_a", "pieces_b"))
        agree = common >= F.lit(AGREE) * (F.size("pieces_a") + F.size("pieces_b") - common)
        near = met.join(side("a"), "a").join(side("b"), "b").where((F.col("ext_a") == F.col("ext_b")) & agree).select("a", "b")
        pairs = near.unionByName(names.select(F.col("name_id").alias("a"), F.col("name_id").alias("b")))
        sized = work.keep(keyed.join(names.select(*of_name, "name_id"), of_name).select("name_id", "size", "file_id"))
        sizes = sized.groupBy("name_id", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("step", _step(F.col("size"), 1))
        of_a = sizes.select(F.col("name_id").alias("a"), F.col("size").alias("size_a"), F.col("n"), F.explode(F.array(*[F.col("step") + k for k in (-1, 0, 1)])).alias("step"))
        of_b = sizes.select(F.col("name_id").alias("b"), F.col("size").alias("size_b"), "step")
        close = F.abs(F.col("size_a") - F.col("size_b")) * round(1 / SIZE_SLACK) <= F.greatest("size_a", "size_b")
        once = (F.col("a") != F.col("b")) | (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("n") > 1))
        met_sizes = pairs.join(of_a, "a").join(of_b, ["b", "step"]).where(close & once).select("a", "size_a", "b", "size_b")
        member = lambda x, f: sized.select(F.col("name_id").alias(x), F.col("size").alias(f"size_{x}"), F.col("file_id").alias(f))
        full = met_sizes.join(member("a", "x"), ["a", "size_a"]).join(member("b", "y"), ["b", "size_b"]).where((F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & ((F.col("a") != F.col("b")) | (F.col("size_a") != F.col("size_b")))))
        out = full.select(F.least("x", "y").alias("file_id_a"), F.greatest("x", "y").alias("file_id_b"))
        return cut(out.distinct())


def near_name_groups(files: DataFrame, ext_groups: DataFrame) -> DataFrame:
    """``(file_id, group_id, n_links)`` of every file that ``near_names`` pairs with another one.

    group_id is the smallest file_id of all files linked directly or through others; n_links counts the file's own pairs.
    """
    with Workspace(files.sparkSession, "name-groups") as work:
        pairs = near_names(files, ext_groups)
        links = pairs.select(F.explode(F.array("file_id_a", "file_id_b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
        labels = min_labels(pairs.select(F.col("file_id_a").alias("u"), F.col("file_id_b").alias("v")), work)
        return cut(links.join(labels, "id").select(F.col("id").alias("file_id"), F.col("label").alias("group_id"), "n_links"))


NAMES_SQL = r"""
with cur as (select * from (select *, row_number() over (partition by file_id order by scanned_at desc) rn from file_records) where rn = 1),
x as (select trim(replace(lower(trim(ext, ' ' || chr(9))), '.', ''), ' ' || chr(9)) e, ext_group from ext_groups where ext_group is not null group by all),
f as (select file_id, size, trim(replace(lower(trim(ext, ' ' || chr(9))), '.', ''), ' ' || chr(9)) e,
  list_distinct(flatten(list_transform(regexp_extract_all(lower(case when instr(name, '.') > 0 then regexp_extract(name, '(?s)^(.*)\.', 1) else name end), '[a-z0-9]+'),
    lambda r: case when length(r) < 3 then [r] else list_transform(range(1, length(r) - 1), lambda i: substr(r, i::int, 3)) end))) p from cur where size > 0 and name is not null),
g as (select f.file_id, size, p, case when ext_group is null then 'e:' || f.e else 'g:' || ext_group end c from f left join x on x.e = f.e where f.e <> '' and len(p) > 0),
k as (select *, floor(ln(size) / 0.0513)::bigint b from g),
h as (select *, unnest([b - 1, b, b + 1]) n from k),
w as (select distinct a.file_id file_id_a, z.file_id file_id_b, a.p ap, z.p zp from k a join h z on a.c = z.c and a.b = z.n and a.file_id < z.file_id
  and abs(a.size - z.size) * 20 <= greatest(a.size, z.size) and len(a.p) * 10 >= 7 * len(z.p) and len(z.p) * 10 >= 7 * len(a.p))
select distinct file_id_a, file_id_b from w where len(list_intersect(ap, zp)) * 10 >= 7 * (len(ap) + len(zp) - len(list_intersect(ap, zp)))
"""
