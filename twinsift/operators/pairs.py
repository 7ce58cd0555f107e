"""Candidate pairs, their scores, and the clusters they form."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_, mul, or_
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.features import bigram_cosine, cosine, name_ratio, stem
from ..functions.score import NAME_POINTS, components, name_points, pair_score
from ..plans.runtime import cut
from .components import connected_components

#: What scoring reads of a file; absent columns are null.
SCORED = {"path": "string", "parent": "string", "name": "string", "ext": "string", "size": "bigint", "mtime": "double", "hash": "string", "partial_hash": "string", "quick_hash": "string", "magic_type": "string", "entropy": "double", "phash": "string", "tokens": "array<string>", "embedding": "array<float>"}

#: So many bigrams, the most frequent ones, are ranked by frequency; all others count as rarer.
RANKED_GRAMS = 65_536


def scored_columns(files: DataFrame) -> DataFrame:
    return files.select(*[F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in SCORED.items()])


def block_pairs(files: DataFrame, *keys: str) -> DataFrame:
    """``(a, b)`` structs of two files of equal size (and further keys), ``a`` before ``b`` by path.

    ``files`` should be rid of exact copies first: copies belong to groups, and a block of copies would be all pairs.
    """
    f = scored_columns(files).where(F.col("size") > 0)
    row = lambda n: f.select("size", *keys, F.struct(*[F.col(c) for c in SCORED]).alias(n))
    return row("a").join(row("b"), ["size", *keys]).where(F.col("a.path") < F.col("b.path")).select("size", "a", "b")


def near_candidates(files: DataFrame) -> DataFrame:
    """Pairs of equal size whose quick digests don't differ; one that is missing differs from none.

    Files with a digest meet on (size, digest); those without meet all of their size.
    """
    have, lack = files.where(F.col("quick_hash").isNotNull()), scored_columns(files.where(F.col("quick_hash").isNull() & (F.col("size") > 0)))
    row = lambda d, n: d.select("size", F.struct(*[F.col(c) for c in SCORED]).alias(n))
    some = row(lack, "x").join(row(scored_columns(files), "y"), "size").where((F.col("x.path") < F.col("y.path")) | (F.col("y.quick_hash").isNotNull() & (F.col("x.path") > F.col("y.path"))))
    first = F.col("x.path") < F.col("y.path")
    mixed = some.select("size", F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
    return block_pairs(have, "quick_hash").unionByName(mixed)


def near_pairs(candidates: DataFrame, min_score: int = 70, with_names: bool = True, semantic: bool = False) -> DataFrame:
    """``(path_a, path_b, score, c_...)`` of the candidates that reach ``min_score``.

    The name ratio needs Python, so it is computed only for pairs that it can still lift over the threshold. ``semantic``
    adds the points of the cosine of both files' ``embedding``; a file without one gets none.
    """
    likeness = F.when(F.col("a.embedding").isNotNull() & F.col("b.embedding").isNotNull(), cosine(F.col("a.embedding"), F.col("b.embedding"))) if semantic else None
    native = components("a", "b", cosine=likeness)
    base = candidates.withColumn("_native", pair_score("a", "b", cosine=likeness))
    c = lambda k: native[k].cast("bigint").alias(f"c_{k}")
    rest = [k for k in native if k != "name" and (semantic or k != "semantic")]
    if not with_names:
        return base.where(F.col("_native") >= min_score).select(F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b"), F.col("_native").alias("score"), *map(c, rest))
    able = base.where(F.col("_native") + NAME_POINTS >= min_score)
    r = able.withColumn("_ratio", name_ratio(F.lower(stem(F.col("a.name"))), F.lower(stem(F.col("b.name")))))
    names = name_points(F.coalesce("_ratio", F.lit(0.0)))
    score = F.when((F.col("_native") == 0) | (F.col("a.hash") == F.col("b.hash")), F.col("_native")).otherwise(F.least(F.lit(100), F.col("_native") + names))
    return r.withColumn("score", score.cast("bigint")).where(F.col("score") >= min_score).select(F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b"), "score", names.cast("bigint").alias("c_name"), *map(c, rest))


def capped(pairs: DataFrame, per_block: int = K.MAX_PAIRS_PER_BLOCK, most: int = K.MAX_PAIRS) -> DataFrame:
    """The first pairs of each size block, and of those the first overall, in path order: an operator's own limit.

    The block limit is a window group limit, applied before the shuffle; the overall one a distributed top-k.
    """
    order = Window.partitionBy("size").orderBy("path_a", "path_b")
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_block).drop("_n").orderBy("size", "path_a", "path_b").limit(most)


def bigram_pairs(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(name_a, name_b, similarity)`` of distinct names whose bigram counts have a cosine above the threshold.

    An exact prefix-filtered join: with bigrams in a fixed order, rarest first, two vectors of cosine above t share a
    bigram among those that hold more than 1 - t² of each vector's squared length; only such prefixes are joined. A bound
    on the dot product drops most candidates inside the join; the rest are measured in full.
    """
    each = names.select(F.lower("name").alias("name")).where(F.length("name") > 1).distinct()
    grams = each.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.substring("name", i, F.lit(2)))).alias("gram")).groupBy("name", "gram").agg(F.count(F.lit(1)).cast("double").alias("n"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    vector = grams.join(df, "gram").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "n"))).alias("v"), F.sum(F.col("n") * F.col("n")).alias("norm2"))
    # running rest of the squared length before each element: elements are in the prefix while it is at least t² of all
    rest = F.expr("aggregate(v, named_struct('left', norm2, 'keep', cast(array() as array<string>)), (s, x) -> named_struct('left', s.left - x.n * x.n, 'keep', case when s.left >= {0} * norm2 then array_append(s.keep, x.gram) else s.keep end), s -> s.keep)".format(threshold * threshold * (1 - 1e-12)))
    # dot products are at most: common bigrams x largest counts; hashed bigrams can only make that bound looser
    v = vector.select("name", "norm2", F.map_from_entries(F.transform("v", lambda x: F.struct(x.gram, x.n))).alias("m"), F.transform("v", lambda x: F.xxhash64(x.gram)).alias("grams"), F.array_max(F.transform("v", lambda x: x.n)).alias("top"), rest.alias("prefix"))
    # few bytes meet in many pairs here, so partitions must not be merged by size: a stated number keeps them apart
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = v.select("name", "norm2", "grams", "top", F.explode("prefix").alias("gram")).repartition(4 * tasks, "gram")
    x, y = p.alias("x"), p.alias("y")
    bound = F.size(F.array_intersect("x.grams", "y.grams")) * F.col("x.top") * F.col("y.top")
    near = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.name") < F.col("y.name")) & (bound * (1 + 1e-9) >= threshold * F.sqrt(F.col("x.norm2") * F.col("y.norm2")))
    met = x.join(y, near).select(F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b")).distinct()
    a = v.select(F.col("name").alias("name_a"), F.col("m").alias("ma"), F.col("norm2").alias("na"))
    b = v.select(F.col("name").alias("name_b"), F.col("m").alias("mb"), F.col("norm2").alias("nb"))
    dot = F.aggregate(F.map_keys("ma"), F.lit(0.0), lambda s, g: s + F.try_element_at("ma", g) * F.coalesce(F.try_element_at("mb", g), F.lit(0.0)))
    return met.join(a, "name_a").join(b, "name_b").withColumn("similarity", dot / F.sqrt(F.col("na") * F.col("nb"))).where(F.col("similarity") > threshold).select("name_a", "name_b", F.round("similarity", 6).alias("similarity"))


def _rarest_sets(grams: list[int], masses: list[int], shared: int, budget: float, block: int) -> list[int]:
    """A number for every set of grams that can be the first ``shared`` which a name has in common with a like one.

    Grams come rarest first; those that a set skips are not in common, so they weigh at most ``budget``. Two names with
    fewer grams in common meet on all of those.
    """
    found: list[int] = []

    def go(i: int, left: int, skipped: int, number: int) -> None:
        while left and i < len(grams):  # calls go only as deep as grams are shared, however long the name
            go(i + 1, left - 1, skipped, (number * 0x9E3779B97F4A7C15 + grams[i] + 1) & 0xFFFFFFFFFFFFFFFF)
            skipped, i = skipped + masses[i], i + 1
            if skipped > budget:
                return
        found.append(number)

    go(0, shared, 0, block & 0xFFFFFFFFFFFFFFFF)
    return found


def _meeting_places(ranks: dict[str, int], threshold: float):
    """Arrow batches ``(id, name, block, shared)`` -> ``(id, norm2, bits, keys)``: squared length, hashed bigrams, and where the name meets others."""
    share = 1 - threshold * threshold * (1 - 1e-9)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, bits, keys, ends = [], [], [], [0]
            for name, block, shared in zip(*(batch.column(c).to_pylist() for c in ("name", "block", "shared"))):
                counts = Counter(map(str.__add__, name, name[1:]))
                order = sorted((ranks[g] if g in ranks else crc32(g.encode()) + (1 << 32), g) for g in counts)[::-1]
                masses = [counts[g] ** 2 for _, g in order]
                norms.append(sum(masses))
                bits.append(reduce(or_, (1 << (r * 0x9E3779B1 >> 16 & 63) for r, _ in order)))
                keys += _rarest_sets([r for r, _ in order], masses, shared, share * norms[-1], block)
                ends.append(len(keys))
            whole = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(norms, pa.int64()), whole(bits), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), whole(keys))], ["id", "norm2", "bits", "keys"])

    return places


def _blocks(files: DataFrame, min_score: int) -> DataFrame:
    """``(id, name, block)``: without tokens, entropy and perceptual hashes, two files that share no block score less than ``min_score``.

    Equal digests score 100. Files of equal size share a block. Sizes that differ give at most 15 points and everything
    else 55, so what such files may lack to ``min_score`` tells which columns must be equal, and within which time. Up to 55,
    no column must be: all share one block.
    """
    lack = 70 - min_score
    equal = [F.col(c) for c, loss in (("ext", 7), ("magic_type", 8), ("parent", 5)) if loss > lack]
    hours = next((h for h, loss in ((1, 2), (24, 4), (168, 5)) if loss > lack), None)
    # two times that are no further apart than the span share a place of one of two grids, half a place apart
    place = lambda i: F.floor(F.col("mtime") / (7200.0 * hours) + i / 2)
    key = lambda kind, *c: F.when(reduce(and_, (x.isNotNull() for x in c), F.lit(True)), F.xxhash64(F.lit(kind), *c))
    keys = [key("size", F.col("size")), key("hash", F.col("hash"))] if min_score > 55 else [key("all")]
    if 0 <= lack < 15:
        keys += [key(f"time {i}", *equal, place(i)) for i in (0, 1)] if hours else [key("rest", *equal)]
    # lower case first: it can be longer
    return files.withColumn("name", F.lower("name")).where(F.length("name") > 1).select("id", "name", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("block"))


def _named_candidates(files: DataFrame, threshold: float, min_score: int) -> DataFrame:
    """``(i, j)``: ids of files that share a block and whose names may have a bigram cosine above ``threshold``; all such pairs are among them.

    Bigrams that only one of two names has weigh less than 1 - t² of either's squared length. With bigrams in a fixed
    order, rarest first, names therefore meet on the sets of bigrams that can be the first so many in common; how many
    these are is settled per block by what it costs, from none (all with all) in small blocks to three. A bound on the
    cosine, from hashed bigrams, drops nearly all others inside the join.
    """
    rows = _blocks(files, min_score)
    skipped = (1 - threshold * threshold) * (F.length("name") - 1)
    sets = [F.sum(reduce(mul, ((skipped + i) / i for i in range(1, k + 1)), F.lit(1.0))) for k in range(4)]
    n = F.count(F.lit(1)).cast("double")
    # microseconds: 2 for a set, and for a pair 0.05 times how often names share that many rare bigrams
    cost = F.array(*[2 * s + n * n * p for s, p in zip(sets, (2.5e-2, 2.5e-3, 1.6e-4, 7e-6))])
    known = rows.groupBy("block").agg(n.alias("n"), (F.array_position(cost, F.array_min(cost)) - 1).cast("int").alias("shared")).where(F.col("n") > 1).drop("n")
    grams = files.select(F.lower("name").alias("name")).where(F.length("name") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.substring("name", i, F.lit(2)))).alias("gram"))
    # any order gives the same pairs: grams without a rank come before those with one
    ranks = {r.gram: i for i, r in enumerate(grams.groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(RANKED_GRAMS).select("gram").collect())}
    met = rows.join(known, "block").select("id", "name", "block", "shared").mapInArrow(_meeting_places(ranks, threshold), "id bigint, norm2 bigint, bits bigint, keys array<bigint>")
    # few bytes meet in many pairs here, so partitions must not be merged by size: a stated number keeps them apart
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = met.select("id", "norm2", "bits", F.explode("keys").alias("key")).repartition(4 * tasks, "key")
    common = lambda a, b: (F.col(f"{a}.norm2") - F.bit_count(F.col(f"{a}.bits").bitwiseAND(F.bitwise_not(F.col(f"{b}.bits"))))).cast("double")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (common("x", "y") * common("y", "x") * (1 + 1e-9) >= threshold * threshold * F.col("x.norm2") * F.col("y.norm2"))
    return p.alias("x").join(p.alias("y"), near).select(F.col("x.id").alias("i"), F.col("y.id").alias("j")).distinct()


def named_pairs(files: DataFrame, threshold: float = 0.85, min_score: int = 70) -> DataFrame:
    """``(path_a, path_b, score, c_...)`` of files whose names agree (bigram cosine above ``threshold``) and that reach ``min_score``.

    Names agree with themselves too; without case. Scored without tokens, entropy and perceptual hashes. Only files that
    have in common what ``min_score`` takes meet at all (equal digests, equal sizes, or nearly equal sizes and the rest),
    so names are compared within such blocks; up to the 55 points that go without a size, all names are compared.
    """
    f = cut(scored_columns(files.drop("tokens", "entropy", "phash", "embedding")).drop("tokens", "entropy", "phash", "embedding").withColumn("id", F.monotonically_increasing_id()))
    row = lambda n, i: f.select(F.col("id").alias(i), F.struct(*[F.col(c) if c in f.columns else F.lit(None).cast(t).alias(c) for c, t in SCORED.items()]).alias(n))
    met = _named_candidates(f, threshold, min_score).join(row("x", "i"), "i").join(row("y", "j"), "j").where(F.col("x.path") != F.col("y.path"))
    first = F.col("x.path") < F.col("y.path")
    both = met.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
    able = both.where(pair_score("a", "b") + NAME_POINTS >= min_score)
    return near_pairs(able.where(bigram_cosine(F.lower("a.name"), F.lower("b.name")) > threshold), min_score)


def near_clusters(pairs: DataFrame, largest: int | None = K.MAX_CLUSTER) -> DataFrame:
    """``(path, cluster, n_files, score)``: pairs merged transitively; a cluster is named by its smallest path and scored by its best pair.

    Clusters of more than ``largest`` files are left out: they say that the threshold is too low, not that all are alike.
    None keeps clusters of any size.
    """
    c = connected_components(pairs, "path_a", "path_b")
    best = pairs.join(c.withColumnRenamed("id", "path_a"), "path_a").groupBy("component").agg(F.max("score").alias("score"))
    n = c.groupBy("component").agg(F.count(F.lit(1)).alias("n_files"))
    n = n if largest is None else n.where(F.col("n_files") <= largest)
    return c.join(n, "component").join(best, "component").select(F.col("id").alias("path"), F.col("component").alias("cluster"), "n_files", "score")


def validated(clusters: DataFrame, pairs: DataFrame, min_similarity: float = 0.6, largest: int | None = K.MAX_VALIDATED_CLUSTER) -> DataFrame:
    """``(cluster, n_files, valid)``: valid if at least 30 % of a cluster's pairs reach ``min_similarity``.

    ``pairs`` are those that reach it: the rest of a cluster's n (n - 1) / 2 pairs don't, so none has to be formed.
    Clusters of more than ``largest`` files count as valid unchecked; None checks all, at the same cost, as pairs are only counted.
    """
    n = clusters.groupBy("cluster").agg(F.max("n_files").alias("n_files"))
    of = clusters.select(F.col("path").alias("path_a"), "cluster")
    good = pairs.where(F.col("score") >= 100 * min_similarity).join(of, "path_a").groupBy("cluster").agg(F.count(F.lit(1)).alias("good"))
    share = F.coalesce("good", F.lit(0)) / (F.col("n_files") * (F.col("n_files") - 1) / 2)
    return n.join(good, "cluster", "left").select("cluster", "n_files", ((F.lit(False) if largest is None else F.col("n_files") > largest) | (share >= K.MIN_VALID_SHARE)).alias("valid"))


def found_share(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row ``(expected, found, missing, pass_rate, passed)`` for two tables of pairs ``(a, b)`` in any order; passed from 80 % on."""
    norm = lambda d: d.dropna(subset=["a", "b"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    hit = norm(expected).join(norm(found).withColumn("hit", F.lit(1)), ["a", "b"], "left")
    t = hit.agg(F.count(F.lit(1)).alias("expected"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    rate = F.when(F.col("expected") > 0, F.round(100 * F.col("found") / F.col("expected"), 2)).otherwise(0.0)
    return t.select("expected", "found", (F.col("expected") - F.col("found")).alias("missing"), rate.alias("pass_rate"), (rate >= 80).alias("passed"))
