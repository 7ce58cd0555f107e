"""Vector similarity: pairs above a threshold, nearest neighbours, fused scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.features import cosine

#: Queries per block: a block of unit vectors and its running best, about 2 MB at 64 dimensions.
BLOCK = 4_096


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` with vectors of length 1; null, empty and zero vectors are left out."""
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), norm.alias("n")).where((F.col("n") > 0) & ~F.isnan("n")).select("vec_id", F.transform("e", lambda x: x / F.col("n")).alias("v"))


def _blocks(queries: DataFrame, vectors: DataFrame, pick, schema: str) -> DataFrame:
    """``pick(query ids, ids, similarities)`` for every block of queries against every partition of the vectors.

    The queries are a stated set, cut into blocks of bounded size. A block goes to the partitions of the vectors as a
    matrix; what comes back is what ``pick`` leaves. The work is |queries| x |vectors| multiplications.
    """
    q = unit_vectors(queries)
    blocks = max(1, -(-q.count() // BLOCK))
    out = vectors.select("vec_id").where(F.lit(False)).mapInPandas(lambda parts: parts, "vec_id bigint").selectExpr("vec_id as query_id", "vec_id", "0d as s")
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        ids, mat = np.array([r.vec_id for r in rows], dtype=np.int64), np.array([r.v for r in rows], dtype=np.float64)

        def measure(parts, ids=ids, mat=mat):
            for p in parts:
                if len(p):
                    have = p["vec_id"].to_numpy()
                    s = mat @ np.stack(p["v"].to_numpy()).T
                    s[ids[:, None] == have[None, :]] = -np.inf
                    yield pick(ids, have, s)

        out = out.unionByName(unit_vectors(vectors).mapInPandas(measure, schema))
    return out


def _best(k: int):
    def pick(ids, have, s):
        order = np.lexsort((np.broadcast_to(have, s.shape), -np.round(s, 9)))[:, :k]
        return pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "vec_id": have[order].ravel(), "s": np.take_along_axis(s, order, 1).ravel()})

    return pick


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best per query of ``(query_id, vec_id, s)``, by a window whose limit applies before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.round("s", 9).desc(), "vec_id")
    return found.where(F.col("s") > float("-inf")).withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= k).select("query_id", "vec_id", "place", F.round("s", 6).alias("similarity"))


def knn(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, vec_id, place, similarity)``: the k nearest of all vectors to each query by cosine, exactly.

    Ties go to the smaller id; a query is not its own neighbour; vectors without length have none and are none.
    """
    return _top(_blocks(queries, vectors, _best(k), "query_id bigint, vec_id bigint, s double"), k)


def within(queries: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """``(query_id, vec_id, similarity)``: all vectors whose cosine with a query is at least ``threshold``, exactly."""

    def pick(ids, have, s):
        i, j = np.nonzero(np.round(s, 6) >= threshold)
        return pd.DataFrame({"query_id": ids[i], "vec_id": have[j], "s": s[i, j]})

    return _blocks(queries, vectors, pick, "query_id bigint, vec_id bigint, s double").select("query_id", "vec_id", F.round("s", 6).alias("similarity"))


def centroids(vectors: DataFrame, cells: int = 16, sample: int = 20_000, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means on a bounded sample: the ``sample`` vectors with the smallest seeded hashes."""
    rows = unit_vectors(vectors).orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).collect()
    x = np.array([r.v for r in rows]) if rows else np.zeros((1, 1))
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        c = np.stack([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def ann(queries: DataFrame, vectors: DataFrame, k: int = 5, probes: int = 13, cells: int = 16) -> DataFrame:
    """``knn`` by an inverted file: every vector lies in the cell of its nearest centroid, a query looks into ``probes`` cells.

    Approximate: the recall at the defaults is tested to be at least 0.9. Fewer probes are faster and find less.
    """
    c = centroids(vectors, cells)

    def nearest(n: int):
        def cell(parts):
            for p in parts:
                if len(p):
                    near = np.argsort(-(np.stack(p["v"].to_numpy()) @ c.T), axis=1)[:, :n]
                    yield pd.DataFrame({"cell": near.ravel(), "vec_id": np.repeat(p["vec_id"].to_numpy(), near.shape[1]), "v": np.repeat(p["v"].to_numpy(), near.shape[1])})

        return cell

    schema = "cell int, vec_id bigint, v array<double>"
    q = unit_vectors(queries).mapInPandas(nearest(probes), schema).select("cell", F.col("vec_id").alias("query_id"), F.col("v").alias("w"))
    met = unit_vectors(vectors).mapInPandas(nearest(1), schema).join(q, "cell").where(F.col("vec_id") != F.col("query_id"))
    return _top(met.select("query_id", "vec_id", cosine(F.col("v"), F.col("w")).alias("s")), k)


def knn_similarity(cos: Column) -> Column:
    """1 / (1 + d) for the squared distance d of unit vectors with this cosine."""
    return 1 / (1 + (2 - 2 * cos))


def threshold_for(kind: Column) -> Column:
    """The similarity from which two things of a kind are alike."""
    named = [F.when(F.lower(kind) == k, F.lit(v)) for k, v in K.SEMANTIC_THRESHOLDS.items()]
    return F.coalesce(*named, F.lit(K.SEMANTIC_THRESHOLDS["default"]))


def contextual_score(a: str, b: str) -> Column:
    """Folder, time and name agreement of two structs with path, parent, name and mtime, at most 1.

    The folder of two absolute paths always has the root in common, so different folders score 0.2.
    """
    x, y = lambda f: F.col(f"{a}.{f}"), lambda f: F.col(f"{b}.{f}")
    rooted = x("path").startswith("/") & y("path").startswith("/")
    stem = lambda n: F.coalesce(F.nullif(F.regexp_extract(n, r"^(.+)\.[^.]*$", 1), F.lit("")), n)
    folder = F.when(x("parent") == y("parent"), 0.5).when(rooted, 0.2).otherwise(0.0)
    time = F.when(F.abs(F.coalesce(x("mtime"), F.lit(0.0)) - F.coalesce(y("mtime"), F.lit(0.0))) < 60, 0.3).otherwise(0.0)
    name = F.when(F.lower(x("name")) == F.lower(y("name")), 0.2).when(stem(x("name")) == stem(y("name")), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), folder + time + name)


def fused(hash_score: Column, semantic: Column, context: Column) -> Column:
    """Weighted sum of the layers; the behavioural layer is always 0."""
    w = K.FUSION_WEIGHTS
    return w["hash"] * hash_score + w["semantic"] * semantic + w["contextual"] * context + w["behavioral"] * 0.0
