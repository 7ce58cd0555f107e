"""Connected components of the catalog's graphs, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import Workspace, cut

MOST_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour is linked to the smallest vertex of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours are linked to the smallest of them."""
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    up = edges.join(low, "b")
    return up.where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: their number and two sums of hashes, in one pass without a shuffle of edges."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), h(1), h(2)).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, component)`` for every vertex of an edge between different vertices; the component is its smallest vertex.

    Large-star and small-star steps alternate until the edges are stars around the smallest vertices, a logarithmic
    number of rounds. Rounds are written to the shared folder. Null vertices and self-edges link nothing.
    """
    with Workspace(edges.sparkSession, "components") as work:
        x, y = F.col(a), F.col(b)
        mark = None
        now = work.keep(edges.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())
        for _ in range(MOST_ROUNDS):
            nxt = work.keep(_small_star(_large_star(now)))
            mark, before = _mark(nxt), mark
            if mark == before:
                break
            now = nxt
        else:
            raise RuntimeError(f"edges still change after {MOST_ROUNDS} rounds")
        roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
        return cut(roots.unionByName(now.select(F.col("b").alias("id"), F.col("a").alias("component"))))
