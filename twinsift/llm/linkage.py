"""Problem 4: one group identifier for everything linked by pairwise matches, directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.readings import clean_path
from ..plans.runtime import Workspace, cut, reset_jobs
from .survivors import saved_groups

#: A graph of n vertices needs about log2(n) rounds; more than this many means a defect, not a large graph.
MOST_ROUNDS = 64


def path_links(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``(a, b)``: the links between different paths. Null and blank paths link nothing; scores and pass names don't matter.

    The list of a group becomes a star around its first path, n - 1 links instead of n (n - 1) / 2 pairs; the star is
    built inside the row, so a list is never gathered from several rows.
    """
    matched = pairs.select(clean_path(F.col("path_a")).alias("a"), clean_path(F.col("path_b")).alias("b"))
    paths = F.array_distinct(F.filter(F.transform("files", lambda p: clean_path(p)), lambda p: p.isNotNull()))
    stars = saved_groups(groups).select(paths.alias("paths")).where(F.size("paths") > 1).select(F.get("paths", F.lit(0)).alias("a"), F.explode(F.slice("paths", 2, F.size("paths"))).alias("b"))
    return matched.unionByName(stars).where(F.col("a") != F.col("b"))


def numbered(links: DataFrame, work: Workspace) -> DataFrame:
    """``(path, id)`` of every linked path, with ids in path order: the smallest id of a group is its smallest path.

    Range partitions in path order, sorted inside, make ``monotonically_increasing_id`` follow the order. The table is
    written before use, so that a recomputed task can't number anew.
    """
    paths = links.select(F.explode(F.array("a", "b")).alias("path")).distinct()
    ordered = paths.repartitionByRange("path").sortWithinPartitions("path")
    return work.keep(ordered.select("path", F.monotonically_increasing_id().alias("id")))


def _jumped(near: DataFrame, work: Workspace) -> DataFrame:
    """``(u, label)``: the pointers ``(u, p)`` followed to the end, doubling the length of each step."""
    at = near
    for _ in range(MOST_ROUNDS):
        up = at.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        at = work.keep(at.select("u", "p").join(up, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("u", F.col("p").alias("label"))
    raise RuntimeError("pointers form a cycle")


def min_labels(edges: DataFrame, work: Workspace) -> DataFrame:
    """``(id, label)`` for every vertex of the edges ``(u, v)``: the smallest id of its component.

    Each round takes for every vertex the minimum over itself and its neighbours, follows these pointers to their ends by
    pointer jumping (label[label[v]], so a chain of n links takes log2(n) jumps), and rewrites the edges to the labels of
    their ends. Edges whose ends agree are gone, repeats merge, so the edge table shrinks by a large factor each round
    and only the vertices of the remaining edges take part. Labels and edges are written to the shared folder each round;
    the rounds end when no edge between different labels is left, that is when no label can change any more. Minima are
    combined map-side, so a hub with a third of all edges costs one row per task; every label table is unique per vertex,
    so AQE can split a hot key of the joins.
    """
    live = work.keep(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct())
    maps = []
    for n in range(MOST_ROUNDS):
        reset_jobs(edges.sparkSession, f"min labels: round {n + 1}")
        if live.isEmpty():
            break
        ends = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = work.keep(ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
        jumped = _jumped(near, work)
        maps.append(jumped)
        of_u = jumped.select("u", F.col("label").alias("lu"))
        of_v = jumped.select(F.col("u").alias("v"), F.col("label").alias("lv"))
        live = work.keep(live.join(of_u, "u").join(of_v, "v").where(F.col("lu") != F.col("lv")).select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct())
    else:
        raise RuntimeError(f"labels still change after {MOST_ROUNDS} rounds")
    reset_jobs(edges.sparkSession, "")
    if not maps:
        return edges.select(F.col("u").alias("id"), F.col("u").alias("label")).where(F.lit(False))
    # labels of later rounds are labels of ever fewer vertices: compose from the last and smallest map backwards
    label = maps.pop()
    while maps:
        later = label.select(F.col("u").alias("label"), F.col("label").alias("to"))
        label = work.keep(maps.pop().join(later, "label", "left").select("u", F.coalesce("to", "label").alias("label")))
    return label.select(F.col("u").alias("id"), "label")


def path_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``(path, group_path)``: every path that is linked to another one, with the smallest path linked to it.

    Self-links, nulls and blanks give no row; repeats and either order of a pair change nothing; an empty input gives an
    empty result.
    """
    with Workspace(pairs.sparkSession, "linkage") as work:
        links = work.keep(path_links(pairs, groups))
        ids = numbered(links, work)
        edges = links.join(ids.select(F.col("path").alias("a"), F.col("id").alias("u")), "a").join(ids.select(F.col("path").alias("b"), F.col("id").alias("v")), "b").select("u", "v")
        labelled = min_labels(edges, work).join(ids, "id").select("path", "label")
        return cut(labelled.join(ids.select(F.col("id").alias("label"), F.col("path").alias("group_path")), "label").select("path", "group_path"))


LINKAGE_SQL = r"""
with recursive g as (select * from (select *, row_number() over (partition by group_id order by saved_at desc) rn from dup_groups) where rn = 1),
l as (select group_id, trim(unnest(files), ' ' || chr(9)) p from g),
m as (select group_id, p, min(p) over (partition by group_id) q from l where p <> ''),
e0 as (select trim(path_a, ' ' || chr(9)) a, trim(path_b, ' ' || chr(9)) b from match_pairs union all select p, q from m),
e as (select a, b from e0 where a <> '' and b <> '' and a <> b),
s as (select a, b from e union select b, a from e),
r(a, b) as (select distinct a, a from s union select r.a, s.b from r join s on r.b = s.a where s.b <> r.a)
select a path, min(b) group_path from r group by a
"""
