"""The whole run as one object: catalog, groups, selection, plan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keep
from ..operators import filters, groups, pairs, policy, report
from ..settings import Settings
from .runtime import cut


class DedupEngine:
    """Finds duplicates of a catalog: one row per file with path, name, ext, size, times, digests, flags and keep_score.

    A catalog without ``keep_score`` gets one from names and paths; ``match`` says how folder words are looked for.
    """

    def __init__(self, spark: SparkSession, settings: Settings = Settings()):
        self.spark, self.settings = spark, settings
        self.files: DataFrame | None = None
        self.members: DataFrame | None = None
        self.selection: DataFrame | None = None

    def catalog(self, files: DataFrame) -> DedupEngine:
        s = self.settings
        f = filters.excluding(filters.size_between(files, s.min_size, s.max_size), list(s.exclusions))
        self.files = filters.outside_system(f) if s.skip_system else f
        if "keep_score" not in files.columns:
            self.files = keep.with_keep_score(self.files, s.match)
        self.members = self.selection = None
        return self

    def groups(self) -> DataFrame:
        """Members of link, exact and near groups: ``(group_id, group_type, score, idx, ...file columns)``.

        ``paranoid`` keeps exact copies only if the whole content, or else the sha256_hash, proves them; ``semantic`` adds
        the likeness of embeddings to the score of near ones. A group is named by its kind and smallest path. Links are found first, exact copies among the rest, near ones
        among what then remains.
        """
        if self.files is None:
            raise ValueError("no catalog yet")
        if self.members is None:
            f = self.files
            link = self._of(f, ["device", "inode"], "hardlink", f.where(F.col("inode") > 0))
            rest = f.join(link.select("path"), "path", "left_anti")
            digests = ["size", "hash", "sha256_hash"] if self.settings.use_sha256 else ["size", "hash"]
            exact = self._of(rest, digests, "exact", rest.where(F.col("size") > 0))
            if self.settings.paranoid:
                # what can't be proved equal to the first file of its group is no copy of it, and no group of one is left
                proved = groups.verified(rest).where("verified").select("path")
                exact = exact.join(proved, "path", "left_semi")
                several = exact.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("group_id")
                exact = exact.join(several, "group_id", "left_semi").select("path", "group_id", "group_type", "score")
            found = link.unionByName(exact)
            if self.settings.near:
                rest = rest.join(exact.select("path"), "path", "left_anti")
                # validation counts every pair that reaches min_cluster_sim, also those too weak to form a cluster
                least = min(self.settings.min_score, math.ceil(100 * self.settings.min_cluster_sim))
                scored = cut(pairs.near_pairs(pairs.near_candidates(rest), least, semantic=self.settings.semantic))
                c = pairs.near_clusters(scored.where(F.col("score") >= self.settings.min_score))
                ok = pairs.validated(c, scored, self.settings.min_cluster_sim).where("valid").select("cluster")
                near = c.join(ok, "cluster", "left_semi").select("path", F.concat(F.lit("near:"), "cluster").alias("group_id"), F.lit("near").alias("group_type"), "score")
                found = found.unionByName(near)
            self.members = cut(found.join(f, "path").withColumn("idx", F.lit(0).cast("bigint")))
        return self.members

    def _of(self, files: DataFrame, keys: list[str], kind: str, among: DataFrame) -> DataFrame:
        g = among.dropna(subset=keys).groupBy(*keys).agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        return among.join(g, keys).select("path", F.concat(F.lit(f"{kind}:"), "first").alias("group_id"), F.lit(kind).alias("group_type"), F.lit(100).cast("bigint").alias("score"))

    def select(self) -> DataFrame:
        if self.selection is None:
            self.selection = cut(policy.selected(self.groups(), self.settings))
        return self.selection

    def mark(self, overrides: DataFrame) -> DataFrame:
        self.selection = cut(policy.overridden(self.select(), overrides))
        return self.selection

    def plan(self) -> DataFrame:
        return policy.deletion_plan(self.groups(), self.select())

    def summary(self) -> DataFrame:
        return report.summary(self.groups(), self.select())

    def totals(self) -> DataFrame:
        return groups.group_totals(self.groups())
