"""Totals and export tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import place_within


def summary(members: DataFrame, selection: DataFrame) -> DataFrame:
    """One row: groups, files, reclaimable bytes, groups by type, and files by mark."""
    per = members.join(selection.select("group_id", "path", "suggestion"), ["group_id", "path"], "left").groupBy("group_id", "group_type").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.coalesce("size", F.lit(0))) - F.max(F.coalesce("size", F.lit(0)))).alias("freed"),
        *[F.count_if(F.col("suggestion") == w).alias(w) for w in ("KEEP", "REVIEW", "DELETE")],
    )
    kind = lambda *t: F.count_if(F.col("group_type").isin(*t))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(F.count(F.lit(1)).alias("n_groups"), total("n").alias("n_files"), total("freed").alias("reclaimable_bytes"), kind("exact").alias("n_exact"), kind("near").alias("n_near"), kind("hardlink").alias("n_hardlink"), *[total(w).alias(f"n_{w.lower()}") for w in ("KEEP", "REVIEW", "DELETE")])


def rollup(members: DataFrame) -> DataFrame:
    """Files and bytes by group type and category, with subtotals; ``level`` tells them apart (0 detail, 1 type, 3 all)."""
    m = members.select(F.coalesce("group_type", F.lit("none")).alias("group_type"), F.coalesce("category", F.lit("none")).alias("category"), F.coalesce("size", F.lit(0)).alias("size"))
    return m.rollup("group_type", "category").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"))


def scan_stats(files: DataFrame, members: DataFrame) -> DataFrame:
    """One row: files, bytes, megabytes of the catalog, groups and files in groups."""
    f = files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
    g = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("total_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files_in_groups"))
    # one row each
    return f.withColumn("k", F.lit(1)).join(g.withColumn("k", F.lit(1)), "k").select("total_files", "total_bytes", F.round(F.col("total_bytes") / 1048576, 2).alias("total_mb"), "total_groups", "files_in_groups")


def plan_summary(plan: DataFrame) -> DataFrame:
    """Per permission and reason of a deletion plan: files and bytes."""
    return plan.groupBy("allowed", "reason").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def category_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(F.count(F.lit(1)).alias("n_files"))


def export_rows(members: DataFrame, selection: DataFrame) -> DataFrame:
    """One row per member as the CSV export has it; places count from 1 in the order of the stored index."""
    m = members.join(selection.select("group_id", "path", "suggestion"), ["group_id", "path"], "left")
    m = place_within(m.drop("parent"), ["group_id"], [F.col("idx").asc(), F.col("path").asc()], "file_index")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return m.select(F.col("group_id").alias("group"), F.col("group_type").alias("type"), "score", "file_index", F.coalesce("suggestion", F.lit("KEEP")).alias("suggestion"), F.coalesce("keep_score", F.lit(100)).alias("quality"), "path", F.coalesce("size", F.lit(0)).alias("size"), text("hash").alias("hash"), text("magic_type").alias("mime"))


def export_nested(rows: DataFrame) -> DataFrame:
    """``export_rows`` as one row per group with its files as an array, in order."""
    file = F.struct("file_index", "suggestion", "quality", "path", "size", "hash", "mime")
    g = rows.groupBy("group", "type", "score").agg(F.sort_array(F.collect_list(file)).alias("files"), (F.sum("size") - F.max("size")).alias("freed"))
    return g.select("group", "type", "score", F.when(F.size("files") < 2, 0).otherwise(F.col("freed")).cast("bigint").alias("reclaimable_bytes"), "files")
