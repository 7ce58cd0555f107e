"""Saved sessions and the deletion log: tables of their own, read with their schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"
LOG = "ts double, path string, success boolean, error string"


def save_session(members: DataFrame, selection: DataFrame, folder: str, **about) -> None:
    """Members with their marks, and one row about the session. Nothing of a member is lost."""
    spark = members.sparkSession
    members.join(selection.select("group_id", "path", "suggestion"), ["group_id", "path"], "left").write.mode("overwrite").parquet(f"{folder}/members")
    spark.createDataFrame([(VERSION, json.dumps(about, sort_keys=True))], "version string, about string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/session")


def load_session(spark: SparkSession, folder: str) -> tuple[DataFrame, dict] | None:
    """(members with marks, what was said about the session), or None if it is of another version or can't be read."""
    try:
        head = spark.read.schema("version string, about string").parquet(f"{folder}/session").first()
        if head is None or head.version != VERSION:
            return None
        return spark.read.parquet(f"{folder}/members"), json.loads(head.about)
    except Exception:  # noqa: BLE001 - an unreadable session is no session
        return None


def append_log(entries: DataFrame, folder: str) -> None:
    entries.select("ts", "path", "success", "error").write.mode("append").json(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log, newest first; empty if there is none. Lines that aren't entries are skipped."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(folder).where(F.col("path").isNotNull()).orderBy(F.desc("ts"), "path")


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(folder)


def write_json(nested: DataFrame, folder: str) -> None:
    nested.write.mode("overwrite").json(folder)


def _escaped(c):
    t = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def html_rows(rows: DataFrame) -> DataFrame:
    """One HTML table row per exported row, escaped, digests cut to 20 characters; the class is the mark."""
    cells = ["group", "type", "score", "file_index", "suggestion", "quality", "path", "size", "hash", "mime"]
    td = F.concat(*[F.concat(F.lit("<td>"), _escaped(F.left(F.col(c), F.lit(20)) if c == "hash" else F.col(c)), F.lit("</td>")) for c in cells])
    return rows.select("group", "file_index", F.concat(F.lit('<tr class="'), F.lower(_escaped(F.col("suggestion"))), F.lit('">'), td, F.lit("</tr>")).alias("value"))


def text_rows(rows: DataFrame) -> DataFrame:
    """One line per exported row of the text report; all three marks are told apart, digests cut to 48 characters."""
    return rows.select("group", "file_index", F.format_string("[%s] %s/%d %s (%d bytes) %s", "suggestion", "group", "file_index", "path", "size", F.left("hash", F.lit(48))).alias("value"))


def write_lines(lines: DataFrame, folder: str) -> None:
    """Lines in report order, as text files whose names keep that order."""
    lines.orderBy("group", "file_index").select("value").write.mode("overwrite").text(folder)
