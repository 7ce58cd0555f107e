"""Lineage cuts and scratch space in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: ``spark.checkpoint.dir`` of the session, or the context's checkpoint folder.

    Only a local master without either gets a temporary folder (tests); on a cluster a missing setting is an error,
    since a folder of one machine would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    there = sc.getCheckpointDir()
    if there is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="twinsift-"))
        there = sc.getCheckpointDir()
    return there.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder: its lineage ends there and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; a path that is gone already is fine."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Tables of an iterative operator in the shared folder, removed with the workspace.

    Written tables carry nothing of the plans that made them. ``checkpoint`` keeps the constraints of its plan, which
    multiply when every round joins the tables of the round before; so rounds write, and only results are checkpointed.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.made = spark, scratch(spark, label), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)


def reset_jobs(spark: SparkSession, text: str) -> None:
    """Name the following jobs, so that the rounds of an iterative operator can be told apart in the UI."""
    spark.sparkContext.setJobDescription(text)
