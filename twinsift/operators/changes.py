"""Changes in a feed of file states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import previous


def changes(feed: DataFrame) -> DataFrame:
    """``(key, ts, seq, event)`` of a feed ``(key, ts, seq, op, digest)``: created, modified and deleted states.

    A state equal to the one before is no event. Deleting forgets: what comes next is created again. Deleting something
    unknown is no event, and neither is a state without a digest. Ties in time are ordered by ``seq``.
    """
    gone = F.col("op") == "delete"
    known = feed.where(F.col("key").isNotNull() & (gone | F.col("digest").isNotNull())).select("key", "ts", "seq", "op", F.when(~gone, F.col("digest")).alias("digest"))
    f = previous(known, ["key"], ["ts", "seq"], "digest", "before")
    event = F.when(gone & F.col("before").isNotNull(), "deleted").when(~gone & F.col("before").isNull(), "created").when(~gone & (F.col("before") != F.col("digest")), "modified")
    return f.withColumn("event", event).where(F.col("event").isNotNull()).select("key", "ts", "seq", "event")
