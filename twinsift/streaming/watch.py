"""The same changes on a stream, and new files against known digests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "key string, ts timestamp, seq bigint, event string"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = state.get[0] if state.exists else None
    for b in batches:
        out = []
        for r in b.sort_values(["ts", "seq"]).itertuples(index=False):
            if r.op == "delete":
                if before is not None:
                    out.append((key[0], r.ts, r.seq, "deleted"))
                before = None
            elif before != r.digest:
                out.append((key[0], r.ts, r.seq, "created" if before is None else "modified"))
                before = r.digest
        yield pd.DataFrame(out, columns=["key", "ts", "seq", "event"])
    if before is None:
        if state.exists:
            state.remove()
    else:
        state.update((before,))


def watch(feed: DataFrame) -> DataFrame:
    """Changes of a stream ``(key, ts, seq, op, digest)``. State is one digest per living key; rows of a micro-batch are ordered by time."""
    known = (F.col("op") == "delete") | F.col("digest").isNotNull()
    return feed.where(F.col("key").isNotNull() & known).select("key", "ts", "seq", "op", "digest").groupBy("key").applyInPandasWithState(_step, CHANGE, "digest string", "append", GroupStateTimeout.NoTimeout)


def stream_exact(feed: DataFrame, known: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """First deliveries of a stream of ``(key, ts, digest)`` joined to known files ``(path, digest)`` of equal content.

    Repeated deliveries within the watermark are dropped, so the state is bounded by it.
    """
    first = feed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["key", "digest"])
    return first.join(known.select("path", "digest"), "digest").select("key", "ts", "digest", "path")
