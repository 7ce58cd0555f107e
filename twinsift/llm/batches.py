"""Problem 2: new batches against everything accepted before, through an incremental inverted index."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.readings import digest_bytes
from ..operators.versions import current_files, latest
from ..plans.runtime import cut, remove, reset_jobs, scratch

#: Token kinds of a record, by how good a match on them is.
EXACT, NEAR = 0, 1


def tokens(records: DataFrame) -> DataFrame:
    """``(token, kind, file_id)``: the digests of a record as set elements. Missing digests and stand-ins are no token."""
    both = F.array(F.struct(F.lit(EXACT).alias("kind"), digest_bytes(F.col("hash")).alias("token")), F.struct(F.lit(NEAR).alias("kind"), digest_bytes(F.col("partial_hash")).alias("token")))
    return records.select("file_id", F.explode(both).alias("t")).select("t.token", "t.kind", "file_id").where(F.col("token").isNotNull())


def postings(tokens: DataFrame, old: bool) -> DataFrame:
    """One posting per token: its smallest file_id. Merged map-side, so a digest of a third of all rows stays one row a task.

    ``old`` marks accepted history, which counts as seen before everything, whatever its ids.
    """
    return tokens.groupBy("token", "kind").agg(F.min("file_id").alias("first_id")).select("token", "kind", F.lit(old).alias("old"), "first_id")


#: Appends after which the postings are merged: a bucket never has more files than this.
COMPACT_AFTER = 16
_POSTING = "token binary, kind int, old boolean, first_id bigint"
_META = "buckets int, version int, appends int, parts int, last bigint"


class BatchIndex:
    """An inverted index of accepted records, partitioned by token, that lives in a folder between runs.

    Records are sets of at most two tokens (hash and partial_hash) and match from an overlap of one on, so the prefix
    filter keeps n - 1 + 1 = n tokens: the prefix is the whole set, rarest first or not, and every size passes the length
    filter (sizes 1 and 2, overlap 1). What the rare-token order would cut is cut by merging: a posting list holds only
    the smallest id of a token, as only that can be a result.

    In ``root``, which all executors share: the postings, bucketed by token; a log of the batches' tokens, one part a
    batch; and what is known about both. Opening an index that is there reads none of its history: a batch is shuffled to
    the buckets and meets its postings there, which are neither shuffled nor sorted again. Appends add files to the
    buckets and are merged from time to time. A token may have one posting per append; probes take the minimum, so a batch
    that is taken twice, after a failure, changes nothing. Without ``root`` the index is a scratch one, removed by ``drop``.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None):
        self.spark, self.kept = spark, root is not None
        self.root = root or scratch(spark, "batch-index")
        self.table = f"twinsift_postings_{uuid.uuid4().hex}"
        known = self._known()
        #: Index partitions; the session's shuffle partitions unless given, as both follow the size of the data.
        self.buckets = known.buckets if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.appends, self.parts = (known.version, known.appends, known.parts) if known else (0, 0, 0)
        self.last: int | None = known.last if known else None  # largest id of any batch so far
        if self.appends:
            self._register()

    @property
    def empty(self) -> bool:
        """Whether nothing has been indexed yet."""
        return not self.appends

    def _known(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/about")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        # of two states, left by a failure between writing and removing, the later counts
        return self.spark.read.schema(_META).json(f"{self.root}/about").orderBy(F.desc("parts"), F.desc("version"), F.desc("appends")).first()

    def _save(self) -> None:
        """A small file written by the driver, without a job; the ones before it go when it is there."""
        where, new = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/about"), f"{uuid.uuid4().hex}.json"
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(where, new), True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "version": self.version, "appends": self.appends, "parts": self.parts, "last": self.last}) + "\n", "utf-8"))
        out.close()
        for f in fs.listStatus(where):
            if f.getPath().getName() != new:
                fs.delete(f.getPath(), True)

    def _path(self) -> str:
        return f"{self.root}/postings-{self.version}"

    def _register(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")
        self.spark.sql(f"create table {self.table} ({_POSTING}) using parquet clustered by (token) into {self.buckets} buckets location '{self._path()}'")

    def _append(self, firsts: DataFrame) -> None:
        firsts.repartition(self.buckets, "token").write.mode("append").format("parquet").bucketBy(self.buckets, "token").option("path", self._path()).saveAsTable(self.table)
        self.appends += 1

    def _log(self, parts: list[int]) -> DataFrame:
        return self.spark.read.schema("token binary, kind int, file_id bigint").parquet(*[f"{self.root}/log/{k}" for k in parts])

    def load_history(self, records: DataFrame) -> None:
        """Index the accepted records; done once in the life of an index."""
        self._append(postings(tokens(records), True))
        self._save()

    def compact(self) -> None:
        """Merge the postings of all appends into one per token, bucket by bucket, without a shuffle."""
        merged = self.spark.table(self.table).groupBy("token", "kind", "old").agg(F.min("first_id").alias("first_id")).select("token", "kind", "old", "first_id")
        before, table = self._path(), self.table
        self.version, self.appends, self.table = self.version + 1, 0, f"twinsift_postings_{uuid.uuid4().hex}"
        self._append(merged)
        self._save()
        self.spark.sql(f"drop table if exists {table}")
        remove(self.spark, before)

    def take(self, batch: DataFrame, low: int, high: int) -> DataFrame:
        """Probe a batch, append it, and return ``(file_id, kind, match_id)`` for whatever its arrival settles.

        Besides the batch's own records these are earlier ones: a record that arrives late, with a smaller file_id than
        records already judged, counts as seen before them. ``low`` and ``high`` are the batch's smallest and largest
        file_id; earlier batches are looked at only if they can hold a larger id than ``low``. The result is written, so
        that neither the index nor a plan over all batches is needed to read it later.
        """
        part = self.parts
        tokens(batch).write.mode("overwrite").parquet(f"{self.root}/log/{part}")
        new = postings(self._log([part]), False)
        # the batch is the build side: each bucket of the index streams past the batch's tokens of that bucket, unsorted
        old = self.spark.table(self.table).join(new.select("token", "kind").hint("shuffle_hash"), ["token", "kind"]) if self.appends else new.limit(0)
        firsts = cut(new.unionByName(old).groupBy("token", "kind", "old").agg(F.min("first_id").alias("first_id")))
        self._append(firsts.where(~F.col("old")))
        hits = self._log([part]).join(firsts, ["token", "kind"])
        if part and self.last is not None and low < self.last:
            hits = hits.unionByName(self._log([*range(part)]).join(firsts.where(~F.col("old") & (F.col("first_id") < F.lit(self.last))), ["token", "kind"]))
        found = hits.where(F.col("old") | (F.col("first_id") < F.col("file_id"))).select("file_id", "kind", F.col("first_id").alias("match_id"))
        found = found.groupBy("file_id").agg(F.min(F.struct("kind", "match_id")).alias("m")).select("file_id", "m.kind", "m.match_id")
        found.write.mode("overwrite").parquet(f"{self.root}/found/{part}")
        self.parts, self.last = part + 1, high if self.last is None else max(self.last, high)
        self._save()
        if self.appends > COMPACT_AFTER:
            self.compact()
        return self.found([part])

    def found(self, parts: list[int]) -> DataFrame:
        return self.spark.read.schema("file_id bigint, kind int, match_id bigint").parquet(*[f"{self.root}/found/{k}" for k in parts])

    def drop(self) -> None:
        """Forget the table of this session, and a scratch index altogether."""
        self.spark.sql(f"drop table if exists {self.table}")
        if not self.kept:
            remove(self.spark, self.root)


def match_batches(index: BatchIndex, incoming: DataFrame) -> DataFrame:
    """``(match_id, file_id, match_kind)`` of what the batches of ``incoming`` settle, which the index accepts one after the other.

    ``exact``: something seen before has the same hash; else ``near``: the same partial_hash. match_id is the smallest
    file_id of those that match in that way. Batches are taken in the order of batch_no, those without a number first; a
    record delivered again is judged again with the same outcome. Records without a file_id give no row. A record of an
    earlier run has a row if a late record of these batches counts as seen before it.
    """
    spark, first = incoming.sparkSession, index.parts
    inbox = incoming.where(F.col("file_id").isNotNull()).select("file_id", "batch_no", "hash", "partial_hash", "received_at")
    try:
        # one row per batch: a list of batch numbers with their id ranges
        runs = inbox.groupBy("batch_no").agg(F.min("file_id").alias("low"), F.max("file_id").alias("high")).collect()
        for run in sorted(runs, key=lambda r: (r.batch_no is not None, r.batch_no or 0)):
            reset_jobs(spark, f"batch index: batch {run.batch_no}")
            batch = latest(inbox.where(F.col("batch_no").eqNullSafe(F.lit(run.batch_no))), "file_id", "received_at", ["file_id", "hash", "partial_hash", "received_at"])
            index.take(batch, run.low, run.high)
    finally:
        reset_jobs(spark, "")
    if index.parts == first:
        return inbox.select(F.col("file_id").alias("match_id"), "file_id", F.lit("exact").alias("match_kind")).where(F.lit(False))
    best = index.found([*range(first, index.parts)]).groupBy("file_id").agg(F.min(F.struct("kind", "match_id")).alias("m"))
    kind = F.when(F.col("m.kind") == EXACT, F.lit("exact")).otherwise(F.lit("near"))
    return best.select(F.col("m.match_id").alias("match_id"), "file_id", kind.alias("match_kind"))


def batch_matches(incoming: DataFrame, files: DataFrame, buckets: int | None = None, root: str | None = None) -> DataFrame:
    """``match_batches`` with the current ``file_records`` rows as history.

    ``root`` names an index to keep: the first run indexes the history, later ones don't look at ``files`` any more.
    """
    spark = incoming.sparkSession
    index = BatchIndex(spark, root, buckets)
    try:
        if index.empty:
            reset_jobs(spark, "batch index: history")
            index.load_history(current_files(files, "hash", "partial_hash", "scanned_at"))
        return cut(match_batches(index, incoming))
    finally:
        reset_jobs(spark, "")
        index.drop()


BATCH_SQL = r"""
with d as (select true old, file_id, hash h, partial_hash p from (select *, row_number() over (partition by file_id order by scanned_at desc) rn from file_records) where rn = 1
  union all select distinct false, file_id, hash, partial_hash from incoming_files),
t as (select old, file_id, regexp_extract(lower(replace(h, '-', '')), '(^|[^0-9a-f])([0-9a-f]{32})($|[^0-9a-f])', 2) h,
  regexp_extract(lower(replace(p, '-', '')), '(^|[^0-9a-f])([0-9a-f]{32})($|[^0-9a-f])', 2) p from d),
k as (select old, file_id, case when h <> repeat(left(h, 1), 32) then h end h, case when p <> repeat(left(p, 1), 32) then p end p from t),
a as (select old, file_id, h, p, min(file_id) filter (old) over (partition by h) oh, min(file_id) filter (not old) over (partition by h) nh,
  min(file_id) filter (old) over (partition by p) op, min(file_id) filter (not old) over (partition by p) np from k),
i as (select distinct file_id, case when h is not null then least(oh, case when nh < file_id then nh end) end eh, case when p is not null then least(op, case when np < file_id then np end) end ep
  from a where not old)
select coalesce(min(eh), min(ep)) match_id, file_id, case when min(eh) is not null then 'exact' else 'near' end match_kind
from i group by file_id having coalesce(min(eh), min(ep)) is not null
"""
