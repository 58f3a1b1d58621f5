"""The dataflow over a stream of records.

Each micro-batch joins its rows, and the rows that earlier batches left open, with the transaction ends that it holds.
What is committed goes through ``operators.dataflow``, the same code as for tables: versions, refused changes, chunks
of large values and truncates are appended. Aborted rows go, a TRUNCATE of an aborted transaction or savepoint too; the
rest is carried forward as the next batch's open rows (a prepared transaction stays open until its second phase).

All is computed before anything is published; a batch becomes visible when the manifest that names it is written. Run
again after a failure, a batch starts from the same manifest and writes the same folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dataflow as D
from ..operators import transactions as X
from ..operators.ddl import Column
from ..sources.segments import RECORD_SCHEMA, Manifest
from ..sources.shared import Scratch, delete
from ..sources.sinks import append

_CHANGES = [x.split()[0] for x in "lsn, tuple_idx, xid, db, rel, op, blkno, offnum, natts, new, old, large, partial".split(", ")]


class RefusedTransactions(ValueError):
    """A batch holds transactions that can't be applied, and nothing of it is published."""


class ChangeApplier:
    """Keeps ``root``: folders ``versions``, ``truncates``, ``refused``, ``chunks`` and ``open`` of a batch each, and a manifest.

    timelines: what to look up in, or what gives it for a batch. ``strict`` fails a batch that has a refused transaction
    (X10, X11); else such a transaction is set aside whole in ``refused``.
    """

    def __init__(self, spark: SparkSession, root: str, timelines: D.Timelines | Callable[[], D.Timelines], *, strict: bool = False):
        self.spark, self.root, self.strict = spark, root.rstrip("/"), strict
        self.timelines = timelines if callable(timelines) else lambda: timelines
        self.manifest = Manifest(f"{self.root}/manifest")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        state = self.manifest.read()
        last = state.get("batch", -1)
        if last >= batch_id:
            return  # published before a failure
        batch, scratch = batch.persist(), Scratch(self.spark)
        try:
            fresh = batch.filter("kind = 'row'").select(*_CHANGES)
            rows = fresh if last < 0 else fresh.unionByName(self._at("open", last, D.CHANGES))
            ends = batch.filter("kind = 'end'").select("lsn", "xid", "outcome", "twophase_xid", "subxids", "rolled_back", "ts_us")
            rows, ends, done = D.with_outcomes(rows, ends)
            timelines = self.timelines()
            store = self._published("chunks", D.CHUNKS) if timelines.chunk_rels is not None else None
            flow = D.flow(done, timelines, store, scratch)
            append(flow.refused, f"{self.root}/refused", batch_id)
            if self.strict and (n := self._at("refused", batch_id, D.REFUSED).select("top_xid").distinct().count()):
                raise RefusedTransactions(f"batch {batch_id} has {n} transactions that can't be applied")
            append(flow.versions, f"{self.root}/versions", batch_id)
            append(flow.truncates, f"{self.root}/truncates", batch_id)
            if flow.chunks is not None:
                append(flow.chunks, f"{self.root}/chunks", batch_id)
            append(X.open_changes(rows, ends).select(*_CHANGES), f"{self.root}/open", batch_id)
            top = batch.agg(F.max("lsn")).first()[0]
            first_open = self._at("open", batch_id, D.CHANGES).agg(F.min("lsn")).first()[0]
        finally:
            batch.unpersist()
            scratch.drop()
        ack = max(state.get("ack", 0), top or 0)
        self.manifest.write({"batch": batch_id, "ack": ack, "floor": min(ack, first_open if first_open is not None else ack)})
        if last >= 0:
            delete(self.spark, f"{self.root}/open/batch={last}")  # carried on

    def _at(self, what: str, batch_id: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{what}/batch={batch_id}")

    def _published(self, what: str, schema: str) -> DataFrame:
        """Rows of published batches; others are pruned by their folder."""
        last = self.manifest.read().get("batch", -1)
        if last < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.root}/{what}").filter(F.col("batch") <= last).drop("batch")

    def versions(self) -> DataFrame:
        """All committed versions that no later truncate of their relation covers."""
        return X.truncated(self._published("versions", D.VERSIONS), self._published("truncates", "rel bigint, lsn bigint"))

    def refused(self) -> DataFrame:
        return self._published("refused", D.REFUSED)

    def state(self, columns: Sequence[Column], keys: Sequence[str], target: str | None = None, *, soft_delete: bool = False) -> DataFrame:
        """The latest state of each key of a target."""
        return D.state(self._published("versions", D.VERSIONS), self._published("truncates", "rel bigint, lsn bigint"), columns, keys, target, soft_delete=soft_delete)

    def start(self, records: DataFrame, checkpoint: str, *, interval: str | None = None) -> StreamingQuery:
        """Apply a stream of records: all that is there, or with ``interval`` on and on (T4)."""
        writer = records.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
        return writer.start()


def stream(spark: SparkSession, path: str, *, most_files: int | None = None) -> DataFrame:
    """Segment files as a stream by Spark's own file source, in the order of their names' arrival."""
    reader = spark.readStream.schema(RECORD_SCHEMA)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).parquet(path)
