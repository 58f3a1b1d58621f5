"""Queries of the whole dataflow, over tables and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import dataflow
from ..operators import values as V
from ..operators.ddl import Column
from ..sources.segments import RECORD_SCHEMA
from ..sources.shared import new_path
from ..streaming.apply import ChangeApplier, stream
from . import fixtures as fx
from .registry import query

COLUMNS = (Column(1, "k", "bigint", False), Column(2, "val", "double"), Column(3, "kind", "string"), Column(4, "body", "string"))


@query("e2e_destination_rows", fx.FLOW + "SELECT target, user_id AS k, val, kind, body, lsn AS _lsn, xid AS _xid, commit_ts AS _commit_ts, op = 'D' AS _is_deleted FROM kept")
def destination_rows(spark: SparkSession, d: str) -> DataFrame:
    """All committed, routed and whole transactions, decoded under the schema in force, large values filled in."""
    rows = dataflow.destination(fx.flow(spark, d).versions, COLUMNS)
    return rows.select(F.col("_target").alias("target"), "k", "val", "kind", F.md5("body").alias("body"), "_lsn", "_xid", "_commit_ts", "_is_deleted")


_STATE = fx.FLOW + ", alive AS (SELECT kept.* FROM kept LEFT JOIN cut ON cut.rel = kept.rel WHERE cut IS NULL OR lsn >= cut), r AS (SELECT *, row_number() OVER (PARTITION BY target, user_id ORDER BY lsn DESC) AS rn FROM alive) SELECT target, user_id AS k, val, kind, body, lsn AS _lsn FROM r WHERE rn = 1 AND op <> 'D'"


@query("e2e_latest_state", _STATE)
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    flow = fx.flow(spark, d)
    rows = dataflow.state(flow.versions, flow.truncates, COLUMNS, ["k"])
    return rows.select(F.col("_target").alias("target"), "k", "val", "kind", F.md5("body").alias("body"), "_lsn")


@query("e2e_refused", fx.FLOW + "SELECT top + 10000000 AS top_xid, lsn, verdict FROM ju WHERE top IN (SELECT top FROM bad)")
def refused(spark: SparkSession, d: str) -> DataFrame:
    """Transactions of which one change can't be applied, whole."""
    return fx.flow(spark, d).refused.select("top_xid", "lsn", "verdict")


@query("e2e_unmapped", fx.FLOW + "SELECT rel, count(*) AS n FROM rt WHERE target IS NULL GROUP BY rel")
def unmapped(spark: SparkSession, d: str) -> DataFrame:
    return fx.flow(spark, d).unmapped


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Changes and ends as stream records."""
    rows, ends = fx.flow_changes(spark, d).withColumn("kind", F.lit("row")), fx.flow_ends(spark, d).withColumn("kind", F.lit("end"))
    both = rows.unionByName(ends, allowMissingColumns=True)
    return both.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(RECORD_SCHEMA)])


@query("t4_stream_state", _STATE)
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """The latest state once more, from a stream of record files in three runs of a micro-batch each, through ``ChangeApplier``."""
    path, root, checkpoint = (new_path(spark, what) for what in ("records", "applied", "stream"))
    records = _records(spark, d)
    low, high = records.agg(F.expr("percentile_approx(lsn, array(0.3, 0.7))")).first()[0]
    applier = ChangeApplier(spark, root, lambda: fx.flow_timelines(spark, d))
    for part in (F.col("lsn") < low, (F.col("lsn") >= low) & (F.col("lsn") < high), F.col("lsn") >= high):
        records.filter(part).write.mode("append").parquet(path)  # as many files as tasks; the next micro-batch takes all that are new
        applier.start(stream(spark, path), checkpoint).awaitTermination()
    return applier.state(COLUMNS, ["k"]).select(F.col("_target").alias("target"), "k", "val", "kind", F.md5("body").alias("body"), "_lsn")


_CHUNK_CHANGES = fx.LOG.rstrip() + ", cc AS (SELECT lsn, rel, op, k % 9 AS blkno, CAST(lsn // 16 % 5 AS INT) AS offnum, CASE WHEN lsn % 112 = 0 THEN NULL ELSE 'x' || k END AS body FROM log) "


@query("v1_chunk_recognition", _CHUNK_CHANGES + "SELECT rel AS relid, blkno, offnum, CASE WHEN op = 'I' THEN lsn END AS chunk_id, CAST(CASE WHEN op = 'I' THEN offnum END AS INT) AS seq, CASE WHEN op = 'I' THEN body END AS body, lsn, op = 'D' AS is_deleted FROM cc WHERE rel IN (1, 2) AND (op = 'D' OR (op = 'I' AND body IS NOT NULL))")
def chunk_recognition(spark: SparkSession, d: str) -> DataFrame:
    """Changes of two relations taken as chunk relations."""
    off = (F.expr("lsn div 16") % 5).cast("int")
    body = F.when(F.col("lsn") % 112 != 0, F.concat(F.lit("x"), F.col("k").cast("string")))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    new = F.map_from_entries(F.array(entry(1, F.col("lsn").cast("string")), entry(2, off.cast("string")), entry(3, body)))
    rows = fx.log(spark, d).select("lsn", "rel", "op", (F.col("k") % 9).alias("blkno"), off.alias("offnum"), F.when(F.col("op") != "D", new).alias("new"))
    return V.chunk_rows(rows, fx.values(spark, [(1,), (2,)], "rel long"))[0]
