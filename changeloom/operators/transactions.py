"""Transactions: trees of subtransactions, outcomes, order of changes (X*, J7, J8, O1, A20, A21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_top_xid(changes: DataFrame, tree: DataFrame) -> DataFrame:
    """J7, X2. ``top_xid`` of each change by ``tree`` (subxid, top_xid); a writer that the tree lacks is its own top."""
    links = tree.select(F.col("subxid").alias("xid"), F.col("top_xid").alias("_top"))
    return changes.join(links, "xid", "left").withColumn("top_xid", F.coalesce("_top", "xid")).drop("_top")


def tree_of(ends: DataFrame) -> DataFrame:
    """The tree (subxid, top_xid) that transaction ends list; a prepared transaction ends under its own xid."""
    top = F.coalesce("twophase_xid", "xid") if "twophase_xid" in ends.columns else F.col("xid")
    return ends.select(F.explode("subxids").alias("subxid"), top.alias("top_xid"))


def with_top_of_ends(ends: DataFrame) -> DataFrame:
    """X5. Ends with ``top_xid``: the xid of a prepared transaction where one is named, else the end's own. Preparing ends nothing."""
    top = F.coalesce("twophase_xid", "xid") if "twophase_xid" in ends.columns else F.col("xid")
    return ends.filter(F.col("outcome").isin("commit", "abort")).withColumn("top_xid", top)


def committed(changes: DataFrame, ends: DataFrame, aborted_subxids: DataFrame | None = None) -> DataFrame:
    """J8, X3, X4. Changes of committed transactions with ``commit_lsn`` and ``commit_ts``.

    changes: ``xid, top_xid, ...``; ends: ``top_xid, outcome, commit_lsn, commit_ts``; ``aborted_subxids`` (xid): savepoints
    rolled back inside a transaction that may have committed. Open transactions give nothing. One shuffle by top_xid; the
    savepoints are an anti join on the writer.
    """
    done = ends.filter("outcome = 'commit'").select("top_xid", "commit_lsn", "commit_ts")
    kept = changes if aborted_subxids is None else changes.join(aborted_subxids.select("xid"), "xid", "left_anti")
    return kept.join(done, "top_xid")


def discarded(changes: DataFrame, ends: DataFrame, aborted_subxids: DataFrame | None = None) -> DataFrame:
    """X4. Changes that an abort or a rolled-back savepoint takes away."""
    aborted = ends.filter("outcome = 'abort'").select("top_xid")
    whole = changes.join(aborted, "top_xid", "left_semi")
    if aborted_subxids is None:
        return whole
    parts = changes.join(aborted, "top_xid", "left_anti").join(aborted_subxids.select("xid"), "xid", "left_semi")
    return whole.unionByName(parts.select(*whole.columns))


def open_changes(changes: DataFrame, ends: DataFrame) -> DataFrame:
    """X1. Changes whose transaction has not ended."""
    return changes.join(ends.select("top_xid"), "top_xid", "left_anti")


def merge_order(changes: DataFrame, events: DataFrame) -> DataFrame:
    """O1, O2. Rows and control events of each transaction in one order, as ``position`` from 1.

    A transaction is sorted by one task, with spills; its order is that of a log which one process wrote. Both have ``top_xid, lsn, tuple_idx``; an event goes before rows of its lsn, rows of one lsn keep their tuple order.
    """
    from pyspark.sql import Window

    rows = changes.withColumn("is_event", F.lit(False)).unionByName(events.withColumn("is_event", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("top_xid").orderBy("lsn", F.desc("is_event"), "tuple_idx")
    return rows.withColumn("position", F.row_number().over(order))


def segments(ordered: DataFrame) -> DataFrame:
    """O3, B1. ``segment`` of each row: how many barriers (events) of its transaction went before it."""
    from pyspark.sql import Window

    upto = Window.partitionBy("top_xid").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumn("segment", F.sum(F.col("is_event").cast("int")).over(upto))


def inflight_snapshot(changes: DataFrame, ends: DataFrame) -> DataFrame:
    """A21. Each open transaction's first and last lsn, rows and relations."""
    return open_changes(changes, ends).groupBy("top_xid").agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("rel").alias("n_relations"))


def largest_transaction(changes: DataFrame, size: Column) -> DataFrame:
    """A20, O5. The transaction with the most bytes, the smallest xid of equals: two-stage top 1, no full sort."""
    return changes.groupBy("top_xid").agg(F.sum(size).alias("bytes")).orderBy(F.desc("bytes"), "top_xid").limit(1)


def foreign_rows(changes: DataFrame, tree: DataFrame) -> DataFrame:
    """X7. Changes whose writer is neither their transaction's top nor listed under it; there should be none."""
    listed = tree.select(F.col("subxid").alias("xid"), "top_xid")
    return changes.filter("xid != top_xid").join(listed, ["xid", "top_xid"], "left_anti")


def truncates(done: DataFrame) -> DataFrame:
    """B2. (rel, lsn) of TRUNCATEs (op T) among committed changes; one of an aborted transaction or savepoint is not there."""
    return done.filter("op = 'T'").select("rel", "lsn")


def truncated(changes: DataFrame, truncates: DataFrame) -> DataFrame:
    """B2. Without rows of a relation that a later TRUNCATE of it (rel, lsn) emptied.

    TRUNCATE locks its relation, so rows before it in the log are of transactions that ended before, or of its own.
    """
    last = truncates.groupBy("rel").agg(F.max("lsn").alias("_cut"))
    return changes.join(last, "rel", "left").filter("_cut IS NULL OR lsn >= _cut").drop("_cut")
