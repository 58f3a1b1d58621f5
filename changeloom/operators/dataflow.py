"""The whole way from committed changes to destination rows, the same for a table and for a stream.

Scope, truncates, chunks of large values, routes in force at the commit, schemas in force at the change, verdicts on whole
transactions, large values, and values by column number; ``destination`` makes a target's typed rows of those.

A change's values are a map of attnum to text: a key that is not there is absent, a NULL value is NULL. Values that
are stored out of line are in ``large`` instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from . import records, routing, timeline, transactions, values
from .ddl import Column as TargetColumn
from .versions import latest_state

POINTER = "struct<relid: bigint, chunk_id: bigint, raw_size: bigint, stored_size: bigint>"
#: ``natts``: how many attributes the row has in its page; those behind read their default.
CHANGES = f"lsn bigint, tuple_idx int, xid bigint, db bigint, rel bigint, op string, blkno bigint, offnum int, natts int, new map<int, string>, old map<int, string>, large map<int, {POINTER}>, partial boolean"
ENDS = "lsn bigint, xid bigint, outcome string, twophase_xid bigint, subxids array<bigint>, rolled_back array<bigint>, ts_us bigint"
ATTRIBUTES = "array<struct<attnum: int, name: string, type: string, not_null: boolean, dropped: boolean, missing: string>>"
VERSIONS = "target string, rel bigint, lsn bigint, tuple_idx int, xid bigint, op string, commit_lsn bigint, commit_ts bigint, values map<int, string>"
VERSION_COLUMNS = ("target", "rel", "lsn", "tuple_idx", "xid", "op", "commit_lsn", "commit_ts")
REFUSED = "top_xid bigint, rel bigint, lsn bigint, tuple_idx int, op string, verdict string"
CHUNKS = "relid bigint, blkno bigint, offnum int, chunk_id bigint, seq int, body string, lsn bigint, is_deleted boolean"


@dataclass(frozen=True)
class Timelines:
    """What changes are looked up in.

    schemas: ``rel, valid_from, kind, attributes``; routes: ``rel, valid_from, target``; pending (shapes of open transactions):
    ``rel, top_xid, valid_from, attributes``; ambiguous: ``scope`` (rel or db), ``key, from_lsn, through_lsn``; chunk_rels: ``rel``;
    store: CHUNKS that are there from before; ``mirror``: whether large values are looked up there at all (V4).
    """

    schemas: DataFrame
    routes: DataFrame
    pending: DataFrame | None = None
    ambiguous: DataFrame | None = None
    chunk_rels: DataFrame | None = None
    store: DataFrame | None = None
    target_db: int | None = None
    mirror: bool = True


@dataclass(frozen=True)
class Flow:
    """``versions`` to append, ``refused`` changes (X10), ``unmapped`` counts (F11), ``truncates`` (rel, lsn) and ``chunks`` to append."""

    versions: DataFrame
    refused: DataFrame
    unmapped: DataFrame
    truncates: DataFrame
    chunks: DataFrame | None


def with_outcomes(changes: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J7, J8, X2-X5. All changes with ``top_xid``, the ends by top_xid, and the changes that are committed, with commit_lsn and commit_ts."""
    own = transactions.with_top_of_ends(ends).dropDuplicates(["top_xid"])
    rows = transactions.with_top_xid(changes, own.select(F.explode("subxids").alias("subxid"), "top_xid"))
    lost = own.select(F.explode("rolled_back").alias("xid"))
    own = own.select("top_xid", "outcome", F.col("lsn").alias("commit_lsn"), F.col("ts_us").alias("commit_ts"))
    return rows, own, transactions.committed(rows, own, lost)


def _shaped(rows: DataFrame, t: Timelines) -> DataFrame:
    """J1, J5, X9. Rows with the ``attributes`` they were written under: their own transaction's shape, else the committed one; NULL without any."""
    rows = timeline.asof(rows, t.schemas.select("rel", "valid_from", "kind", "attributes"), ["rel"]).drop("valid_from", "valid_to")
    committed = F.when(F.col("kind") == "Present", F.col("attributes"))
    if t.pending is None:
        return rows.withColumn("attributes", committed).drop("kind")
    own = t.pending.select("rel", "top_xid", "valid_from", F.col("attributes").alias("_own"))
    rows = timeline.asof(rows, own, ["rel", "top_xid"]).drop("valid_from", "valid_to")
    return rows.withColumn("attributes", F.coalesce("_own", committed)).drop("kind", "_own")


def _with_large(rows: DataFrame, chunks: DataFrame | None, store: DataFrame | None, mirror: bool, scratch: Scratch) -> DataFrame:
    """J13, J14, V2-V5. Rows with ``filled``, the values of their pointers by attnum, and ``large_error``, why one can't be had."""
    key = ["lsn", "tuple_idx"]
    pointers = rows.filter(F.size("large") > 0).select(*key, "top_xid", F.explode("large").alias("attnum", "p")).select(*key, "top_xid", "attnum", "p.relid", "p.chunk_id", "p.stored_size", F.col("lsn").alias("at"))
    pointers = scratch.write(pointers, "pointers")
    nothing = F.lit(None).cast("string")
    found = pointers.withColumns({"own_status": nothing, "own_value": nothing, "status": nothing, "value": nothing})
    if chunks is not None:
        own = values.fetch_in_transaction(chunks, pointers).withColumnsRenamed({"status": "own_status", "value": "own_value"})
        found = found.drop("own_status", "own_value").join(own, ["top_xid", "relid", "chunk_id", "stored_size"], "left")
    if store is not None:
        fetched = values.fetch_asof(store, pointers)
        found = found.drop("status", "value").join(fetched, ["relid", "chunk_id", "stored_size", "at"], "left")
    status = F.coalesce("own_status", "status", F.lit("Missing"))
    outcome = values.miss_policy(F.lit(mirror), F.col("own_status").isNotNull(), status, F.lit(store is not None))
    found = found.select(*key, "attnum", F.coalesce("own_value", "value").alias("value"), outcome.alias("outcome"))
    by_row = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("attnum", "value"))).alias("filled"), F.min(F.when(F.col("outcome").startswith("error"), F.col("outcome"))).alias("large_error"))
    return rows.join(by_row, key, "left")


def flow(done: DataFrame, t: Timelines, store: DataFrame | None = None, scratch: Scratch | None = None) -> Flow:
    """Committed changes (CHANGES with ``top_xid, commit_lsn, commit_ts``) as versions; ``store``: more chunks, of earlier batches.

    (lsn, tuple_idx) is unique. A transaction with one change that can't be applied is refused whole. What several steps
    read is written to the shared folder once: the committed changes, their pointers, and the changes with their verdicts.
    """
    scratch = scratch or Scratch(done.sparkSession)
    rows = done if t.target_db is None else done.filter(records.in_scope(t.target_db))
    rows = scratch.write(rows, "committed")
    cut, rows, chunks = transactions.truncates(rows), rows.filter("op != 'T'"), None
    own_chunks = None
    store = t.store if store is None else store if t.store is None else t.store.unionByName(store)
    if t.chunk_rels is not None:
        chunks, others = values.chunk_rows(rows, t.chunk_rels)
        own_chunks = chunks.filter("NOT is_deleted").join(rows.select("lsn", "top_xid").distinct(), "lsn")
        store = chunks if store is None else store.unionByName(chunks)
        rows = others
    routed = timeline.asof(rows, t.routes.select("rel", "valid_from", "target"), ["rel"], at="commit_lsn").drop("valid_from", "valid_to")
    unmapped = routed.filter("target IS NULL").groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
    rows = _with_large(_shaped(routed.filter("target IS NOT NULL"), t), own_chunks, store, t.mirror, scratch)
    rows = timeline.with_inside(rows, t.ambiguous, {"rel": "rel", "db": "db"}, "ambiguous") if t.ambiguous is not None else rows.withColumn("ambiguous", F.lit(False))
    flags = {
        "image_only": F.lit(False),
        "malformed": F.when(F.col("op") == "D", F.col("old").isNull()).otherwise(F.col("new").isNull()),
        "supported": F.col("op").isin("I", "U", "H", "D"),
        "shape": F.col("attributes"),
        "partial": F.coalesce("partial", F.lit(False)),
        "generation_complete": F.lit(True),
    }
    rows = rows.withColumns(flags)
    verdict = records.verdict()
    rows = rows.withColumn("verdict", F.when((verdict == "apply") & F.col("large_error").isNotNull(), F.col("large_error")).otherwise(verdict))
    rows = scratch.write(rows.select(*VERSION_COLUMNS, "top_xid", "attributes", "natts", "new", "old", "filled", "verdict"), "judged")
    kept, refused = records.split_refused(rows)
    # the image that counts: columns of its schema that are not dropped, large values, and defaults of columns behind the row's last
    natts = F.coalesce("natts", F.lit(32767))
    image = F.when(F.col("op") == "D", F.col("old")).otherwise(F.col("new"))
    known = F.transform(F.filter("attributes", lambda a: ~a.dropped & (a.attnum <= natts)), lambda a: a.attnum)
    pointed = F.coalesce(F.map_keys("filled"), F.array().cast("array<int>"))
    own = F.map_filter(image, lambda k, v: F.array_contains(known, k) & ~F.array_contains(pointed, k))
    late = F.map_from_entries(F.transform(F.filter("attributes", lambda a: ~a.dropped & (a.attnum > natts)), lambda a: F.struct(a.attnum, a.missing)))
    large = F.map_filter(F.coalesce("filled", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))), lambda k, v: F.array_contains(known, k))
    kept = kept.withColumn("values", F.map_concat(own, large, late))
    versions = kept.select(*VERSION_COLUMNS, "values")
    return Flow(versions, refused.select("top_xid", "rel", "lsn", "tuple_idx", "op", "verdict"), unmapped, cut, chunks)


def destination(versions: DataFrame, columns: Sequence[TargetColumn], target: str | None = None) -> DataFrame:
    """P1-P4. Typed rows of a target, or of all that have these columns: the columns in order, then ``_lsn, _xid, _commit_ts,
    _is_deleted`` (and ``_commit_lsn, _tuple_idx, _rel, _target``).

    A value that is absent, or NULL, or no text of the column's type is NULL, or the type's default in a column that is not nullable.
    """
    rows = versions if target is None else versions.filter(F.col("target") == target)
    value = lambda c: routing.coerce(F.try_element_at("values", F.lit(c.attnum)).try_cast(c.kind), F.map_contains_key("values", c.attnum), c.kind, c.nullable)
    own = [value(c).alias(c.name) for c in sorted(columns, key=lambda c: c.attnum)]
    return rows.select(*own, F.col("lsn").alias("_lsn"), F.col("xid").alias("_xid"), F.col("commit_ts").alias("_commit_ts"), (F.col("op") == "D").alias("_is_deleted"), F.col("commit_lsn").alias("_commit_lsn"), F.col("tuple_idx").alias("_tuple_idx"), F.col("rel").alias("_rel"), F.col("target").alias("_target"))


def state(versions: DataFrame, truncates: DataFrame, columns: Sequence[TargetColumn], keys: Sequence[str], target: str | None = None, *, soft_delete: bool = False) -> DataFrame:
    """A1, B2. What the last version of each key of a target (or of each target) says, behind the last truncate of its relation."""
    rows = destination(transactions.truncated(versions, truncates), columns, target)
    return latest_state(rows, ["_target", *keys], ["_lsn", "_tuple_idx"], soft_delete=soft_delete)
