"""Queries of transactions, versions and record filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import transactions as X
from ..operators import versions as V
from . import fixtures as fx
from .registry import query


# --- transactions -----------------------------------------------------------


@query("x3_committed_changes", fx.COMMITTED + "SELECT lsn, xid, top_xid, op, k, val, commit_lsn, commit_ts FROM done")
def committed_changes(spark: SparkSession, d: str) -> DataFrame:
    return fx.committed(spark, d).select("lsn", "xid", "top_xid", "op", "k", "val", "commit_lsn", "commit_ts")


@query("x4_abort_discard", fx.LOG + fx.ENDS + "SELECT lsn, xid, top_xid FROM log JOIN ends USING (top_xid) WHERE outcome = 'abort' OR xid % 6 = 1")
def abort_discard(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.log(spark, d)
    return X.discarded(rows, fx.ends(rows), fx.aborted_subxids(rows)).select("lsn", "xid", "top_xid")


@query("x4_savepoint_rollback", fx.LOG + fx.ENDS + "SELECT top_xid, count(*) AS kept, sum(CASE WHEN xid % 6 = 1 THEN 1 ELSE 0 END) > 0 AS had_rollback FROM log JOIN ends USING (top_xid) WHERE outcome = 'commit' GROUP BY top_xid HAVING count(*) > 0".replace("count(*) AS kept", "CAST(sum(CASE WHEN xid % 6 = 1 THEN 0 ELSE 1 END) AS BIGINT) AS kept"))
def savepoint_rollback(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.log(spark, d)
    all_rows = X.committed(rows, fx.ends(rows)).groupBy("top_xid").agg(F.count(F.lit(1)).alias("n"))
    kept = fx.committed(spark, d).groupBy("top_xid").agg(F.count(F.lit(1)).alias("kept"))
    return all_rows.join(kept, "top_xid", "left").select("top_xid", F.coalesce("kept", F.lit(0).cast("bigint")).alias("kept"), (F.coalesce("kept", F.lit(0)) < F.col("n")).alias("had_rollback"))


_TREE = [(10, [11, 12], None, "commit"), (20, [21], None, "abort"), (30, [], 31, "commit"), (40, [41, 42, 43], None, "commit")]


def _literal_ends(spark: SparkSession) -> DataFrame:
    return fx.values(spark, _TREE, "xid long, subxids array<long>, twophase_xid long, outcome string")


_TREE_SQL = "WITH e AS (SELECT * FROM " + fx.sql_values(_TREE, "xid, subxids, twophase_xid, outcome") + "), tree AS (SELECT unnest(subxids) AS subxid, coalesce(twophase_xid, xid) AS top_xid FROM e), w AS (SELECT event_id AS lsn, event_id % 50 AS xid FROM events) "


@query("j7_subxid_top", _TREE_SQL + "SELECT lsn, w.xid, CAST(coalesce(top_xid, w.xid) AS BIGINT) AS top_xid FROM w LEFT JOIN tree ON w.xid = subxid")
def subxid_top(spark: SparkSession, d: str) -> DataFrame:
    writers = fx.table(spark, d, "events").select(F.col("event_id").alias("lsn"), (F.col("event_id") % 50).alias("xid"))
    return X.with_top_xid(writers, X.tree_of(_literal_ends(spark))).select("lsn", "xid", "top_xid")


@query("x5_prepared_commit", "SELECT top_xid, count(*) AS ends, sum(CASE WHEN outcome = 'commit' THEN 1 ELSE 0 END)::BIGINT AS commits FROM (SELECT o_custkey AS top_xid, CASE o_orderstatus WHEN 'F' THEN 'commit' WHEN 'P' THEN 'abort' END AS outcome FROM orders) WHERE outcome IS NOT NULL GROUP BY top_xid")
def prepared_commit(spark: SparkSession, d: str) -> DataFrame:
    """Ends by the transaction they end: of every third, a prepared one, by the xid it names; a PREPARE itself ends nothing."""
    o = fx.table(spark, d, "orders")
    two_phase = F.col("o_orderkey") % 3 == 0
    outcome = F.when(F.col("o_orderstatus") == "F", "commit").when(F.col("o_orderstatus") == "P", "abort").otherwise("prepare")
    ends = o.select(F.when(two_phase, -F.col("o_orderkey")).otherwise(F.col("o_custkey")).alias("xid"), F.when(two_phase, F.col("o_custkey")).alias("twophase_xid"), outcome.alias("outcome"))
    return X.with_top_of_ends(ends).groupBy("top_xid").agg(F.count(F.lit(1)).alias("ends"), F.count_if(F.col("outcome") == "commit").alias("commits"))


@query("x7_foreign_xid_guard", _TREE_SQL + "SELECT lsn, xid, CAST(10 AS BIGINT) AS top_xid FROM w WHERE xid < 15 AND xid NOT IN (10, 11, 12)")
def foreign_xid_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "events").select(F.col("event_id").alias("lsn"), (F.col("event_id") % 50).alias("xid")).filter("xid < 15").withColumn("top_xid", F.lit(10).cast("long"))
    return X.foreign_rows(rows, X.tree_of(_literal_ends(spark))).select("lsn", "xid", "top_xid")


_BARRIERS = "barriers AS (SELECT top_xid, max(lsn) - 32 AS lsn, 0 AS tuple_idx FROM log WHERE top_xid % 3 = 0 GROUP BY top_xid), ordered AS (SELECT top_xid, lsn, is_event, CAST(row_number() OVER (PARTITION BY top_xid ORDER BY lsn, is_event DESC, tuple_idx) AS BIGINT) AS position FROM (SELECT top_xid, lsn, tuple_idx, FALSE AS is_event FROM log UNION ALL SELECT top_xid, lsn, tuple_idx, TRUE FROM barriers))"


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.log(spark, d).select("top_xid", "lsn", "tuple_idx")
    barriers = rows.filter("top_xid % 3 = 0").groupBy("top_xid").agg((F.max("lsn") - 32).alias("lsn")).withColumn("tuple_idx", F.lit(0))
    return X.merge_order(rows, barriers).withColumn("position", F.col("position").cast("long"))


@query("o1_merge_order", fx.LOG + ", " + _BARRIERS + " SELECT top_xid, lsn, is_event, position FROM ordered")
def merge_order(spark: SparkSession, d: str) -> DataFrame:
    return _ordered(spark, d).select("top_xid", "lsn", "is_event", "position")


@query("b1_barrier_segments", fx.LOG + ", " + _BARRIERS + " SELECT top_xid, lsn, is_event, CAST(sum(CASE WHEN is_event THEN 1 ELSE 0 END) OVER (PARTITION BY top_xid ORDER BY position) AS BIGINT) AS segment FROM ordered")
def barrier_segments(spark: SparkSession, d: str) -> DataFrame:
    return X.segments(_ordered(spark, d)).select("top_xid", "lsn", "is_event", "segment")


@query("a21_inflight_snapshot", fx.LOG + "SELECT top_xid, min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) AS n_rows, count(DISTINCT rel) AS n_relations FROM log WHERE top_xid % 9 = 4 GROUP BY top_xid")
def inflight_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.log(spark, d)
    return X.inflight_snapshot(rows, fx.ends(rows).filter("top_xid % 9 != 4"))


@query("a20_largest_xact", "SELECT event_id // 20 AS top_xid, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def largest_xact(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "events").select(F.expr("event_id div 20").alias("top_xid"), "props")
    return X.largest_transaction(rows, F.octet_length("props"))


@query("b2_truncate_cut", fx.LOG.replace("CASE event_type", "CASE WHEN event_id % 211 = 100 THEN 'T' ELSE CASE event_type").replace("ELSE 'U' END AS op", "ELSE 'U' END END AS op") + fx.ENDS + ", done AS (SELECT l.* FROM log l JOIN ends e USING (top_xid) WHERE e.outcome = 'commit' AND l.xid % 6 <> 1), cut AS (SELECT rel, max(lsn) AS cut FROM done WHERE op = 'T' GROUP BY rel) SELECT done.rel, k, lsn FROM done LEFT JOIN cut USING (rel) WHERE op <> 'T' AND (cut IS NULL OR lsn >= cut)")
def truncate_cut(spark: SparkSession, d: str) -> DataFrame:
    """TRUNCATEs are changes of transactions: those of aborted ones and of savepoints rolled back empty nothing."""
    rows = fx.log(spark, d).withColumn("op", F.when(F.expr("lsn div 16") % 211 == 100, "T").otherwise(F.col("op")))
    done = X.committed(rows, fx.ends(rows), fx.aborted_subxids(rows))
    return X.truncated(done.filter("op != 'T'"), X.truncates(done)).select("rel", "k", "lsn")


@query("x1_open_changes", fx.LOG + "SELECT lsn, top_xid FROM log WHERE top_xid % 9 = 4")
def open_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.log(spark, d)
    return X.open_changes(rows, fx.ends(rows).filter("top_xid % 9 != 4")).select("lsn", "top_xid")


_REFUSED = fx.LOG + ", q AS (SELECT *, CASE WHEN lsn % 1600 = 0 THEN 'ambiguous_interval' WHEN lsn % 1776 = 0 THEN 'malformed' WHEN op = 'D' AND k = 7 THEN 'unsupported_operation' WHEN rel = 2 AND lsn < 400 THEN 'missing_verdict' WHEN lsn % 2672 = 0 THEN 'partial_update' ELSE 'apply' END AS verdict FROM log) "


def _judged(spark: SparkSession, d: str) -> DataFrame:
    no = F.lit(False)
    flags = {
        "ambiguous": F.col("lsn") % 1600 == 0,
        "image_only": no,
        "malformed": F.col("lsn") % 1776 == 0,
        "supported": ~((F.col("op") == "D") & (F.col("k") == 7)),
        "shape": F.when(~((F.col("rel") == 2) & (F.col("lsn") < 400)), 1),
        "partial": F.col("lsn") % 2672 == 0,
        "generation_complete": ~no,
    }
    return fx.log(spark, d).withColumns(flags).withColumn("verdict", R.verdict())


@query("x10_verdicts", _REFUSED + "SELECT verdict, count(*) AS n FROM q GROUP BY verdict")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("x11_whole_transactions", _REFUSED + "SELECT top_xid, lsn FROM q WHERE top_xid NOT IN (SELECT top_xid FROM q WHERE verdict <> 'apply')")
def whole_transactions(spark: SparkSession, d: str) -> DataFrame:
    return R.split_refused(_judged(spark, d))[0].select("top_xid", "lsn")


# --- versions ---------------------------------------------------------------

_LATEST = fx.VERSIONS + ", r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY _lsn DESC, tuple_idx DESC) AS rn FROM v) "


@query("a1_latest_state", _LATEST + "SELECT k, val, _lsn, _xid, _commit_ts FROM r WHERE rn = 1 AND NOT _is_deleted")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: what the committed log says of each key."""
    return V.latest_state(fx.versions(spark, d), ["k"], ["_lsn", "tuple_idx"]).select("k", "val", "_lsn", "_xid", "_commit_ts")


@query("a1_soft_delete", _LATEST + "SELECT k, val, _lsn, _is_deleted FROM r WHERE rn = 1")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    return V.latest_state(fx.versions(spark, d), ["k"], ["_lsn", "tuple_idx"], soft_delete=True).select("k", "val", "_lsn", "_is_deleted")


@query("f13_live_rows", _LATEST + "SELECT count(*) AS live FROM r WHERE rn = 1 AND NOT _is_deleted")
def live_count(spark: SparkSession, d: str) -> DataFrame:
    return V.latest_state(fx.versions(spark, d), ["k"], ["_lsn", "tuple_idx"]).agg(F.count(F.lit(1)).alias("live"))


@query("a2_argmax_version", fx.VERSIONS + "SELECT k, max_by(CASE WHEN _lsn % 13 = 0 THEN NULL ELSE val END, _lsn) AS val FROM v GROUP BY k")
def argmax_version(spark: SparkSession, d: str) -> DataFrame:
    holes = fx.versions(spark, d).withColumn("val", F.when(F.col("_lsn") % 13 != 0, F.col("val")))
    return V.arg_max(holes, ["k"], "val", "_lsn")


_LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query("a1_composite_key", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY " + ", ".join(f"{c} DESC" for c in _LINE_ORDER) + ") AS rn FROM lineitem) WHERE rn = 1")
def composite_key(spark: SparkSession, d: str) -> DataFrame:
    return V.latest_versions(fx.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("a1_keyless", fx.COMMITTED + "SELECT lsn - lsn % 80 AS lsn, CAST(lsn // 16 % 5 AS INT) AS tuple_idx, k FROM done")
def keyless(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.committed(spark, d).withColumn("tuple_idx", (F.expr("lsn div 16") % 5).cast("int")).withColumn("lsn", F.col("lsn") - F.col("lsn") % 80)
    return V.keyless_state(rows.unionByName(rows)).select("lsn", "tuple_idx", "k")


@query("a1_keyless_by_lsn", fx.COMMITTED + "SELECT lsn - lsn % 80 AS lsn, max_by(k, lsn) AS k FROM done GROUP BY 1")
def keyless_by_lsn(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.committed(spark, d).withColumn("tuple_idx", (F.expr("lsn div 16") % 5).cast("int")).withColumn("lsn", F.col("lsn") - F.col("lsn") % 80)
    return V.keyless_state(rows, merge_by_lsn=True).select("lsn", "k")


@query("t7_replay_idempotent", _LATEST + "SELECT k, val, _lsn FROM r WHERE rn = 1 AND NOT _is_deleted")
def replay_idempotent(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.versions(spark, d)
    return V.latest_state(V.union_loads(rows, rows.filter("_lsn > 3000"), rows.filter("_lsn > 9000")), ["k"], ["_lsn", "tuple_idx"]).select("k", "val", "_lsn")


@query("u2_baseline_union_live", fx.VERSIONS + ", b AS (SELECT c_custkey AS k, c_acctbal AS val, CAST(2000 AS BIGINT) AS _lsn, FALSE AS _is_deleted FROM customer), u AS (SELECT k, val, _lsn, _is_deleted FROM v UNION ALL SELECT * FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY _lsn DESC, val DESC) AS rn FROM u) SELECT k, val, _lsn FROM r WHERE rn = 1 AND NOT _is_deleted")
def baseline_union_live(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.backfill import baseline

    base = baseline(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("val")), 2000)
    return V.latest_state(V.union_loads(fx.versions(spark, d), base), ["k"], ["_lsn", "val"]).select("k", "val", "_lsn")


@query("u1_compaction", _LATEST + "SELECT k, val, _lsn, _is_deleted FROM r WHERE rn = 1 AND NOT (_is_deleted AND _lsn < 12000)")
def compaction(spark: SparkSession, d: str) -> DataFrame:
    return V.compact(fx.versions(spark, d), ["k"], ["_lsn", "tuple_idx"], 12_000).select("k", "val", "_lsn", "_is_deleted")


@query("a1_rekeyed", fx.COMMITTED + ", m AS (SELECT k + CASE WHEN lsn % 32 = 0 THEN 1000 ELSE 0 END AS k, k AS old_k, op, lsn, op = 'D' AS _is_deleted FROM done), u AS (SELECT k, lsn, _is_deleted FROM m UNION ALL SELECT old_k, lsn, TRUE FROM m WHERE op = 'U' AND k <> old_k), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lsn DESC) AS rn FROM u) SELECT k, lsn FROM r WHERE rn = 1 AND NOT _is_deleted")
def rekeyed(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.committed(spark, d).select((F.col("k") + F.when(F.col("lsn") % 32 == 0, 1000).otherwise(0)).alias("k"), F.col("k").alias("old_k"), "op", "lsn", (F.col("op") == "D").alias("_is_deleted"))
    return V.latest_state(rows.unionByName(V.rekeyed_tombstones(rows, ["k"], ["old_k"])), ["k"], ["lsn"]).select("k", "lsn")


@query("w8_previous_image", fx.COMMITTED + "SELECT lsn, k, last_value(CASE WHEN lsn % 48 = 0 THEN val END IGNORE NULLS) OVER (PARTITION BY k ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM done")
def previous_image(spark: SparkSession, d: str) -> DataFrame:
    return V.previous_image(fx.committed(spark, d), ["k"], F.when(F.col("lsn") % 48 == 0, F.col("val")), "lsn").select("lsn", "k", "prev")


# --- record filters ---------------------------------------------------------

_MOVED = [(20001, 3000, 0), (20003, 5000, 2), (20004, 10_000_000_000, 0)]
_ROUTE_SQL = fx.RECORDS + ", moved AS (SELECT CAST(node AS BIGINT) AS node, CAST(valid_from AS BIGINT) AS valid_from, mdb FROM " + fx.sql_values(_MOVED, "node, valid_from, mdb") + "), rt AS (SELECT c.*, EXISTS (SELECT 1 FROM moved m WHERE (list_contains(c.blocks, m.node) OR c.located = m.node) AND m.valid_from <= c.lsn AND (m.mdb = 0 OR m.mdb = c.db)) AS tracked FROM cls c) "


def _routed(spark: SparkSession, d: str) -> DataFrame:
    moved = fx.values(spark, _MOVED, "node long, valid_from long, db int")
    rows = R.with_tracked(fx.records(spark, d).withColumn("class", R.record_class()), moved)
    return rows.withColumn("route", R.route())


@query("f1_classify", fx.RECORDS + "SELECT lsn, class FROM cls")
def classify(spark: SparkSession, d: str) -> DataFrame:
    return fx.records(spark, d).select("lsn", R.record_class().alias("class"))


@query("f2_route", _ROUTE_SQL + "SELECT lsn, class, CASE WHEN tracked THEN 'ToShadow' WHEN class = 'User' OR (class = 'Empty' AND located IS NOT NULL) THEN 'ToDecoder' ELSE 'ToShadow' END AS route FROM rt")
def route(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("lsn", "class", "route")


@query("f3_catalog_tracker", _ROUTE_SQL + "SELECT lsn, tracked FROM rt")
def catalog_tracker(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("lsn", "tracked")


@query("f4_db_scope", fx.LOG + "SELECT db, count(*) AS n FROM log WHERE db = 1 GROUP BY db")
def db_scope(spark: SparkSession, d: str) -> DataFrame:
    return fx.log(spark, d).filter(R.in_scope(fx.TARGET_DB)).groupBy("db").agg(F.count(F.lit(1)).alias("n"))


@query("f5_stats_only", fx.CATALOG + "SELECT xid, bool_and(is_opaque) AS statistics_only FROM cat WHERE is_catalog GROUP BY xid")
def stats_only(spark: SparkSession, d: str) -> DataFrame:
    return R.statistics_only(fx.catalog_changes(spark, d))


@query("f6_dirty_defer", fx.CATALOG + ", f AS (SELECT top_xid, min(lsn) AS dirty_from FROM cat WHERE is_catalog GROUP BY top_xid) SELECT lsn, dirty_from, coalesce(lsn > dirty_from, FALSE) AS deferred FROM cat LEFT JOIN f USING (top_xid)")
def dirty_defer(spark: SparkSession, d: str) -> DataFrame:
    return R.dirty_deferred(fx.catalog_changes(spark, d)).select("lsn", "dirty_from", "deferred")


@query("a4_first_touch", fx.CATALOG + "SELECT top_xid, oid, min(lsn) AS first_touch FROM cat WHERE is_catalog GROUP BY ALL")
def first_touch(spark: SparkSession, d: str) -> DataFrame:
    return fx.catalog_changes(spark, d).filter("is_catalog").groupBy("top_xid", "oid").agg(F.min("lsn").alias("first_touch"))


@query("f7_boundaries", fx.CATALOG + ", t AS (SELECT top_xid, bool_or(capture_all) AS capture_all FROM cat WHERE is_catalog AND NOT is_opaque GROUP BY 1), o AS (SELECT top_xid, oid FROM cat WHERE is_catalog AND NOT is_opaque UNION SELECT top_xid, 17000 FROM log WHERE top_xid % 4 = 0) SELECT t.top_xid, commit_lsn, list_sort(list(CAST(oid AS BIGINT))) AS oids, capture_all FROM t JOIN ends e ON e.top_xid = t.top_xid AND outcome = 'commit' JOIN o ON o.top_xid = t.top_xid GROUP BY ALL".replace("list_sort(list(CAST(oid AS BIGINT))) AS oids", "string_agg(CAST(oid AS VARCHAR), ',' ORDER BY oid) AS oids"))
def boundaries(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.catalog_changes(spark, d)
    told = rows.filter("top_xid % 4 = 0").select("top_xid", F.lit(17000).cast("long").alias("oid"))
    return R.boundaries(rows, fx.ends(rows), told).withColumn("oids", F.array_join(F.transform("oids", lambda o: o.cast("string")), ","))


_OPERATIONS = ("INSERT", "LOCK", "UPDATE", "INPLACE", "DELETE", "CONFIRM", "MULTI_INSERT")


@query("f9_skipped_ops", "WITH o AS (SELECT event_id, ([" + ", ".join(f"'{x}'" for x in _OPERATIONS) + "])[event_id % 7 + 1] AS operation, (['Heap', 'Heap2', 'Btree'])[event_id // 7 % 3 + 1] AS rmgr FROM events) SELECT event_id, rmgr, operation FROM o WHERE (rmgr = 'Heap' AND operation NOT IN ('LOCK', 'INPLACE', 'CONFIRM')) OR (rmgr = 'Heap2' AND operation = 'MULTI_INSERT')")
def skipped_ops(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    rows = fx.table(spark, d, "events").select("event_id", pick(_OPERATIONS, F.col("event_id")).alias("operation"), pick(("Heap", "Heap2", "Btree"), F.expr("event_id div 7")).alias("rmgr"))
    return rows.filter(R.yields_rows())


@query("f10_multi_insert_explode", "SELECT o_orderkey AS lsn, o_custkey AS xid, CAST(i AS INT) AS tuple_idx, o_orderkey * 10 + i AS tuple FROM (SELECT *, unnest(range(0, CAST(o_orderkey % 4 AS BIGINT))) AS i FROM orders)")
def multi_insert(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    n = (F.col("o_orderkey") % 4).cast("int")
    tuples = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("o_orderkey") * 10 + i)).otherwise(F.array().cast("array<bigint>"))
    rows = o.select(F.col("o_orderkey").alias("lsn"), F.col("o_custkey").alias("xid"), F.lit(1).alias("rel"), tuples.alias("tuples"))
    return R.explode_multi_insert(rows).select("lsn", "xid", "tuple_idx", "tuple")


@query("f12_config_split", fx.LOG + "SELECT rel, count(*) FILTER (WHERE rel = 3) AS config_rows, count(*) FILTER (WHERE rel <> 3) AS data_rows FROM log GROUP BY rel")
def config_split(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.log(spark, d).withColumns({"rel_ns": F.lit("cfg"), "rel_name": F.when(F.col("rel") == 3, "config_table").otherwise("t")})
    own, other = R.split_config(rows, "cfg")
    both = own.select("rel", F.lit(1).alias("c"), F.lit(0).alias("o")).unionByName(other.select("rel", F.lit(0).alias("c"), F.lit(1).alias("o")))
    return both.groupBy("rel").agg(F.sum("c").alias("config_rows"), F.sum("o").alias("data_rows"))


@query("f15_kind_eligibility", "WITH r AS (SELECT p_partkey, p_partkey * 100 AS oid, (['r', 't', 'i', 'v', 'p', 'm'])[p_size % 6 + 1] AS kind FROM part) SELECT p_partkey, kind, kind IN ('r', 'p') AS can_truncate FROM r WHERE oid >= 16384 AND kind IN ('r', 'p', 'm', 't')")
def kind_eligibility(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, "rtivpm")), F.col("p_size") % 6 + 1)
    rows = fx.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 100).alias("oid"), kind.alias("kind"))
    return rows.filter(R.eligible()).select("p_partkey", "kind", R.eligible(truncate=True).alias("can_truncate"))


@query("f19_catalog_skew", fx.CATALOG + "SELECT lsn, rel FROM cat WHERE lsn BETWEEN 4000 AND 9000 AND is_catalog AND rel IN (1, 2)")
def catalog_skew(spark: SparkSession, d: str) -> DataFrame:
    return R.catalog_skew(fx.catalog_changes(spark, d), fx.values(spark, [(1,), (2,)], "rel long"), 4000, 9000).select("lsn", "rel")


@query("f20_preflight", "SELECT * FROM (VALUES ('version', '150004'), ('major', '160002'), ('wal_level', 'replica'), ('slot', '')) AS t(\"check\", subject) UNION ALL SELECT 'row_key', c_name FROM customer WHERE c_custkey % 4 = 0 OR (c_custkey % 4 = 1 AND c_nationkey % 2 = 1)")
def preflight(spark: SparkSession, d: str) -> DataFrame:
    identity = F.element_at(F.array(*map(F.lit, ("nothing", "default", "full", "index"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    relations = fx.table(spark, d, "customer").select(F.col("c_name").alias("rel_name"), identity.alias("identity"), (F.col("c_nationkey") % 2 == 0).alias("has_pk"))
    return R.preflight({"server_version": "150004", "catalog_version": "160002", "wal_level": "replica", "slot": ""}, relations)
