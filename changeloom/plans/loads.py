"""Queries of initial loads, progress, operations and scalar forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as N
from ..operators import backfill as B
from ..operators import progress as P
from ..operators import records as R
from ..operators import versions as V
from . import fixtures as fx
from .registry import query

# --- visibility and loads ---------------------------------------------------

_TAIL, _OLDEST = 9000, 500
_STATUS_SQL = f"""st AS (SELECT x.xid, CASE WHEN x.xid IN (1, 2) THEN 'Committed' WHEN x.xid % 97 = 0 THEN 'Committed' WHEN x.xid % 89 = 0 THEN 'Aborted' WHEN x.xid >= {_TAIL} THEN 'InProgress' WHEN x.xid < {_OLDEST} THEN 'Unknown'
  WHEN o_orderstatus = 'F' THEN 'Committed' WHEN o_orderstatus = 'P' THEN 'Aborted' ELSE 'InProgress' END AS status FROM (SELECT DISTINCT l_orderkey AS xid FROM lineitem) x LEFT JOIN orders ON o_orderkey = x.xid AND o_orderkey % 3 <> 0)"""


def _log_and_patch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The base status log, and what was patched over it."""
    log = fx.table(spark, d, "orders").filter("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("xid"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(0).alias("bits"))
    xids = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("xid")).distinct()
    return log, xids.filter("xid % 97 = 0 OR xid % 89 = 0").select("xid", (F.col("xid") % 97 == 0).alias("committed"))


@query("j11_xid_status", f"WITH {_STATUS_SQL} SELECT xid, status FROM st")
def xid_status(spark: SparkSession, d: str) -> DataFrame:
    xids = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("xid")).distinct()
    return B.xid_status(xids, *_log_and_patch(spark, d), _TAIL, _OLDEST)


_MASKS = (0x0000, 0x0100, 0x0200, 0x0300, 0x0400, 0x0800, 0x0080, 0x0040, 0x0050, 0x1000, 0x1040, 0x1080, 0x0500, 0x0900, 0x1100, 0x0010)
_TUPLES_SQL = f"tu AS (SELECT l_orderkey AS xmin, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_orderkey + 1 END AS xmax, ([{', '.join(map(str, _MASKS))}])[l_partkey % 16 + 1] AS m, (['Covered', 'LockOnly', 'Unresolvable', NULL, 'Committed', 'Aborted', 'InProgress', 'Unknown'])[l_suppkey % 8 + 1] AS u, l_partkey % 29 <> 3 AS has_log FROM lineitem)"
_VISIBLE_SQL = """CASE WHEN NOT (m & 768 = 768 OR (xmin > 0 AND xmin < 3)) AND m & 512 <> 0 THEN 'Skip'
 WHEN NOT (m & 768 = 768 OR (xmin > 0 AND xmin < 3)) AND m & 256 = 0 AND NOT has_log THEN 'Defer'
 WHEN NOT (m & 768 = 768 OR (xmin > 0 AND xmin < 3)) AND m & 256 = 0 AND a IN ('Aborted', 'InProgress') THEN 'Skip'
 WHEN xmax = 0 OR m & 2048 <> 0 OR m & 128 <> 0 OR m & 4176 = 64 THEN 'Emit'
 WHEN m & 4096 <> 0 THEN CASE WHEN NOT has_log THEN 'Defer' WHEN u IS NULL OR u = 'Unresolvable' THEN 'Unresolvable' WHEN u IN ('Committed', 'Unknown') THEN 'Skip' ELSE 'Emit' END
 WHEN m & 1024 <> 0 THEN 'Skip' WHEN NOT has_log THEN 'Defer' WHEN b IN ('Committed', 'Unknown') THEN 'Skip' ELSE 'Emit' END"""
_STATUS_OF = f"CASE WHEN {{x}} IN (1, 2) THEN 'Committed' WHEN {{x}} % 97 = 0 AND {{x}} IN (SELECT l_orderkey FROM lineitem) THEN 'Committed' WHEN {{x}} % 89 = 0 AND {{x}} IN (SELECT l_orderkey FROM lineitem) THEN 'Aborted' WHEN {{x}} >= {_TAIL} THEN 'InProgress' WHEN {{x}} < {_OLDEST} THEN 'Unknown' WHEN {{o}}.o_orderstatus = 'F' THEN 'Committed' WHEN {{o}}.o_orderstatus = 'P' THEN 'Aborted' ELSE 'InProgress' END"
_JUDGED_SQL = f"WITH {_TUPLES_SQL}, js AS (SELECT tu.*, {_STATUS_OF.format(x='xmin', o='o1')} AS a, {_STATUS_OF.format(x='xmax', o='o2')} AS b FROM tu LEFT JOIN orders o1 ON o1.o_orderkey = xmin AND xmin % 3 <> 0 LEFT JOIN orders o2 ON o2.o_orderkey = xmax AND xmax % 3 <> 0) "


def _tuples(spark: SparkSession, d: str) -> DataFrame:
    """Tuples of a page-level backup with the outcomes of their writers; every 29th was read without a transaction log."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    rows = fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("xmin"),
        F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(F.col("l_orderkey") + 1).alias("xmax"),
        pick(_MASKS, F.col("l_partkey") % 16).alias("infomask"),
        pick(("Covered", "LockOnly", "Unresolvable", None, "Committed", "Aborted", "InProgress", "Unknown"), F.col("l_suppkey") % 8).alias("updater_status"),
        (F.col("l_partkey") % 29 != 3).alias("has_log"),
    )
    return B.xid_statuses(rows, *_log_and_patch(spark, d), _TAIL, _OLDEST, {xid: f"{xid}_status" for xid in ("xmin", "xmax")})


@query("f14_visibility", _JUDGED_SQL + f"SELECT {_VISIBLE_SQL} AS verdict, count(*) AS n FROM js GROUP BY 1")
def visibility(spark: SparkSession, d: str) -> DataFrame:
    return _tuples(spark, d).groupBy(B.visibility(has_log=F.col("has_log")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("l3_gated_load", _JUDGED_SQL + f"SELECT xmin, CAST(7000 AS BIGINT) AS _lsn FROM (SELECT xmin, {_VISIBLE_SQL} AS verdict FROM js WHERE has_log AND coalesce(u, 'Unresolvable') <> 'Unresolvable') WHERE verdict = 'Emit'")
def gated_load(spark: SparkSession, d: str) -> DataFrame:
    """The visible tuples of a backup that has its log and its multixacts, as rows at the opt-in."""
    rows = _tuples(spark, d).filter("has_log AND coalesce(updater_status, 'Unresolvable') != 'Unresolvable'")
    return B.gated_load(rows, 7000).select("xmin", "_lsn")


@query("j12_multixact_updater", "WITH o AS (SELECT DISTINCT l_orderkey AS mxid FROM lineitem), off AS (SELECT a.mxid, a.mxid * 3 AS start, b.mxid * 3 AS stop FROM o a JOIN o b ON b.mxid = a.mxid + 1), m AS (SELECT event_id AS pos, user_id AS xid, event_id % 7 AS kind FROM events) SELECT mxid, arg_min(xid, pos) FILTER (WHERE kind > 3) AS updater FROM off LEFT JOIN m ON pos >= start AND pos < stop GROUP BY mxid")
def multixact_updater(spark: SparkSession, d: str) -> DataFrame:
    offsets = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("mxid")).distinct().withColumn("start", F.col("mxid") * 3)
    members = fx.table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("xid"), (F.col("event_id") % 7).alias("kind"))
    return B.multixact_updater(offsets, members)


@query("f16_gap_window", fx.COMMITTED + "SELECT lsn, commit_lsn FROM done WHERE commit_lsn > 3000 AND commit_lsn <= 9000")
def gap_window(spark: SparkSession, d: str) -> DataFrame:
    return B.gap_window(fx.committed(spark, d), 3000, 9000).select("lsn", "commit_lsn")


@query("f17_copy_back", fx.VERSIONS + "SELECT k, _lsn FROM v WHERE _lsn > 8000")
def copy_back(spark: SparkSession, d: str) -> DataFrame:
    return B.copy_back(fx.versions(spark, d), 8000).select("k", "_lsn")


_L4_SQL = fx.VERSIONS + ", base AS (SELECT c_custkey AS k, c_acctbal AS val, CAST(3000 AS BIGINT) AS _lsn, FALSE AS _is_deleted FROM customer), gap AS (SELECT k, val, lsn AS _lsn, op = 'D' AS _is_deleted FROM done WHERE commit_lsn > 3000 AND commit_lsn <= 9000), u AS (SELECT * FROM base UNION ALL SELECT * FROM gap UNION ALL SELECT k, val, _lsn, _is_deleted FROM v WHERE _lsn > 9000), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY _lsn DESC, val DESC) AS rn FROM u) "


@query("l4_object_store_load", _L4_SQL + "SELECT k, val, _lsn FROM r WHERE rn = 1 AND NOT _is_deleted")
def object_store_load(spark: SparkSession, d: str) -> DataFrame:
    base = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("val"))
    done = fx.committed(spark, d).select("k", "val", F.col("lsn").alias("_lsn"), (F.col("op") == "D").alias("_is_deleted"), "commit_lsn")
    rows = B.object_store_load(base, done, fx.versions(spark, d), redo=3000, opt_in=9000)
    return V.latest_state(rows, ["k"], ["_lsn", "val"]).select("k", "val", "_lsn")


@query("l1_bootstrap", "SELECT c_custkey AS k, CAST(100 AS BIGINT) AS _lsn, CAST(0 AS BIGINT) AS _xid, CAST(0 AS BIGINT) AS _commit_ts, FALSE AS _is_deleted FROM customer")
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return B.baseline(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), 100)


_STAGED = "SELECT c_acctbal, c_name, c_custkey, 1 AS other FROM customer"


@query("j17_column_intersection", f"SELECT column_name AS name, CAST(row_number() OVER (ORDER BY rn) - 1 AS INT) AS position FROM (SELECT column_name, row_number() OVER () AS rn FROM (DESCRIBE customer)) WHERE column_name IN (SELECT column_name FROM (DESCRIBE {_STAGED}))")
def column_intersection(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "customer")
    names = B.shared_columns(c, c.select("c_acctbal", "c_name", "c_custkey", F.lit(1).alias("other")))
    return fx.values(spark, [(n, k) for k, n in enumerate(names)], "name string, position int")


_SHAPES = {"same": "SELECT * FROM nation WHERE n_nationkey < 3", "reordered": "SELECT n_regionkey, n_name, n_nationkey FROM nation", "retyped": "SELECT n_nationkey, n_nationkey AS n_name, n_regionkey FROM nation"}


@query("j18_fingerprint", " UNION ALL ".join(f"SELECT '{k}' AS shape, (SELECT string_agg(column_name || ' ' || column_type, ',') FROM (DESCRIBE {sql})) = (SELECT string_agg(column_name || ' ' || column_type, ',') FROM (DESCRIBE nation)) AS equal" for k, sql in _SHAPES.items()))
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    n = fx.table(spark, d, "nation")
    others = {"same": n.filter("n_nationkey < 3"), "reordered": n.select(*reversed(n.columns)), "retyped": n.withColumn("n_name", F.col("n_nationkey"))}
    return fx.values(spark, [(k, B.same_shape(n, o)) for k, o in others.items()], "shape string, equal boolean")


# --- progress and operations ------------------------------------------------

_RT = fx.RECORDS + ", rt AS (SELECT *, CASE WHEN class = 'User' OR (class = 'Empty' AND located IS NOT NULL) THEN 'ToDecoder' ELSE 'ToShadow' END AS route FROM cls) "


def _classed(spark: SparkSession, d: str) -> DataFrame:
    return fx.records(spark, d).withColumns({"class": R.record_class(), "tracked": F.lit(False)}).withColumn("route", R.route())


@query("a5_class_counts", _RT + "SELECT rmgr, class, route, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM rt GROUP BY GROUPING SETS ((class), (rmgr, class), (rmgr, route))")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.class_counts(_classed(spark, d), F.col("size"))


@query("a6_catalog_fraction", _RT + "SELECT count(*) FILTER (WHERE class = 'Catalog') / CAST(count(*) AS DOUBLE) AS fraction FROM rt")
def catalog_fraction(spark: SparkSession, d: str) -> DataFrame:
    return P.catalog_fraction(_classed(spark, d))


def _acks(spark: SparkSession, d: str) -> DataFrame:
    """Seq 31 never came; seq 300 is there, but not done."""
    ends = fx.ends(fx.log(spark, d)).filter("top_xid != 31")
    return ends.select(F.col("top_xid").alias("seq"), (F.col("top_xid") != 300).alias("done"), (F.col("top_xid") % 4 != 0).alias("publish"), "commit_lsn")


_DENSE = fx.LOG + fx.ENDS + ", ak AS (SELECT * FROM ends WHERE {here}), pre AS (SELECT *, row_number() OVER (ORDER BY top_xid) - 1 + (SELECT min(top_xid) FROM ak) AS dense FROM ak WHERE top_xid <> 300) SELECT max(commit_lsn) AS watermark FROM pre WHERE top_xid = dense AND top_xid % 4 <> 0"


@query("a7_watermark", _DENSE.format(here="top_xid <> 31"))
def watermark(spark: SparkSession, d: str) -> DataFrame:
    """A gap in the sequence ends the prefix, like a seq that is not done."""
    return P.watermark(_acks(spark, d))


@query("w5_done_prefix", _DENSE.format(here="top_xid > 31"))
def done_prefix(spark: SparkSession, d: str) -> DataFrame:
    """From seq 32 on: the prefix ends at the first that is not done."""
    return P.watermark(_acks(spark, d).filter("seq > 31"), first=32)


@query("t1_idle_watermark", fx.LOG + fx.ENDS + "SELECT CAST(5000000000 AS BIGINT) AS watermark FROM ends HAVING count(*) > 0")
def idle_watermark(spark: SparkSession, d: str) -> DataFrame:
    """All is done, so a position behind the last transaction counts."""
    acks = fx.ends(fx.log(spark, d)).select(F.col("top_xid").alias("seq"), F.lit(True).alias("done"), F.lit(True).alias("publish"), "commit_lsn")
    return P.watermark(acks, trailing=5_000_000_000)


@query("a8_floor", fx.LOG + "SELECT CAST(least(least(min(lsn) * 5000000, 800000000) - least(min(lsn) * 5000000, 800000000) % 16777216, 790000000) AS BIGINT) AS floor FROM log WHERE top_xid > 2")
def floor(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.log(spark, d).filter("top_xid > 2").select((F.col("lsn") * 5_000_000).alias("first_lsn"))
    return P.resume_floor(rows, 800_000_000, 790_000_000)


@query("a9_row_sealing", fx.LOG + "SELECT rel, lsn, (row_number() OVER (PARTITION BY rel ORDER BY lsn) - 1) // 100 AS batch FROM log")
def row_sealing(spark: SparkSession, d: str) -> DataFrame:
    return P.seal_by_rows(fx.log(spark, d), "rel", "lsn", 100).select("rel", "lsn", "batch")


_GREEDY = """WITH RECURSIVE s AS (SELECT event_type, event_id, strlen(props) * (event_id % 7 + 1) AS size, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
g AS (SELECT event_type, event_id, rn, CAST(0 AS BIGINT) AS batch, size AS held FROM s WHERE rn = 1
  UNION ALL SELECT s.event_type, s.event_id, s.rn, g.batch + CASE WHEN g.held >= 500 THEN 1 ELSE 0 END, s.size + CASE WHEN g.held >= 500 THEN 0 ELSE g.held END FROM g JOIN s ON s.event_type = g.event_type AND s.rn = g.rn + 1)
SELECT event_type, event_id AS lsn, batch FROM g"""


@query("a10_byte_sealing", _GREEDY)
def byte_sealing(spark: SparkSession, d: str) -> DataFrame:
    """Sizes vary, so batches overshoot the budget by as much as their last row brings."""
    rows = fx.table(spark, d, "events").select("event_type", F.col("event_id").alias("lsn"), (F.octet_length("props") * (F.col("event_id") % 7 + 1)).alias("size"))
    return P.seal_by_bytes(rows, "event_type", "lsn", "size", 500).select("event_type", "lsn", "batch")


@query("a11_seq_counts", fx.COMMITTED + "SELECT top_xid AS seq, count(*) AS n FROM done GROUP BY 1")
def seq_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.counts_by(fx.committed(spark, d), F.col("top_xid").alias("seq"))


@query("a12_op_counts", fx.LOG + "SELECT op, count(*) AS n FROM log GROUP BY op")
def op_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.counts_by(fx.log(spark, d), "op")


_SAMPLES = fx.LOG + ", sm AS (SELECT rel, ts_us // 1000000 AS at_s, max(lsn) AS total FROM log GROUP BY ALL) "


@query("a13_rate_30s", _SAMPLES + "SELECT rel, at_s, CASE WHEN at_s > first_value(at_s) OVER w THEN CAST(total - first_value(total) OVER w AS DOUBLE) / (at_s - first_value(at_s) OVER w) END AS rate FROM sm WINDOW w AS (PARTITION BY rel ORDER BY at_s RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)")
def rate_30s(spark: SparkSession, d: str) -> DataFrame:
    samples = fx.log(spark, d).groupBy("rel", F.expr("ts_us div 1000000").alias("at_s")).agg(F.max("lsn").alias("total"))
    return P.rate_30s(samples, "rel").select("rel", "at_s", "rate")


@query("a14_percentiles", "SELECT o_orderpriority, min(o_totalprice) AS min, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.9) AS p90, quantile_disc(o_totalprice, 0.99) AS p99, max(o_totalprice) AS max, CAST(round(CAST(sum(CAST(o_totalprice AS DECIMAL(20, 6))) AS DECIMAL(38, 6)) / count(*), 1) AS DOUBLE) AS mean FROM orders GROUP BY 1")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return P.percentiles(fx.table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]).withColumn("mean", F.round("mean", 1))


_CURVE = fx.LOG + ", cv AS (SELECT rel AS run, ts_us // 1000000 AS at_s, max(lsn) AS sent, max(lsn) - min(k) AS arrived FROM log GROUP BY ALL), st AS (SELECT *, CAST(arrived - lag(arrived) OVER w AS DOUBLE) / nullif(at_s - lag(at_s) OVER w, 0) AS rate FROM cv WINDOW w AS (PARTITION BY run ORDER BY at_s)) "


@query("a15_throughput", _CURVE + "SELECT run, max(rate) AS peak_rate, max(sent - arrived) AS max_backlog FROM st GROUP BY run")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    curve = fx.log(spark, d).groupBy(F.col("rel").alias("run"), F.expr("ts_us div 1000000").alias("at_s")).agg(F.max("lsn").alias("sent"), (F.max("lsn") - F.min("k")).alias("arrived"))
    return P.throughput(curve)


@query("a16_checksums", "SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, md5(string_agg(o_orderstatus || o_orderpriority, '' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def checksums(spark: SparkSession, d: str) -> DataFrame:
    return P.checksums(fx.table(spark, d, "orders"), "o_custkey", "o_orderkey", F.concat("o_orderstatus", "o_orderpriority"), F.col("o_orderkey"))


@query("a16_parity", "SELECT o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, CAST(sum(CAST(CAST('0x' || substr(md5(o_orderkey || '|' || o_orderstatus), 1, 15) AS BIGINT) AS DECIMAL(38, 0))) AS VARCHAR) AS digest FROM orders GROUP BY 1")
def parity(spark: SparkSession, d: str) -> DataFrame:
    """Five groups hold all rows, and none is in one place."""
    return P.parity(fx.table(spark, d, "orders"), "o_orderpriority", "o_orderkey", F.col("o_orderstatus"), F.col("o_orderkey")).withColumn("digest", F.col("digest").cast("string"))


@query("a17_rows_per_2s", fx.COMMITTED + "SELECT commit_ts // 2000000 AS bucket, count(*) AS n FROM done GROUP BY 1")
def rows_per_2s(spark: SparkSession, d: str) -> DataFrame:
    return P.rows_per_interval(fx.committed(spark, d), "commit_ts")


@query("a18_distinct_positions", fx.CHUNKS + "SELECT relid, count(DISTINCT (blkno, offnum)) AS positions FROM ch GROUP BY relid")
def distinct_positions(spark: SparkSession, d: str) -> DataFrame:
    return P.distinct_positions(fx.chunks(spark, d))


@query("a19_pending_by_mode", "SELECT o_orderpriority AS mode, count(*) AS pending FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def pending_by_mode(spark: SparkSession, d: str) -> DataFrame:
    return P.counts_by(fx.table(spark, d, "orders").filter("o_orderstatus != 'F'"), F.col("o_orderpriority").alias("mode"), name="pending")


@query("o6_capped_list", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def capped_list(spark: SparkSession, d: str) -> DataFrame:
    return P.capped(fx.table(spark, d, "events").select("event_id", "value"), [F.desc("value"), F.asc("event_id")], 100)


@query("f18_retention", "SELECT event_id AS segment, event_id * 16777216 + 16777216 AS end_lsn FROM events WHERE event_id * 16777216 + 16777216 <= least(9000000000 - 1000000000, 8500000000)")
def retention(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events").select(F.col("event_id").alias("segment"), (F.col("event_id") * P.SEGMENT + P.SEGMENT).alias("end_lsn"))
    return P.trim(e, 9_000_000_000, 1_000_000_000, 8_500_000_000)


@query("t8_resume_choice", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1 WHEN event_id % 4 = 1 THEN 2 WHEN event_id % 4 = 2 THEN 3 ELSE 4 END AS resume FROM events")
def resume_choice(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 4
    return fx.table(spark, d, "events").select("event_id", P.resume_choice(F.when(m == 0, 1), F.when(m <= 1, 2), F.when(m <= 2, 3), F.lit(4)).alias("resume"))


# --- scalar forms -----------------------------------------------------------

_MONTHS, _DAYS, _MICROS = "event_id % 61 - 30", "event_id % 9 - 4", "(event_id % 17 - 8) * 4207099990"


def _part_sql(n: str, one: str) -> str:
    return f"CASE WHEN {n} <> 0 THEN {n} || CASE WHEN abs({n}) = 1 THEN ' {one}' ELSE ' {one}s' END END"


_CLOCK_SQL = "CASE WHEN us < 0 THEN '-' ELSE '' END || lpad(CAST(abs(us) // 3600000000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(us) // 60000000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(us) // 1000000 % 60 AS VARCHAR), 2, '0') || CASE WHEN us % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(abs(us) % 1000000 AS VARCHAR), 6, '0'), '0') END"


@query("n4_interval_text", f"WITH i AS (SELECT event_id, sign({_MONTHS}) * (abs({_MONTHS}) // 12) AS y, sign({_MONTHS}) * (abs({_MONTHS}) % 12) AS mo, {_DAYS} AS d, {_MICROS} AS us FROM events) SELECT event_id, CASE WHEN y = 0 AND mo = 0 AND d = 0 AND us = 0 THEN '00:00:00' ELSE concat_ws(' ', {_part_sql('y', 'year')}, {_part_sql('mo', 'mon')}, {_part_sql('d', 'day')}, CASE WHEN us <> 0 THEN {_CLOCK_SQL} END) END AS text FROM i")
def interval_text(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "events").selectExpr("event_id", f"CAST({_MONTHS} AS INT) AS months", f"CAST({_DAYS} AS INT) AS days", f"{_MICROS} AS micros")
    return rows.select("event_id", N.interval_text(F.col("months"), F.col("days"), F.col("micros")).alias("text"))


_WEST = "(event_id % 97 - 48) * 911"


@query("n5_timetz_text", f"WITH t AS (SELECT event_id, event_id * 863900001 % 86400000000 AS us, {_WEST} AS w FROM events) SELECT event_id, {_CLOCK_SQL} || CASE WHEN w > 0 THEN '-' ELSE '+' END || lpad(CAST(abs(w) // 3600 AS VARCHAR), 2, '0') || CASE WHEN abs(w) % 3600 <> 0 THEN ':' || lpad(CAST(abs(w) // 60 % 60 AS VARCHAR), 2, '0') || CASE WHEN abs(w) % 60 <> 0 THEN ':' || lpad(CAST(abs(w) % 60 AS VARCHAR), 2, '0') ELSE '' END ELSE '' END AS text FROM t")
def timetz_text(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "events").selectExpr("event_id", "event_id * 863900001 % 86400000000 AS micros", f"CAST({_WEST} AS INT) AS west")
    return rows.select("event_id", N.timetz_text(F.col("micros"), F.col("west")).alias("text"))


@query("n6_uuid_text", "SELECT event_id, CAST(CAST(md5(CAST(event_id AS VARCHAR)) AS UUID) AS VARCHAR) AS uuid FROM events")
def uuid_text(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "events").select("event_id", N.uuid_text(F.upper(F.md5(F.col("event_id").cast("string")))).alias("uuid"))


@query("n7_epoch_shift", "SELECT event_id, CAST(DATE '2000-01-01' + CAST(event_id AS INT) AS VARCHAR) AS day, event_id * 1000 + 946684800000000 AS us FROM events UNION ALL SELECT -1, '2000-01-02', 9223372036854775807")
def epoch_shift(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events").select("event_id", F.col("event_id").alias("days"), (F.col("event_id") * 1000).alias("micros"))
    rows = e.unionByName(fx.values(spark, [(-1, 1, (1 << 63) - 5)], "event_id long, days long, micros long"))
    return rows.select("event_id", N.date_text(N.from_source_date(F.col("days"))).alias("day"), N.from_source_micros(F.col("micros")).alias("us"))


@query("n8_time_text", f"WITH t AS (SELECT event_id, event_id * 8639000 % 86400000000 AS us FROM events) SELECT event_id, {_CLOCK_SQL} AS text FROM t")
def time_text(spark: SparkSession, d: str) -> DataFrame:
    """Times of day, over all events."""
    return fx.table(spark, d, "events").select("event_id", N.time_text(F.col("event_id") * 8_639_000 % 86_400_000_000).alias("text"))


@query("n12_valid_text", "SELECT doc_id, TRUE AS is_text FROM documents UNION ALL SELECT -1, FALSE")
def valid_text(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("data")).unionByName(fx.values(spark, [(-1, bytearray(b"\xff\xfe"))], "doc_id long, data binary"))
    return rows.select("doc_id", N.valid_text(F.col("data")).isNotNull().alias("is_text"))


@query("n13_bool_parse", "SELECT event_id, (['t', 'true', 'yes', 'on', '1', 'f', 'no', 'T'])[event_id % 8 + 1] IN ('t', 'true', 'yes', 'on', '1') AS parsed FROM events")
def bool_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("t", "true", "yes", "on", "1", "f", "no", "T"))), (F.col("event_id") % 8 + 1).cast("int"))
    return fx.table(spark, d, "events").select("event_id", N.parse_bool(text).alias("parsed"))


@query("n15_lsn_text", "SELECT event_id, upper(to_hex((event_id * 5000000011) >> 32)) || '/' || upper(to_hex((event_id * 5000000011) & 4294967295)) AS text, event_id * 5000000011 AS parsed, event_id * 5000000011 - event_id * 5000000011 % 16777216 AS aligned FROM events")
def lsn_text(spark: SparkSession, d: str) -> DataFrame:
    lsn = F.col("event_id") * 5_000_000_011
    return fx.table(spark, d, "events").select("event_id", N.lsn_text(lsn).alias("text"), N.parse_lsn(N.lsn_text(lsn)).alias("parsed"), N.align_down(lsn).alias("aligned"))


_P, _S = "p_partkey % 90", "p_partkey // 90 % 80 - 5"


@query("n18_typmod", f"WITH t AS (SELECT p_partkey, {_P} AS p, {_S} AS s, p_partkey % 13 = 0 AS bare FROM part) SELECT p_partkey, CASE WHEN NOT bare THEN p END AS p, CASE WHEN NOT bare THEN s END AS s, CASE WHEN NOT bare AND p BETWEEN 1 AND 76 AND s BETWEEN 0 AND p THEN 'Decimal(' || p || ', ' || s || ')' ELSE 'String' END AS kind FROM t")
def typmod(spark: SparkSession, d: str) -> DataFrame:
    """Precision and scale packed into one number; a scale may be negative, and every 13th has none."""
    own = F.shiftleft(F.expr("p_partkey % 90"), 16) + F.expr("p_partkey div 90 % 80 - 5").bitwiseAND(F.lit(0x7FF)) + 4
    rows = fx.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 13 == 0, -1).otherwise(own).alias("typmod"))
    p, s = N.numeric_typmod(F.col("typmod"))
    return rows.select("p_partkey", p.cast("long").alias("p"), s.cast("long").alias("s"), N.decimal_type(F.col("typmod")).alias("kind"))


_NUMBER = "CASE o_orderkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE '' END || {whole} || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '.' || lpad(CAST(o_custkey % 1000 AS {text}), 3, '0') END"


@query("n2_decimal_truncate", "WITH t AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS whole, CASE WHEN o_orderkey % 4 = 0 THEN '000' ELSE lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') END AS frac, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '' END AS sgn FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey = 0 THEN '0.00' WHEN length(whole) <= 4 THEN sgn || whole || '.' || substr(frac, 1, 2) END AS kept, CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE sgn || ltrim(whole || repeat('7', 45), '0') || '.' || frac || '00' END AS wide FROM t")
def decimal_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Digits behind the scale are cut off, what is too large is NULL, and numbers beyond 38 digits stay text."""
    text = lambda whole: F.when(F.col("o_orderkey") % 50 == 7, F.element_at(F.array(F.lit("NaN"), F.lit("1e5"), F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int"))).otherwise(F.expr(_NUMBER.format(whole=whole, text="STRING")))
    short, wide = text("CAST(o_orderkey AS STRING)"), text("CAST(o_orderkey AS STRING) || repeat('7', 45)")
    return fx.table(spark, d, "orders").select("o_orderkey", N.truncate_decimal(short, 6, 2).cast("string").alias("kept"), N.truncate_decimal(wide, 76, 5).alias("wide"))


@query("n17_value_size", "SELECT event_id, CAST(strlen(event_type) + strlen(props) AS INT) AS size FROM events")
def value_size(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "events").select("event_id", N.value_size(F.col("event_type"), F.col("props"), F.lit(None)).alias("size"))


@query("n19_name_parsing", "SELECT event_id, event_id % 97 AS db, event_id AS node, CASE WHEN event_id % 3 = 0 THEN 2 END AS seg, CASE WHEN event_id % 2 = 0 THEN 'vm' END AS fork, event_id % 4096 AS status_segment FROM events")
def name_parsing(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    path = F.concat(F.lit("base/"), (e % 97).cast("string"), F.lit("/"), e.cast("string"), F.when(e % 2 == 0, "_vm").otherwise(""), F.when(e % 3 == 0, ".2").otherwise(""))
    found = N.relation_path(path)
    return fx.table(spark, d, "events").select("event_id", *[found[c].alias(c) for c in ("db", "node", "seg", "fork")], N.status_segment(F.concat(F.lit("pg_xact/"), F.lpad(F.hex(e % 4096), 4, "0"))).alias("status_segment"))
