"""Queries of schema timelines, large values, routing and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing as G
from ..operators import timeline as T
from ..operators import values as V
from . import fixtures as fx
from .registry import query

_ASOF = fx.LOG + ", " + fx.TIMELINE_SQL + ", a AS (SELECT l.*, s.kind, s.version, s.valid_from FROM log l LEFT JOIN spans s ON l.rel = s.rel AND l.lsn >= s.valid_from AND (s.valid_to IS NULL OR l.lsn < s.valid_to)) "


# --- schema timeline --------------------------------------------------------


@query("j1_asof_schema", _ASOF + "SELECT lsn, rel, CASE WHEN db <> 1 THEN 'ForeignDb' ELSE coalesce(kind, 'NotCovered') END AS outcome, version FROM a")
def asof_schema(spark: SparkSession, d: str) -> DataFrame:
    rows = T.asof(fx.log(spark, d), fx.timeline(spark), ["rel"])
    return rows.select("lsn", "rel", T.asof_outcome(target_db=fx.TARGET_DB).alias("outcome"), "version")


@query("j2_asof_by_oid", _ASOF + "SELECT rel + 16384 AS oid, coalesce(kind, 'NotCovered') AS outcome, count(*) AS n FROM a WHERE db = 1 AND op = 'D' GROUP BY ALL")
def asof_by_oid(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.log(spark, d).filter("db = 1 AND op = 'D'").withColumn("oid", F.col("rel") + 16384)
    by_oid = fx.timeline(spark).withColumn("oid", F.col("rel") + 16384).drop("rel")
    return T.asof(rows, by_oid, ["oid"]).groupBy("oid", T.asof_outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("j3_ambiguity_point", fx.LOG + ", " + fx.AMBIGUOUS_SQL + " SELECT lsn, rel, db FROM log WHERE EXISTS (SELECT 1 FROM amb WHERE lsn >= from_lsn AND lsn < through_lsn AND ((scope = 'rel' AND key = rel) OR (scope = 'db' AND key = db)))")
def ambiguity_point(spark: SparkSession, d: str) -> DataFrame:
    return T.with_inside(fx.log(spark, d), fx.ambiguous(spark), {"rel": "rel", "db": "db"}).filter("inside").select("lsn", "rel", "db")


@query("j4_ambiguity_overlap", fx.LOG + ", " + fx.AMBIGUOUS_SQL + ", st AS (SELECT top_xid, rel, min(lsn) AS first_lsn, max(lsn) + 1 AS last_lsn FROM log GROUP BY ALL) SELECT top_xid, rel FROM st WHERE EXISTS (SELECT 1 FROM amb WHERE scope = 'rel' AND key = rel AND first_lsn < through_lsn AND from_lsn < last_lsn)")
def ambiguity_overlap(spark: SparkSession, d: str) -> DataFrame:
    spans = fx.log(spark, d).groupBy("top_xid", "rel").agg(F.min("lsn").alias("first_lsn"), (F.max("lsn") + 1).alias("last_lsn"))
    return T.with_overlap(spans, fx.ambiguous(spark), {"rel": "rel"}).filter("overlaps").select("top_xid", "rel")


_PENDING = "pend AS (SELECT rel, top_xid, min(lsn) + 40 AS valid_from, CAST(100 + top_xid % 5 AS INT) AS version FROM log WHERE top_xid % 5 = 0 GROUP BY rel, top_xid)"
_PENDING_SQL = fx.LOG + ", " + fx.TIMELINE_SQL + ", " + _PENDING + ", j AS (SELECT l.lsn, l.rel, p.version AS own, s.version AS base FROM log l LEFT JOIN pend p ON p.rel = l.rel AND p.top_xid = l.top_xid AND l.lsn >= p.valid_from LEFT JOIN spans s ON l.rel = s.rel AND l.lsn >= s.valid_from AND (s.valid_to IS NULL OR l.lsn < s.valid_to)) "


def _pending(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.log(spark, d)
    own = rows.filter("top_xid % 5 = 0").groupBy("rel", "top_xid").agg((F.min("lsn") + 40).alias("valid_from"), F.first((F.lit(100) + F.col("top_xid") % 5).cast("int")).alias("version"))
    return T.asof_with_pending(rows, fx.timeline(spark), own, ["rel"], "version")


@query("j5_pending_shape", _PENDING_SQL + "SELECT lsn, rel, coalesce(own, base) AS version, own IS NOT NULL AS is_pending FROM j")
def pending_shape(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).select("lsn", "rel", "version", "is_pending")


@query("b4_schema_in_xact", _PENDING_SQL + "SELECT coalesce(own, base) AS version, count(*) AS n FROM j GROUP BY 1")
def schema_in_xact(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


@query("j6_present_before", fx.LOG + ", " + fx.TIMELINE_SQL + " SELECT lsn, rel, (SELECT arg_max(version, valid_from) FROM tl WHERE tl.rel = log.rel AND kind = 'Present' AND valid_from <= lsn) AS version FROM log")
def present_before(spark: SparkSession, d: str) -> DataFrame:
    return T.asof_where(fx.log(spark, d), fx.timeline(spark), ["rel"], F.col("kind") == "Present").select("lsn", "rel", "version")


@query("w1_validity_intervals", "WITH " + fx.SCHEMA_LOG_SQL + " SELECT rel, kind, version, valid_from, valid_to FROM spans")
def validity_intervals(spark: SparkSession, d: str) -> DataFrame:
    return T.validity(fx.schema_log(spark, d), ["rel"]).select("rel", "kind", "version", "valid_from", "valid_to")


@query("w3_schema_events", "WITH " + fx.SCHEMA_LOG_SQL + ", p AS (SELECT *, lag(kind) OVER w AS pk, lag(version) OVER w AS pv FROM tl WINDOW w AS (PARTITION BY rel ORDER BY valid_from)) SELECT rel AS oid, valid_from AS captured_at, CASE WHEN kind <> 'Present' THEN 'Dropped' WHEN pk IS NULL OR pk <> 'Present' THEN 'Added' WHEN version <> pv THEN 'Changed' ELSE 'Kept' END AS event FROM p")
def schema_events(spark: SparkSession, d: str) -> DataFrame:
    log = fx.schema_log(spark, d).select(F.col("rel").alias("oid"), F.col("valid_from").alias("captured_at"), "kind", "version")
    return T.schema_events(log).select("oid", "captured_at", "event")


_FENCES = "SELECT o_orderkey AS rel, CASE o_orderkey % 3 WHEN 0 THEN 'benign' ELSE 'physical' END AS verdict, o_orderkey % 5 = 0 AS rotated, o_custkey * 10 AS first_touch, o_custkey * 8 + o_orderkey % 9000 AS covered, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey * 9 + 500 END AS next_from FROM orders"


@query("d9_inplace_verdict", f"WITH f AS ({_FENCES}) SELECT rel, first_touch AS from_lsn, least(covered, coalesce(next_from, covered)) AS through_lsn FROM f WHERE verdict = 'physical' AND NOT rotated AND first_touch < least(covered, coalesce(next_from, covered))")
def inplace_verdict(spark: SparkSession, d: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    verdicts = fx.table(spark, d, "orders").select(key.alias("rel"), F.when(key % 3 == 0, "benign").otherwise("physical").alias("verdict"), (key % 5 == 0).alias("rotated"), (cust * 10).alias("first_touch"), (cust * 8 + key % 9000).alias("covered"), F.when(key % 4 != 0, cust * 9 + 500).alias("next_from"))
    return T.ambiguity(verdicts)


@query("d11_log_gc", "WITH " + fx.SCHEMA_LOG_SQL + " SELECT rel, valid_from, kind FROM spans WHERE valid_from >= 7000 OR ((valid_to IS NULL OR valid_to > 7000) AND kind = 'Present')")
def log_gc(spark: SparkSession, d: str) -> DataFrame:
    return T.collect_garbage(fx.schema_log(spark, d), ["rel"], 7000).select("rel", "valid_from", "kind")


@query("j9_descriptor_assembly", "SELECT n_nationkey AS oid, r_name AS ns, count(c_custkey) AS n_columns, string_agg(c_name, ',' ORDER BY c_custkey) AS names, (SELECT string_agg(CAST(x AS VARCHAR), ',') FROM (SELECT s_suppkey AS x FROM supplier WHERE s_nationkey = n_nationkey ORDER BY x)) AS keys FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL".replace("(SELECT string_agg(CAST(x AS VARCHAR), ',') FROM (SELECT s_suppkey AS x FROM supplier WHERE s_nationkey = n_nationkey ORDER BY x))", "coalesce((SELECT string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '')"))
def descriptor_assembly(spark: SparkSession, d: str) -> DataFrame:
    classes = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("oid"), F.col("n_regionkey").alias("ns_oid"))
    names = fx.table(spark, d, "region").select(F.col("r_regionkey").alias("ns_oid"), F.col("r_name").alias("ns"))
    attributes = fx.table(spark, d, "customer").select(F.col("c_nationkey").alias("oid"), F.col("c_custkey").alias("attnum"), F.col("c_name").alias("name"), F.lit(25).alias("type_oid"), F.lit(False).alias("not_null"))
    keys = fx.table(spark, d, "supplier").select(F.col("s_nationkey").alias("oid"), F.col("s_suppkey").cast("int").alias("attnum"))
    out = T.assemble_descriptors(classes, attributes, names, keys)
    return out.select("oid", "ns", F.size("attributes").cast("long").alias("n_columns"), F.array_join(F.transform("attributes", lambda a: a["name"]), ",").alias("names"), F.array_join(F.transform("key_attnums", lambda a: a.cast("string")), ",").alias("keys"))


# --- large values -----------------------------------------------------------


@query("a3_reassemble", fx.CHUNKS + fx.POINTERS + ", g AS (SELECT p.relid, p.chunk_id, stored_size, string_agg(body, '' ORDER BY seq) AS value, max(seq) + 1 = count(*) AS dense FROM ptr p JOIN born b ON p.relid = b.relid AND p.chunk_id = b.chunk_id WHERE NOT (p.chunk_id % 13 = 0 AND seq = 1) GROUP BY ALL) SELECT relid, chunk_id, CASE WHEN dense AND strlen(value) = stored_size THEN 'Assembled' ELSE 'Mismatch' END AS status, CASE WHEN dense AND strlen(value) = stored_size THEN md5(value) END AS digest FROM g")
def reassemble(spark: SparkSession, d: str) -> DataFrame:
    """A value that lacks a chunk in the middle or at its end, or is of another size, is a mismatch."""
    born = fx.born_chunks(spark, d).filter("NOT (chunk_id % 13 = 0 AND seq = 1)")
    both = born.join(fx.pointers(spark, d), ["relid", "chunk_id"])
    return V.reassemble(both, ["relid", "chunk_id"]).select("relid", "chunk_id", "status", F.md5("value").alias("digest"))


@query("j13_inxact_detoast", fx.CHUNKS + fx.POINTERS + ", g AS (SELECT p.chunk_id % 20 AS top_xid, p.relid, p.chunk_id, stored_size, string_agg(body, '' ORDER BY seq) AS value, max(seq) + 1 = count(*) AND min(seq) = 0 AS dense FROM ptr p JOIN born b ON p.relid = b.relid AND p.chunk_id = b.chunk_id WHERE NOT (p.chunk_id % 17 = 0 AND seq = 0) GROUP BY ALL) SELECT top_xid, relid, chunk_id, CASE WHEN dense AND strlen(value) = stored_size THEN 'Assembled' ELSE 'Mismatch' END AS status, CASE WHEN dense AND strlen(value) = stored_size THEN md5(value) END AS digest FROM g")
def inxact_detoast(spark: SparkSession, d: str) -> DataFrame:
    """Values from the chunks of their own transaction; of some the first chunk is in another."""
    born = fx.born_chunks(spark, d).withColumn("top_xid", F.col("chunk_id") % 20 + F.when((F.col("chunk_id") % 17 == 0) & (F.col("seq") == 0), 1000).otherwise(0))
    own = fx.pointers(spark, d).withColumn("top_xid", F.col("chunk_id") % 20)
    return V.fetch_in_transaction(born, own).select("top_xid", "relid", "chunk_id", "status", F.md5("value").alias("digest"))


_ALIVE = ", last AS (SELECT *, row_number() OVER (PARTITION BY relid, blkno, offnum ORDER BY lsn DESC) AS rn FROM ch WHERE lsn <= {upto}), alive AS (SELECT * FROM last WHERE rn = 1 AND NOT is_deleted)"


def _asof_sql(upto: int) -> str:
    return fx.CHUNKS + fx.POINTERS + _ALIVE.format(upto=upto) + ", got AS (SELECT p.relid, p.chunk_id, p.stored_size, count(seq) AS n, max(seq) AS top, string_agg(body, '' ORDER BY seq) AS value FROM ptr p LEFT JOIN alive a ON p.relid = a.relid AND p.chunk_id = a.chunk_id GROUP BY ALL), st AS (SELECT *, CASE WHEN n = 0 THEN 'Missing' WHEN top + 1 <> n OR strlen(value) <> stored_size THEN 'Mismatch' ELSE 'Assembled' END AS status FROM got) "


@query("j14_asof_fetch", _asof_sql(1_500_000) + "SELECT relid, chunk_id, status, CASE WHEN status = 'Assembled' THEN md5(value) END AS digest FROM st")
def asof_fetch(spark: SparkSession, d: str) -> DataFrame:
    return V.fetch_asof(fx.chunks(spark, d), fx.pointers(spark, d).withColumn("at", F.lit(1_500_000).cast("long"))).select("relid", "chunk_id", "status", F.md5("value").alias("digest"))


@query("v3_asof_after_takeover", _asof_sql(9_000_000_000) + "SELECT status, count(*) AS n FROM st GROUP BY 1")
def asof_after_takeover(spark: SparkSession, d: str) -> DataFrame:
    return V.fetch_asof(fx.chunks(spark, d), fx.pointers(spark, d).withColumn("at", F.lit(9_000_000_000))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("j15_residual_tombstones", fx.CHUNKS + _ALIVE.format(upto=1_500_000) + " SELECT relid, blkno, offnum FROM alive WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.lsn > 1500000 AND ch.relid = alive.relid AND ch.blkno = alive.blkno AND ch.offnum = alive.offnum)")
def residual_tombstones(spark: SparkSession, d: str) -> DataFrame:
    store = fx.chunks(spark, d)
    return V.residual(store, store, F.lit(1_500_000))


_POLICY = "CASE WHEN status = 'Assembled' THEN 'filled' WHEN chunk_id % 4 = 0 THEN 'error_gap' WHEN chunk_id % 4 = 1 THEN 'filled_default' WHEN chunk_id % 4 = 2 THEN 'error_no_mirror' WHEN status = 'Mismatch' THEN 'filled_mismatch' ELSE 'filled_superseded' END"


@query("v4_miss_policy", _asof_sql(1_500_000) + f"SELECT {_POLICY} AS outcome, count(*) AS n FROM st GROUP BY 1")
def miss_policy(spark: SparkSession, d: str) -> DataFrame:
    got = V.fetch_asof(fx.chunks(spark, d), fx.pointers(spark, d).withColumn("at", F.lit(1_500_000).cast("long")))
    m = F.col("chunk_id") % 4
    return got.groupBy(V.miss_policy(m != 1, m == 0, F.col("status"), m != 2).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("v5_value_cap", "SELECT doc_id FROM documents WHERE greatest(strlen(text) * 2, strlen(text)) > 20000")
def value_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "documents").select("doc_id", (F.octet_length("text") * 2).alias("raw"), F.octet_length("text").alias("stored"))
    return rows.filter(V.over_cap("raw", "stored", 20_000)).select("doc_id")


@query("j19_due_retires", fx.LOG + fx.ENDS + "SELECT top_xid, commit_lsn FROM ends WHERE outcome = 'commit' AND commit_lsn <= 8000")
def due_retires(spark: SparkSession, d: str) -> DataFrame:
    return V.due_retires(fx.ends(fx.log(spark, d)).filter("outcome = 'commit'"), 8000).select("top_xid", "commit_lsn")


# --- routing and configuration ----------------------------------------------

_LAST_ROUTE = ", lr AS (SELECT rel, arg_max_null(target, valid_from) AS target FROM routes GROUP BY rel)"


def _last_routes(spark: SparkSession) -> DataFrame:
    return fx.routes(spark).groupBy("rel").agg(F.max_by("target", "valid_from").alias("target"))


@query("j10_route", fx.LOG + ", " + fx.ROUTES_SQL + _LAST_ROUTE + " SELECT lsn, log.rel, target FROM log JOIN lr ON lr.rel = log.rel WHERE target IS NOT NULL")
def routed(spark: SparkSession, d: str) -> DataFrame:
    return G.routed(fx.log(spark, d), _last_routes(spark)).select("lsn", "rel", "target")


@query("f11_unmapped_discard", fx.LOG + ", " + fx.ROUTES_SQL + _LAST_ROUTE + " SELECT rel, count(*) AS n FROM log WHERE rel NOT IN (SELECT rel FROM lr WHERE target IS NOT NULL) GROUP BY rel")
def unmapped(spark: SparkSession, d: str) -> DataFrame:
    return G.unmapped_counts(fx.log(spark, d), _last_routes(spark))


@query("b3_config_whole_xact", fx.COMMITTED + ", " + fx.ROUTES_SQL + " SELECT lsn, rel, (SELECT arg_max_null(target, valid_from) FROM routes r WHERE r.rel = done.rel AND valid_from <= commit_lsn) AS target FROM done WHERE target IS NOT NULL".replace("FROM done WHERE target IS NOT NULL", "FROM done WHERE (SELECT arg_max_null(target, valid_from) FROM routes r WHERE r.rel = done.rel AND valid_from <= commit_lsn) IS NOT NULL"))
def config_whole_xact(spark: SparkSession, d: str) -> DataFrame:
    return G.route_whole_transactions(fx.committed(spark, d), fx.routes(spark)).select("lsn", "rel", "target")


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Committed rows with old and new images; a column is absent every 11th row, NULL every 13th."""
    e = F.expr("lsn div 16")
    new = F.struct(F.col("k").alias("k"), F.when(e % 13 != 0, F.col("val")).alias("val"))
    old = F.struct(F.col("k").alias("k"), (-F.col("val")).alias("val"))
    return fx.committed(spark, d).withColumns({"new": new, "old": old, "has_val": e % 11 != 0})


@query("p1_mapped_projection", fx.COMMITTED + "SELECT lsn, k, CASE WHEN op = 'D' THEN -val WHEN lsn // 16 % 13 = 0 THEN NULL ELSE val END AS val FROM done")
def mapped_projection(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d).select("lsn", G.project("k").alias("k"), G.project("val").alias("val"))


@query("p2_default_coercion", fx.COMMITTED + ", i AS (SELECT lsn, CASE WHEN lsn // 16 % 13 = 0 OR lsn // 16 % 11 = 0 THEN NULL ELSE val END AS v FROM done) SELECT lsn, v AS nullable, coalesce(v, 0.0) AS plain, CASE WHEN v IS NULL THEN '' ELSE 'x' END AS text FROM i")
def default_coercion(spark: SparkSession, d: str) -> DataFrame:
    rows, v = _images(spark, d), F.col("new.val")
    return rows.select("lsn", G.coerce(v, F.col("has_val"), "double", True).alias("nullable"), G.coerce(v, F.col("has_val"), "double", False).alias("plain"), G.coerce(F.when(v.isNotNull(), "x"), F.col("has_val"), "string", False).alias("text"))


@query("p3_synthetic_columns", fx.COMMITTED + "SELECT k, lsn AS _lsn, xid AS _xid, commit_ts AS _commit_ts, op = 'D' AS _is_deleted FROM done")
def synthetic(spark: SparkSession, d: str) -> DataFrame:
    return G.synthetic(fx.committed(spark, d)).select("k", "_lsn", "_xid", "_commit_ts", "_is_deleted")


@query("p4_missing_defaults", fx.COMMITTED + "SELECT lsn, CASE WHEN lsn // 16 % 4 + 1 < 3 THEN 7.0 WHEN lsn // 16 % 13 = 0 THEN NULL ELSE val END AS c FROM done")
def missing_defaults(spark: SparkSession, d: str) -> DataFrame:
    n_atts = F.expr("lsn div 16") % 4 + 1
    return _images(spark, d).select("lsn", G.with_missing_default(F.col("new.val"), 3, n_atts, F.lit(7.0)).alias("c"))


@query("p7_partial_rejection", fx.COMMITTED + ", torn AS (SELECT DISTINCT top_xid FROM done WHERE lsn // 16 % 101 = 5) SELECT top_xid, count(*) AS n, top_xid IN (SELECT top_xid FROM torn) AS refused FROM done GROUP BY top_xid")
def partial_rejection(spark: SparkSession, d: str) -> DataFrame:
    """Every 101st row is there only in part, and takes its transaction with it."""
    whole, torn = G.without_partial(fx.committed(spark, d).withColumn("partial", F.expr("lsn div 16") % 101 == 5))
    both = G.reject_partial(whole).withColumn("refused", F.lit(False)).unionByName(torn.withColumn("refused", F.lit(True)))
    return both.groupBy("top_xid", "refused").agg(F.count(F.lit(1)).alias("n"))


_KINDS = ("Decimal(10, 2)", "Decimal(20, 4)", "Decimal(10, 0)", "String", "Int32", "Int64", "UInt64", "UInt32", "Float32", "UUID", "UInt128", "Int128", "Bool", "DateTime64(6, 'UTC')")
_KINDS_SQL = "[" + ", ".join("'" + k.replace("'", "''") + "'" for k in _KINDS) + "]"
_WIDE = "CASE regexp_extract({}, '^[A-Za-z0-9]+') WHEN 'Int32' THEN 4 WHEN 'UInt32' THEN 4 WHEN 'Float32' THEN 4 WHEN 'Int64' THEN 8 WHEN 'UInt64' THEN 8 WHEN 'DateTime64' THEN 8 WHEN 'UUID' THEN 16 WHEN 'UInt128' THEN 16 WHEN 'Int128' THEN 16 WHEN 'Bool' THEN 1 END"


@query("p8_type_override", f"WITH t AS (SELECT p_partkey, {_KINDS_SQL}[p_partkey % {len(_KINDS)} + 1] AS was, {_KINDS_SQL}[p_partkey // {len(_KINDS)} % {len(_KINDS)} + 1] AS asked FROM part) SELECT p_partkey, was, asked, coalesce(CASE WHEN was LIKE 'Decimal%' THEN asked LIKE 'Decimal%' OR asked = 'String' OR (was LIKE '%, 0)' AND asked IN ('Int32', 'Int64', 'Int128')) WHEN was = 'String' THEN asked = 'String' WHEN asked LIKE 'Decimal%' THEN FALSE ELSE {_WIDE.format('was')} = {_WIDE.format('asked')} END, FALSE) AS allowed FROM t")
def type_override(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda i: F.element_at(F.array(*map(F.lit, _KINDS)), (i % len(_KINDS) + 1).cast("int"))
    rows = fx.table(spark, d, "part").select("p_partkey", pick(F.col("p_partkey")).alias("was"), pick(F.expr(f"p_partkey div {len(_KINDS)}")).alias("asked"))
    return rows.select("p_partkey", "was", "asked", G.override_allowed("was", "asked").alias("allowed"))


@query("g1_config_events", fx.COMMITTED + "SELECT lsn, op = 'D' AS removed, 'r' || rel AS scope, CASE WHEN op = 'D' OR lsn // 16 % 11 = 0 THEN 'old' ELSE 'new' END AS value FROM done WHERE rel = 3")
def config_events(spark: SparkSession, d: str) -> DataFrame:
    scope = F.concat(F.lit("r"), F.col("rel").cast("string"))
    image = lambda v: F.struct(scope.alias("scope"), F.col("k").alias("key"), v.alias("value"))
    rows = fx.committed(spark, d).filter("rel = 3").withColumns({"rel_name": F.lit("config_table"), "new": image(F.when(F.expr("lsn div 16") % 11 != 0, F.lit("new"))), "old": image(F.lit("old"))})
    return G.config_events(rows).select("lsn", "removed", "scope", "value")


_LAYERS = {"file": ("c_custkey % 2 = 0", "c_custkey * 2"), "overlay": ("c_custkey % 3 = 0", "CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_custkey * 3 END"), "cli": ("c_custkey % 7 = 0", "c_custkey * 7")}


@query("g2_layered_resolve", "WITH v AS (SELECT c_name AS key, " + ", ".join(f"CASE WHEN {when} AND {value} > 0 THEN {value} END AS {name}" for name, (when, value) in _LAYERS.items()) + ", c_custkey AS base FROM customer) SELECT key, CAST(coalesce(cli, overlay, file, base) AS VARCHAR) AS value, CASE WHEN cli IS NOT NULL THEN 'cli' WHEN overlay IS NOT NULL THEN 'overlay' WHEN file IS NOT NULL THEN 'file' ELSE 'default' END AS source FROM v")
def layered_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Settings of each customer; some of the overlay's are refused, so the layer below stays."""
    c = fx.table(spark, d, "customer")
    layers = [c.filter(when).selectExpr("c_name AS key", f"CAST({value} AS STRING) AS value") for when, value in [("true", "c_custkey"), *_LAYERS.values()]]
    return G.layered(*layers, valid=F.col("value").cast("long") > 0)


@query("g3_opt_in_out", "WITH c AS (SELECT c_name AS rel_name, CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS replicate FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'later', TRUE) SELECT coalesce(r.c_name, c.rel_name) AS rel_name, CASE WHEN r.c_custkey % 10 = 0 THEN 'excluded' WHEN r.c_name IS NULL THEN 'parked' WHEN replicate IS NULL THEN 'derived' WHEN replicate THEN 'replicated' ELSE 'excluded' END AS state FROM customer r FULL JOIN c ON c.rel_name = r.c_name")
def opt_in_out(spark: SparkSession, d: str) -> DataFrame:
    own = fx.table(spark, d, "customer").select(F.col("c_name").alias("rel_name"), "c_custkey")
    asked = own.filter("c_custkey % 2 = 0").select("rel_name", F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False).alias("replicate"))
    return G.opt_in_out(own, asked.unionByName(fx.values(spark, [("later", True)], "rel_name string, replicate boolean")), own.filter("c_custkey % 10 = 0"))


@query("d6_drop_strategy", "SELECT r_name AS rel_ns, n_name AS rel_name, CASE r_regionkey WHEN 0 THEN 'drop' WHEN 1 THEN 'warn' ELSE 'retain' END AS strategy FROM nation JOIN region ON n_regionkey = r_regionkey")
def drop_strategy(spark: SparkSession, d: str) -> DataFrame:
    regions = fx.table(spark, d, "region")
    dropped = fx.table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("rel_ns"), F.col("n_name").alias("rel_name"))
    chosen = regions.filter("r_regionkey < 2").select(F.col("r_name").alias("rel_ns"), F.when(F.col("r_regionkey") == 0, "drop").otherwise("warn").alias("strategy"))
    return G.drop_strategy(dropped, chosen)
