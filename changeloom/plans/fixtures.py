"""A deterministic change log over the sample tables, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import dataflow, transactions
from ..operators.ddl import literal

TARGET_DB = 1


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column of either kind."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")
    return F.unix_micros(name)


def log(spark: SparkSession, d: str) -> DataFrame:
    """Changes from ``events``: five of them a writer, twenty a transaction."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    return e.select(
        (F.col("event_id") * 16).alias("lsn"),
        F.lit(0).alias("tuple_idx"),
        F.expr("event_id div 5").alias("xid"),
        F.expr("event_id div 20").alias("top_xid"),
        (F.col("user_id") % 4).alias("rel"),
        F.when(F.col("event_id") % 50 == 0, 2).otherwise(1).alias("db"),
        op.alias("op"),
        F.col("user_id").alias("k"),
        F.col("value").alias("val"),
        micros(e, "ts").alias("ts_us"),
    )


LOG = """WITH log AS (SELECT event_id * 16 AS lsn, 0 AS tuple_idx, event_id // 5 AS xid, event_id // 20 AS top_xid, user_id % 4 AS rel,
  CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS db,
  CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, user_id AS k, value AS val, epoch_us(ts) AS ts_us FROM events)
"""


def ends(changes: DataFrame) -> DataFrame:
    """Every seventh transaction aborts."""
    own = changes.groupBy("top_xid").agg((F.max("lsn") + 8).alias("commit_lsn"), F.max("ts_us").alias("commit_ts"))
    return own.withColumn("outcome", F.when(F.col("top_xid") % 7 == 3, "abort").otherwise("commit"))


ENDS = """, ends AS (SELECT top_xid, max(lsn) + 8 AS commit_lsn, max(ts_us) AS commit_ts, CASE WHEN top_xid % 7 = 3 THEN 'abort' ELSE 'commit' END AS outcome FROM log GROUP BY top_xid)
"""


def aborted_subxids(changes: DataFrame) -> DataFrame:
    return changes.filter("xid % 6 = 1").select("xid").distinct()


COMMITTED = f"""{LOG}{ENDS}, done AS (SELECT l.*, e.commit_lsn, e.commit_ts FROM log l JOIN ends e USING (top_xid) WHERE e.outcome = 'commit' AND l.xid % 6 <> 1)
"""


def committed(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d)
    return transactions.committed(rows, ends(rows), aborted_subxids(rows))


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Destination rows: key, value and the four synthetic columns."""
    return committed(spark, d).select("k", "val", F.col("lsn").alias("_lsn"), "tuple_idx", F.col("xid").alias("_xid"), F.col("commit_ts").alias("_commit_ts"), (F.col("op") == "D").alias("_is_deleted"), "rel")


VERSIONS = f"""{COMMITTED}, v AS (SELECT k, val, lsn AS _lsn, tuple_idx, xid AS _xid, commit_ts AS _commit_ts, op = 'D' AS _is_deleted, rel FROM done)
"""


def values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A literal table as a local relation, so that Spark knows its size."""

    def one(x) -> str:
        if isinstance(x, (list, tuple)):
            return f"array({', '.join(map(one, x))})"
        return "NULL" if x is None else literal(x)

    fields = StructType.fromDDL(columns).fields
    names = ", ".join(f"_{k}" for k in range(len(fields)))
    cast = ", ".join(f"CAST(_{k} AS {f.dataType.simpleString()}) AS `{f.name}`" for k, f in enumerate(fields))
    body = ", ".join(f"({', '.join(map(one, r))})" for r in rows or [(None,) * len(fields)])
    return spark.sql(f"SELECT {cast} FROM VALUES {body} AS t({names}){'' if rows else ' WHERE false'}")


def sql_values(rows: list[tuple], names: str) -> str:
    """The same as SQL: ``(VALUES ...) AS t(names)``."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(one, x)) + "]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({names})"


#: Versions of the four relations: rel, valid_from, kind, version.
TIMELINE = [(0, 0, "Present", 1), (0, 4000, "Present", 2), (0, 90000, "Present", 3), (1, 0, "Present", 1), (1, 6000, "Dropped", 1), (1, 12000, "Present", 2), (2, 2400, "Present", 1), (2, 14000, "Retired", 1), (3, 0, "Present", 1), (3, 50000, "Present", 2)]
TIMELINE_SQL = f"tl AS (SELECT CAST(rel AS BIGINT) AS rel, CAST(valid_from AS BIGINT) AS valid_from, kind, version FROM {sql_values(TIMELINE, 'rel, valid_from, kind, version')}), spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY rel ORDER BY valid_from) AS valid_to FROM tl)"


def timeline(spark: SparkSession) -> DataFrame:
    return values(spark, TIMELINE, "rel long, valid_from long, kind string, version int")


#: Half-open intervals: scope, key, from_lsn, through_lsn.
AMBIGUOUS = [("rel", 0, 3200, 4800), ("rel", 3, 8000, 8800), ("db", 2, 9600, 11200)]
AMBIGUOUS_SQL = f"amb AS (SELECT scope, CAST(key AS BIGINT) AS key, CAST(from_lsn AS BIGINT) AS from_lsn, CAST(through_lsn AS BIGINT) AS through_lsn FROM {sql_values(AMBIGUOUS, 'scope, key, from_lsn, through_lsn')})"


def ambiguous(spark: SparkSession) -> DataFrame:
    return values(spark, AMBIGUOUS, "scope string, key long, from_lsn long, through_lsn long")


#: Routes: rel, valid_from, target (NULL: excluded).
ROUTES = [(0, 0, "app.zero"), (1, 0, None), (1, 7000, "app.one"), (2, 0, "app.two"), (2, 11000, None)]
ROUTES_SQL = f"routes AS (SELECT CAST(rel AS BIGINT) AS rel, CAST(valid_from AS BIGINT) AS valid_from, target FROM {sql_values(ROUTES, 'rel, valid_from, target')})"


def routes(spark: SparkSession) -> DataFrame:
    return values(spark, ROUTES, "rel long, valid_from long, target string")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Log records from ``events`` with a resource manager, the relation nodes of their blocks, and a located relation."""
    e = table(spark, d, "events")
    manager = F.element_at(F.array(*map(F.lit, ("Heap", "Heap2", "Xact", "Btree", "Smgr", "Heap"))), (F.col("event_id") % 6 + 1).cast("int"))
    node = F.lit(20000).cast("bigint") + F.col("user_id") % 5
    n = lambda x: F.lit(x).cast("bigint")
    blocks = F.when(F.col("event_id") % 4 == 0, F.array().cast("array<bigint>")).when(F.col("event_id") % 4 == 1, F.array(n(1259))).when(F.col("event_id") % 4 == 2, F.array(node)).otherwise(F.array(node, n(1249)))
    return e.select((F.col("event_id") * 16).alias("lsn"), F.when(F.col("event_id") % 50 == 0, 2).otherwise(1).alias("db"), manager.alias("rmgr"), blocks.alias("blocks"), F.when(F.col("event_id") % 8 == 0, n(20001)).alias("located"), F.octet_length("props").alias("size"))


RECORDS = """WITH rec AS (SELECT event_id * 16 AS lsn, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS db,
  (['Heap', 'Heap2', 'Xact', 'Btree', 'Smgr', 'Heap'])[event_id % 6 + 1] AS rmgr,
  CASE event_id % 4 WHEN 0 THEN CAST([] AS BIGINT[]) WHEN 1 THEN [CAST(1259 AS BIGINT)] WHEN 2 THEN [20000 + user_id % 5] ELSE [20000 + user_id % 5, CAST(1249 AS BIGINT)] END AS blocks,
  CASE WHEN event_id % 8 = 0 THEN 20001 END AS located, strlen(props) AS size FROM events),
cls AS (SELECT *, CASE WHEN rmgr IN ('Xact', 'Smgr') THEN 'Special' WHEN list_min(blocks) < 16384 THEN 'Catalog' WHEN list_max(blocks) >= 16384 THEN 'User' ELSE 'Empty' END AS class FROM rec)
"""


def catalog_changes(spark: SparkSession, d: str) -> DataFrame:
    """The log with catalog touches: every 13th record, of which every other is a statistics write."""
    e = F.expr("lsn div 16")
    return log(spark, d).withColumns({"is_catalog": e % 13 == 0, "is_opaque": e % 26 == 0, "capture_all": e % 91 == 0, "oid": F.lit(16384).cast("bigint") + F.col("k") % 7})


CATALOG = f"""{LOG}{ENDS}, cat AS (SELECT *, lsn // 16 % 13 = 0 AS is_catalog, lsn // 16 % 26 = 0 AS is_opaque, lsn // 16 % 91 = 0 AS capture_all, 16384 + k % 7 AS oid FROM log)
"""

CHUNK = 2000


def born_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the documents' texts, as first written."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL AND length(text) > 0")
    n = F.ceil(F.length("text") / CHUNK).cast("int")
    rows = docs.select((F.col("doc_id") % 3).alias("relid"), "doc_id", "text", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("_p", "seq"))
    return rows.select("relid", F.col("doc_id").alias("blkno"), F.col("seq").alias("offnum"), F.col("doc_id").alias("chunk_id"), "seq", F.substring("text", F.col("seq") * CHUNK + 1, F.lit(CHUNK)).alias("body"), (F.col("doc_id") * 100 + F.col("seq")).alias("lsn"), F.lit(False).alias("is_deleted"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same; a fifth of the values is tombstoned later, a seventh's first position is taken over."""
    born = born_chunks(spark, d)
    dead = born.filter("chunk_id % 5 = 0").withColumns({"body": F.lit(None).cast("string"), "lsn": F.col("lsn") + 1_000_000, "is_deleted": F.lit(True)})
    taken = born.filter("chunk_id % 7 = 0 AND seq = 0").withColumns({"chunk_id": F.col("chunk_id") + 10_000_000, "body": F.lit("other"), "lsn": F.col("lsn") + 2_000_000})
    return born.unionByName(dead).unionByName(taken)


CHUNKS = f"""WITH docs AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / {CHUNK}.0) AS BIGINT))) AS seq FROM documents WHERE length(text) > 0),
born AS (SELECT doc_id % 3 AS relid, doc_id AS blkno, CAST(seq AS INT) AS offnum, doc_id AS chunk_id, CAST(seq AS INT) AS seq, substring(text, seq * {CHUNK} + 1, {CHUNK}) AS body, doc_id * 100 + seq AS lsn, FALSE AS is_deleted FROM docs),
ch AS (SELECT * FROM born UNION ALL SELECT relid, blkno, offnum, chunk_id, seq, NULL, lsn + 1000000, TRUE FROM born WHERE chunk_id % 5 = 0
  UNION ALL SELECT relid, blkno, offnum, chunk_id + 10000000, seq, 'other', lsn + 2000000, FALSE FROM born WHERE chunk_id % 7 = 0 AND seq = 0)
"""


def pointers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL AND length(text) > 0")
    wrong = F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)
    return docs.select((F.col("doc_id") % 3).alias("relid"), F.col("doc_id").alias("chunk_id"), (F.octet_length("text") + wrong).cast("long").alias("stored_size"))


POINTERS = """, ptr AS (SELECT doc_id % 3 AS relid, doc_id AS chunk_id, CAST(strlen(text) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS stored_size FROM documents WHERE length(text) > 0)
"""


# --- schema logs from the tables --------------------------------------------

#: Versions of many relations, as SQL for both sides: parts are relations, their order lines versions.
SCHEMA_LOG = """SELECT l_partkey AS rel, l_orderkey * 16 + l_linenumber AS valid_from, min(CASE l_returnflag WHEN 'R' THEN 'Dropped' WHEN 'A' THEN 'Retired' ELSE 'Present' END) AS kind, min(l_linenumber % 3) AS version FROM lineitem GROUP BY l_partkey, l_orderkey * 16 + l_linenumber"""
SCHEMA_LOG_SQL = f"tl AS ({SCHEMA_LOG}), spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY rel ORDER BY valid_from) AS valid_to FROM tl)"


def schema_log(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "Dropped").when(F.col("l_returnflag") == "A", "Retired").otherwise("Present")
    return lines.groupBy(F.col("l_partkey").alias("rel"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("valid_from")).agg(F.min(kind).alias("kind"), F.min(F.col("l_linenumber") % 3).alias("version"))


#: Two descriptors of each part taken as a relation, in terms of p (its key), m (p % 16) and i (attnum), for both sides.
_KEPT = {
    "type_oid": "CASE i WHEN 1 THEN 20 WHEN 2 THEN 23 WHEN 3 THEN 25 ELSE 1700 END",
    "typmod": "CASE WHEN i = 4 THEN 655366 ELSE -1 END",
    "len": "CASE i WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE -1 END",
    "align": "CASE WHEN i = 1 THEN 'd' ELSE 'i' END",
    "byval": "i <= 2",
    "storage": "CASE WHEN i <= 2 THEN 'p' WHEN i = 3 THEN 'x' ELSE 'm' END",
}
OLD_ATTRIBUTES = {
    **_KEPT,
    "name": "'c' || CAST(i AS STRING)",
    "type_oid": f"CASE WHEN (m = 8 AND i = 3) OR (m = 9 AND i = 2) THEN 0 ELSE {_KEPT['type_oid']} END",
    "not_null": "i = 1",
    "dropped": "(m = 8 AND i = 3) OR (m = 9 AND i = 2)",
    "missing": "CAST(NULL AS STRING)",
}
NEW_ATTRIBUTES = {
    "name": "CASE WHEN m IN (1, 13) AND i = 2 THEN 'c2b' ELSE 'c' || CAST(i AS STRING) END",
    "type_oid": f"CASE WHEN (m = 7 AND i = 3) OR (m = 9 AND i = 2) THEN 0 WHEN m = 2 AND i = 2 THEN 1082 WHEN m IN (3, 13) AND i = 2 THEN 20 WHEN i = 5 THEN 25 ELSE {_KEPT['type_oid']} END",
    "typmod": "CASE WHEN m = 4 AND i = 4 THEN 786438 WHEN i = 4 THEN 655366 ELSE -1 END",
    "len": f"CASE WHEN m IN (3, 13) AND i = 2 THEN 8 ELSE {_KEPT['len']} END",
    "align": "CASE WHEN i = 1 OR (m IN (3, 13) AND i = 2) THEN 'd' ELSE 'i' END",
    "byval": _KEPT["byval"],
    "storage": "CASE WHEN m = 5 AND i = 3 THEN 'e' WHEN i <= 2 THEN 'p' WHEN i = 4 THEN 'm' ELSE 'x' END",
    "not_null": "i = 1 OR (m = 14 AND i = 2) OR (i = 5 AND m IN (10, 11))",
    "dropped": "(m = 7 AND i = 3) OR (m = 9 AND i = 2)",
    "missing": "CASE WHEN m = 6 AND i = 3 THEN 'x' WHEN m = 11 AND i = 5 THEN '7' END",
}
_HERE = {"old": "i <= 4", "new": "(i <= 4 AND NOT (m = 12 AND i = 4)) OR (i = 5 AND m IN (9, 10, 11, 13))"}
RELATIONS = {
    "old": {"node": "p * 10", "kind": "'r'", "persistence": "'p'", "toast": "p % 2 * 500"},
    "new": {"node": "p * 10 + CASE WHEN m = 15 THEN 1 ELSE 0 END", "kind": "CASE WHEN p % 48 = 16 THEN 'm' ELSE 'r' END", "persistence": "CASE WHEN p % 48 = 32 THEN 'u' ELSE 'p' END", "toast": "CASE WHEN p % 32 = 5 OR m = 4 THEN 600 ELSE p % 2 * 500 END"},
}


def _columns(found: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in found.items())


def _attributes_sql(side: str) -> str:
    found = OLD_ATTRIBUTES if side == "old" else NEW_ATTRIBUTES
    return f"SELECT p AS rel, i AS attnum, {_columns(found)} FROM slots WHERE {_HERE[side]}"


DESCRIPTORS = (
    "WITH ps AS (SELECT p_partkey AS p, p_partkey % 16 AS m FROM part), slots AS (SELECT p, m, CAST(i AS INT) AS i FROM (SELECT p, m, unnest(range(1, 6)) AS i FROM ps)), "
    + ", ".join(f"{side}_attr AS ({_attributes_sql(side).replace('STRING', 'VARCHAR')}), {side}_rel AS (SELECT p AS rel, {_columns(RELATIONS[side])} FROM ps)" for side in ("old", "new"))
    + " "
)


def descriptors(spark: SparkSession, d: str, side: str) -> tuple[DataFrame, DataFrame]:
    """Relations and their attributes, ``old`` or ``new``."""
    found = OLD_ATTRIBUTES if side == "old" else NEW_ATTRIBUTES
    ps = table(spark, d, "part").select(F.col("p_partkey").alias("p"), (F.col("p_partkey") % 16).alias("m"))
    slots = ps.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5)))).filter(_HERE[side])
    return ps.selectExpr("p AS rel", *[f"{e} AS {c}" for c, e in RELATIONS[side].items()]), slots.selectExpr("p AS rel", "i AS attnum", *[f"{e} AS {c}" for c, e in found.items()])


# --- the whole flow ---------------------------------------------------------

#: Documents' lengths by id, to point to; the pointed-to values are the chunks above.
_POINTED = "event_id % 10 = 1"


def flow_changes(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as changes with values by attnum: key, value, a column that came with version 2, and a large value in every tenth."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_id") % 211 == 100, "T").when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    text = lambda c: F.col(c).cast("string")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    long_row = F.col("event_id") % 3 != 0
    new = F.map_from_entries(F.array_compact(F.array(entry(1, text("user_id")), F.when(F.col("event_id") % 11 != 0, entry(2, F.when(F.col("event_id") % 13 != 0, text("value")))), F.when(long_row, entry(3, F.col("event_type"))))))
    docs = table(spark, d, "documents").filter("text IS NOT NULL AND length(text) > 0").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    pointed = e.join(docs, F.expr(_POINTED) & (F.col("event_id") % 200 == F.col("doc_id")), "left")
    pointer = F.struct((F.col("doc_id") % 3).alias("relid"), F.col("doc_id").alias("chunk_id"), F.col("size").alias("raw_size"), F.col("size").alias("stored_size"))
    large = F.when(F.col("doc_id").isNotNull() & (op != "D"), F.create_map(F.lit(4), pointer))
    return pointed.select(
        (F.col("event_id") * 16).alias("lsn"), F.lit(0).alias("tuple_idx"), F.expr("event_id div 5").alias("xid"), F.when(F.col("event_id") % 50 == 0, 2).otherwise(1).cast("long").alias("db"),
        (F.col("user_id") % 4).alias("rel"), op.alias("op"), F.lit(None).cast("long").alias("blkno"), F.lit(None).cast("int").alias("offnum"), F.when(long_row, 4).otherwise(2).alias("natts"),
        F.when(~op.isin("D", "T"), new).alias("new"), F.when(op == "D", F.create_map(F.lit(1), text("user_id"))).alias("old"), large.alias("large"), (F.col("event_id") % 401 == 7).alias("partial"),
    )


def flow_ends(spark: SparkSession, d: str) -> DataFrame:
    """Of twenty events a transaction, its end: every seventh aborts, every fifth was prepared before, some savepoints are undone."""
    e = table(spark, d, "events").select(F.expr("event_id div 20").alias("top"), F.expr("event_id div 5").alias("xid"), "event_id", micros(table(spark, d, "events"), "ts").alias("ts_us"))
    own = e.groupBy("top").agg((F.max("event_id") * 16 + 8).alias("lsn"), F.max("ts_us").alias("ts_us"), F.array_sort(F.collect_set("xid")).alias("subxids"))
    prepared = F.col("top") % 5 == 0
    return own.select(
        "lsn", F.when(prepared, -F.col("top") - 1).otherwise(F.col("top") + 10_000_000).alias("xid"), F.when(F.col("top") % 7 == 3, "abort").otherwise("commit").alias("outcome"),
        F.when(prepared, F.col("top") + 10_000_000).alias("twophase_xid"), "subxids", F.filter("subxids", lambda x: x % 6 == 1).alias("rolled_back"), "ts_us",
    )


def flow_timelines(spark: SparkSession, d: str) -> dataflow.Timelines:
    columns = [(1, "k", "bigint", "true", "NULL"), (2, "val", "double", "false", "NULL"), (3, "kind", "string", "false", "'none'"), (4, "body", "string", "false", "NULL")]
    of = lambda *k: "array(" + ", ".join(f"named_struct('attnum', {n}, 'name', '{name}', 'type', '{kind}', 'not_null', {not_null}, 'dropped', false, 'missing', CAST({missing} AS STRING))" for n, name, kind, not_null, missing in (columns[i] for i in k)) + ")"
    attributes = F.expr(f"CASE WHEN version = 1 THEN {of(0, 1)} ELSE {of(0, 1, 2, 3)} END").cast(dataflow.ATTRIBUTES)
    schemas = timeline(spark).withColumn("attributes", attributes)
    return dataflow.Timelines(schemas, routes(spark), ambiguous=ambiguous(spark), store=chunks(spark, d), target_db=TARGET_DB)


def flow(spark: SparkSession, d: str) -> dataflow.Flow:
    _, _, done = dataflow.with_outcomes(flow_changes(spark, d), flow_ends(spark, d))
    return dataflow.flow(done, flow_timelines(spark, d))


#: The same by SQL: ``kept`` are the versions, ``bad`` the refused transactions, ``cut`` the last truncates.
FLOW = CHUNKS + f""", ev AS (SELECT event_id, event_id * 16 AS lsn, event_id // 20 AS top, event_id // 5 AS xid, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS db, user_id % 4 AS rel, user_id, value, event_type,
  CASE WHEN event_id % 211 = 100 THEN 'T' WHEN event_type = 'signup' THEN 'I' WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op, event_id % 3 <> 0 AS long_row FROM events),
fin AS (SELECT event_id // 20 AS top, max(event_id) * 16 + 8 AS commit_lsn, max(epoch_us(ts)) AS commit_ts FROM events GROUP BY 1),
com AS (SELECT ev.*, commit_lsn, commit_ts FROM ev JOIN fin USING (top) WHERE top % 7 <> 3 AND xid % 6 <> 1 AND db = 1),
cut AS (SELECT rel, max(lsn) AS cut FROM com WHERE op = 'T' GROUP BY rel),
{TIMELINE_SQL}, {ROUTES_SQL}, {AMBIGUOUS_SQL},
rs AS (SELECT *, lead(valid_from) OVER (PARTITION BY rel ORDER BY valid_from) AS valid_to FROM routes),
rt AS (SELECT com.*, rs.target FROM com LEFT JOIN rs ON rs.rel = com.rel AND commit_lsn >= rs.valid_from AND (rs.valid_to IS NULL OR commit_lsn < rs.valid_to) WHERE op <> 'T'),
sh AS (SELECT rt.*, CASE WHEN s.kind = 'Present' THEN s.version END AS version FROM rt LEFT JOIN spans s ON s.rel = rt.rel AND rt.lsn >= s.valid_from AND (s.valid_to IS NULL OR rt.lsn < s.valid_to) WHERE target IS NOT NULL),
ju AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM amb WHERE lsn >= from_lsn AND lsn < through_lsn AND ((scope = 'rel' AND key = rel) OR (scope = 'db' AND key = db))) THEN 'ambiguous_interval'
  WHEN version IS NULL THEN 'missing_verdict' WHEN event_id % 401 = 7 THEN 'partial_update' ELSE 'apply' END AS verdict FROM sh),
bad AS (SELECT DISTINCT top FROM ju WHERE verdict <> 'apply'),
pt AS (SELECT j.lsn AS as_of, doc_id % 3 AS relid, doc_id AS want, strlen(text) AS stored FROM ju j JOIN documents ON {_POINTED} AND event_id % 200 = doc_id WHERE op <> 'D' AND length(text) > 0),
cand AS (SELECT p.as_of, p.want, p.stored, c.* FROM pt p JOIN (SELECT DISTINCT relid, blkno, offnum, chunk_id FROM ch) s ON s.relid = p.relid AND s.chunk_id = p.want JOIN ch c ON c.relid = s.relid AND c.blkno = s.blkno AND c.offnum = s.offnum AND c.lsn <= p.as_of),
fr AS (SELECT *, row_number() OVER (PARTITION BY as_of, want, relid, blkno, offnum ORDER BY lsn DESC) AS rn FROM cand),
val AS (SELECT as_of, want, stored, count(*) AS n, max(seq) AS top_seq, string_agg(body, '' ORDER BY seq) AS body FROM fr WHERE rn = 1 AND NOT is_deleted AND chunk_id = want GROUP BY ALL),
kept AS (SELECT j.*, CASE WHEN op = 'D' THEN NULL WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS val,
  CASE WHEN version < 2 THEN NULL WHEN NOT long_row THEN 'none' WHEN op <> 'D' THEN event_type END AS kind,
  CASE WHEN version >= 2 AND long_row AND op <> 'D' AND n = top_seq + 1 AND strlen(body) = stored THEN md5(body) END AS body FROM ju j LEFT JOIN val ON val.as_of = j.lsn WHERE top NOT IN (SELECT top FROM bad))
"""
