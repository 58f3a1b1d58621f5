"""Queries of sources and sinks, tables that follow their schema, and forms of names, literals and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raw as B
from ..functions import scalars as N
from ..operators import backfill, ddl, progress, routing, timeline
from ..sources import segments, sinks
from ..sources.shared import new_path
from . import fixtures as fx
from .registry import query

# --- sources and sinks ------------------------------------------------------

_SPAN = 1 << 14


def _segments(spark: SparkSession, d: str) -> str:
    path = new_path(spark, "segments")
    log = fx.log(spark, d).select("lsn", "tuple_idx", F.lit("row").alias("kind"), "xid", "rel", "op")
    segments.write_segments(log, path, _SPAN)
    return path


@query("s8_archive_range", fx.LOG + "SELECT lsn, rel, op FROM log WHERE lsn > 3000 AND lsn <= 90000")
def archive_range(spark: SparkSession, d: str) -> DataFrame:
    """S7, S8. Segments in a store, and of those the records of a range."""
    return segments.read_range(spark, _segments(spark, d), 3000, 90000).select("lsn", "rel", "op")


@query("k4_segment_files", fx.LOG + f"SELECT lsn // {_SPAN} * {_SPAN} AS start, lsn // {_SPAN} * {_SPAN} + {_SPAN} AS stop FROM log GROUP BY ALL")
def segment_files(spark: SparkSession, d: str) -> DataFrame:
    return fx.values(spark, [(a, b) for a, b, _ in segments.list_segments(_segments(spark, d))], "start long, stop long")


@query("k1_append_retried", fx.LOG + "SELECT lsn, k, val FROM log")
def append_retried(spark: SparkSession, d: str) -> DataFrame:
    """T6, T7. Three batches, the second of which is written twice."""
    rows, path = fx.log(spark, d).select("lsn", "k", "val"), new_path(spark, "appended")
    for batch in (0, 1, 1, 2):
        sinks.append(rows.filter(F.expr("lsn div 16") % 3 == batch), path, batch)
    return spark.read.parquet(path).select("lsn", "k", "val")


@query("k2_null_sink", fx.LOG + "SELECT count(*) AS rows, count(*) FILTER (WHERE op = 'I') AS inserts, count(*) FILTER (WHERE op = 'U') AS updates, count(*) FILTER (WHERE op = 'D') AS deletes FROM log")
def null_sink(spark: SparkSession, d: str) -> DataFrame:
    """K7, A12. What passes is counted, and kept nowhere."""
    rows, seen = sinks.observed(fx.log(spark, d))
    sinks.discard(rows)
    return fx.values(spark, [tuple(seen.get[c] for c in ("rows", "inserts", "updates", "deletes"))], "rows long, inserts long, updates long, deletes long")


@query("k3_chunk_mirror", fx.CHUNKS + "SELECT blkno, offnum, lsn, is_deleted FROM ch WHERE relid = 1")
def chunk_mirror(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "mirror")
    sinks.mirror_chunks(fx.chunks(spark, d), path)
    return spark.read.parquet(path).filter("relid = 1").select("blkno", "offnum", "lsn", "is_deleted")


@query("k6_fan_out", fx.LOG + "SELECT 'all' AS sink, lsn FROM log UNION ALL SELECT 'deletes', lsn FROM log WHERE op = 'D'")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    every, deletes = new_path(spark, "all"), new_path(spark, "deletes")
    sinks.fan_out(fx.log(spark, d), [lambda rows: sinks.append(rows, every, 0), lambda rows: sinks.append(rows.filter("op = 'D'"), deletes, 0)])
    read = lambda path, name: spark.read.parquet(path).select(F.lit(name).alias("sink"), "lsn")
    return read(every, "all").unionByName(read(deletes, "deletes"))


@query("k8_metrics_text", fx.LOG + "SELECT string_agg('# TYPE changeloom_' || name || ' gauge' || chr(10) || 'changeloom_' || name || ' ' || n || chr(10), '' ORDER BY name) AS text FROM (SELECT 'op_' || op AS name, count(*) AS n FROM log GROUP BY op)")
def metrics_text(spark: SparkSession, d: str) -> DataFrame:
    counts = {f"op_{r.op}": r.n for r in progress.counts_by(fx.log(spark, d), "op").collect()}  # a row for each operation
    return fx.values(spark, [(sinks.metrics_text(counts),)], "text string")


@query("k10_manifest", fx.LOG + "SELECT max(lsn) AS ack, min(lsn) AS floor FROM log")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Written twice; the second is what is read."""
    store = segments.Manifest(f"{new_path(spark, 'manifest')}/state")
    store.write({"ack": 0, "floor": 0})
    store.write(fx.log(spark, d).agg(F.max("lsn").alias("ack"), F.min("lsn").alias("floor")).first().asDict())
    return fx.values(spark, [(store.read()["ack"], store.read()["floor"])], "ack long, floor long")


@query("l5_staging_swap", "SELECT c_custkey AS k, c_acctbal AS val, CAST(5000 AS BIGINT) AS _lsn FROM customer UNION ALL SELECT user_id, value, event_id * 16 FROM events WHERE event_id * 16 > 5000")
def staging_swap(spark: SparkSession, d: str) -> DataFrame:
    staged = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("val"), F.lit(5000).cast("long").alias("_lsn"))
    live = fx.log(spark, d).select("k", "val", F.col("lsn").alias("_lsn"))
    return spark.read.parquet(backfill.publish_staged(staged, live, new_path(spark, "staged"), 5000))


@query("s12_config_tables", "SELECT 'row_budget' AS key, '500' AS value UNION ALL SELECT 'ns.' || r_name || '.auto_create', 'true' FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'rel.' || r_name || '.' || n_name || '.replicate', CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'col.' || r_name || '.' || n_name || '.id.target_type', 'String' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0")
def config_tables(spark: SparkSession, d: str) -> DataFrame:
    regions, nations = fx.table(spark, d, "region"), fx.table(spark, d, "nation")
    both = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    name = [F.col("r_name").alias("namespace"), F.col("n_name").alias("relname")]
    settings = fx.values(spark, [(1, 500, None)], "id int, row_budget long, flush_timeout_ms long")
    spaces = regions.select(F.col("r_name").alias("namespace"), F.when(F.col("r_regionkey") < 3, True).alias("auto_create"))
    tables = both.select(*name, F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") % 2 == 0).alias("replicate"))
    columns = both.select(*name, F.lit("id").alias("attname"), F.when(F.col("n_nationkey") % 3 == 0, "String").alias("target_type"))
    return routing.config_layer(settings, spaces, tables, columns)


@query("u7_catalog_union", "SELECT 'class' AS catalog, n_nationkey AS oid, n_name AS name, NULL AS ns_oid FROM nation UNION ALL SELECT 'namespace', NULL, r_name, r_regionkey FROM region")
def catalog_union(spark: SparkSession, d: str) -> DataFrame:
    classes = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("oid"), F.col("n_name").alias("name"))
    spaces = fx.table(spark, d, "region").select(F.col("r_regionkey").alias("ns_oid"), F.col("r_name").alias("name"))
    return timeline.catalog_union(**{"class": classes, "namespace": spaces})


# --- tables that follow their source's schema -------------------------------

_ONE = ddl.Table((ddl.Column(1, "c_name", "string"), ddl.Column(2, "c_custkey", "bigint", False), ddl.Column(3, "c_acctbal", "double")), (2,))


def _evolved(spark: SparkSession, d: str, new: ddl.Table) -> DataFrame:
    """Customers under the first schema, then those of even key once more under ``new``, as one table; odd keys are read from files older than the change."""
    customers, path, now = fx.table(spark, d, "customer"), new_path(spark, "evolved"), _ONE.folded(new)
    values = {1: F.col("c_name"), 2: F.col("c_custkey"), 3: F.col("c_acctbal"), 4: F.col("c_nationkey") + 100}
    for version, (table, part) in enumerate(((_ONE, "c_custkey % 2 = 1"), (now, "c_custkey % 2 = 0"))):
        logical = customers.filter(part).select(*[values[c.attnum].cast(c.kind).alias(c.name) for c in table.columns])
        present = F.array(*[F.lit(c.attnum) for c in table.columns])
        ddl.to_physical(logical, table).withColumn("_present", present).write.parquet(f"{path}/version={version}")
    return ddl.to_logical(spark.read.option("mergeSchema", "true").parquet(path), now)


@query("d1_create_from_mapping", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def create_from_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The key's columns first, and not nullable."""
    rows = _evolved(spark, d, _ONE)
    if rows.columns != _ONE.schema().fieldNames() or _ONE.schema()[0].nullable:
        raise ValueError("the table is not as its mapping says")
    return rows


@query("d2_add_column", "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 2 = 1 THEN 7 ELSE c_nationkey + 100 END AS nation FROM customer")
def add_column(spark: SparkSession, d: str) -> DataFrame:
    """Rows from before the column came have its default."""
    return _evolved(spark, d, ddl.Table((*_ONE.columns, ddl.Column(4, "nation", "int", True, 7)), (2,)))


@query("d3_rename_column", "SELECT c_custkey, c_name AS called, c_acctbal FROM customer")
def rename_column(spark: SparkSession, d: str) -> DataFrame:
    return _evolved(spark, d, ddl.Table((ddl.Column(1, "called", "string"), *_ONE.columns[1:]), (2,)))


@query("d4_drop_column", "SELECT c_custkey, c_name FROM customer")
def drop_column(spark: SparkSession, d: str) -> DataFrame:
    return _evolved(spark, d, ddl.Table(_ONE.columns[:2], (2,)))


@query("d5_type_change_rejected", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def type_change_rejected(spark: SparkSession, d: str) -> DataFrame:
    """The column keeps its old type, and all its values."""
    return _evolved(spark, d, ddl.Table((*_ONE.columns[:2], ddl.Column(3, "c_acctbal", "int")), (2,)))


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return timeline.schema_diff(fx.descriptors(spark, d, "old")[1], fx.descriptors(spark, d, "new")[1])


_DIFF = fx.DESCRIPTORS + """, o AS (SELECT * FROM old_attr WHERE NOT dropped), n AS (SELECT * FROM new_attr WHERE NOT dropped),
j AS (SELECT coalesce(o.rel, n.rel) AS rel, coalesce(o.attnum, n.attnum) AS attnum, o.name AS old_name, n.name AS new_name, o.rel IS NULL AS is_new, n.rel IS NULL AS is_gone, o.name <> n.name AS renamed, o.type_oid <> n.type_oid OR o.typmod <> n.typmod AS retyped, o.not_null <> n.not_null AS renullable FROM o FULL JOIN n ON o.rel = n.rel AND o.attnum = n.attnum),
diff AS (SELECT rel, attnum, 'added' AS change, old_name, new_name FROM j WHERE is_new UNION ALL SELECT rel, attnum, 'dropped', old_name, new_name FROM j WHERE is_gone UNION ALL SELECT rel, attnum, 'renamed', old_name, new_name FROM j WHERE renamed
  UNION ALL SELECT rel, attnum, 'retyped', old_name, new_name FROM j WHERE retyped UNION ALL SELECT rel, attnum, 'renullable', old_name, new_name FROM j WHERE renullable)
"""


@query("d7_schema_diff", _DIFF + "SELECT rel, attnum, change, old_name, new_name FROM diff")
def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


@query("o7_ddl_order", _DIFF + "SELECT rel, CAST(row_number() OVER (PARTITION BY rel ORDER BY list_position(['renamed', 'added', 'dropped', 'retyped'], change), attnum) AS INT) AS position, CASE change WHEN 'renamed' THEN 'rename' WHEN 'added' THEN 'add' WHEN 'dropped' THEN 'drop' ELSE 'rejected' END AS statement, attnum, old_name, new_name FROM diff WHERE change <> 'renullable'")
def ddl_order(spark: SparkSession, d: str) -> DataFrame:
    return timeline.ddl_plan(_diff(spark, d))


@query("p9_derived_mapping", fx.DESCRIPTORS + "SELECT rel, CAST(row_number() OVER (PARTITION BY rel ORDER BY attnum) AS INT) AS position, attnum, name, type_oid, NOT (not_null OR attnum = 1) AS nullable FROM new_attr WHERE NOT dropped")
def derived_mapping(spark: SparkSession, d: str) -> DataFrame:
    attributes = fx.descriptors(spark, d, "new")[1]
    return timeline.derived_mapping(attributes, attributes.filter("attnum = 1"))


@query("p10_folded_mapping", _DIFF + ", m AS (SELECT rel, attnum, CASE WHEN rel % 3 = 0 AND attnum = 2 THEN 'mine' ELSE name END AS name FROM o), k AS (SELECT m.rel, m.attnum, CASE WHEN m.name = r.old_name THEN r.new_name ELSE m.name END AS name, 0 AS late FROM m LEFT JOIN diff r ON r.rel = m.rel AND r.attnum = m.attnum AND r.change = 'renamed' WHERE NOT EXISTS (SELECT 1 FROM diff g WHERE g.rel = m.rel AND g.attnum = m.attnum AND g.change = 'dropped') UNION ALL SELECT rel, attnum, new_name, 1 FROM diff WHERE change = 'added') SELECT rel, CAST(row_number() OVER (PARTITION BY rel ORDER BY late, attnum) AS INT) AS position, attnum, name FROM k")
def folded_mapping(spark: SparkSession, d: str) -> DataFrame:
    """A third of the relations have a column under a name of their own, which a rename leaves alone."""
    old, new = (fx.descriptors(spark, d, side)[1] for side in ("old", "new"))
    own = F.when((F.col("rel") % 3 == 0) & (F.col("attnum") == 2), "mine").otherwise(F.col("name"))
    return timeline.folded_mapping(old.filter("NOT dropped").select("rel", "attnum", own.alias("name")), timeline.schema_diff(old, new))


_SLOT = """slot AS (SELECT coalesce(o.rel, n.rel) AS rel, coalesce(o.attnum, n.attnum) AS attnum,
  CASE WHEN n.rel IS NULL THEN 'columns are gone' WHEN o.rel IS NULL THEN CASE WHEN NOT n.dropped AND n.not_null AND n.missing IS NULL THEN 'appended not-null column without missing value' END
    WHEN o.len <> n.len OR o.align <> n.align OR o.byval <> n.byval THEN 'width change' WHEN o.dropped AND NOT n.dropped THEN 'dropped column is back' WHEN n.dropped THEN NULL
    WHEN o.type_oid <> n.type_oid THEN 'type change' WHEN o.missing IS DISTINCT FROM n.missing THEN 'missing value change' END AS physical,
  CASE WHEN o.rel IS NULL OR n.rel IS NULL OR n.dropped THEN NULL WHEN o.typmod <> n.typmod THEN 'typmod change' WHEN o.storage <> n.storage THEN 'storage change' END AS benign,
  CASE WHEN n.rel IS NULL THEN 0 ELSE n.attnum END AS place FROM old_attr o FULL JOIN new_attr n ON o.rel = n.rel AND o.attnum = n.attnum),
bad AS (SELECT rel, arg_min(physical, place) FILTER (WHERE physical IS NOT NULL) AS physical, arg_min(benign, place) FILTER (WHERE benign IS NOT NULL) AS benign FROM slot GROUP BY rel),
whole AS (SELECT o.rel, CASE WHEN o.node <> n.node THEN 'node rotated' WHEN o.kind <> n.kind THEN 'kind change' WHEN o.persistence <> n.persistence THEN 'persistence change' WHEN o.toast <> 0 AND o.toast <> n.toast THEN 'large value relation change' END AS why FROM old_rel o JOIN new_rel n USING (rel))
"""


@query("d8_compatible_reader", fx.DESCRIPTORS + ", " + _SLOT + "SELECT rel, CASE WHEN coalesce(why, physical) IS NOT NULL THEN 'physical' WHEN benign IS NOT NULL THEN 'benign' ELSE 'equal' END AS verdict, coalesce(why, physical, benign) AS why FROM whole JOIN bad USING (rel)")
def compatible_reader(spark: SparkSession, d: str) -> DataFrame:
    (old, old_attributes), (new, new_attributes) = (fx.descriptors(spark, d, side) for side in ("old", "new"))
    return timeline.compatible_reader(old, new, old_attributes, new_attributes)


# --- names, literals, bytes -------------------------------------------------


@query("n16_quoting", "SELECT p_partkey, '`' || replace(p_name || '`x', '`', '``') || '`' AS name, '''' || replace(replace(p_name || '\\''', '\\', '\\\\'), '''', '\\''') || '''' AS text, 'X''' || upper(hex(encode(p_brand))) || '''' AS bytes FROM part")
def quoting(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "part")
    return p.select("p_partkey", N.quoted_name(F.concat("p_name", F.lit("`x"))).alias("name"), N.quoted_text(F.concat("p_name", F.lit("\\'"))).alias("text"), N.quoted_bytes(F.col("p_brand").cast("binary")).alias("bytes"))


@query("p12_literals", "SELECT n_nationkey, '''' || n_name || '''' AS text, CAST(n_regionkey AS VARCHAR) AS number, 'NULL' AS nothing, CASE WHEN n_nationkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS truth FROM nation")
def literals(spark: SparkSession, d: str) -> DataFrame:
    """Defaults of a catalog as SQL text, one by one: a catalog is small."""
    rows = fx.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()
    out = [(r.n_nationkey, ddl.literal(r.n_name), ddl.literal(r.n_regionkey), ddl.literal(None), ddl.literal(r.n_nationkey % 2 == 0)) for r in rows]
    return fx.values(spark, out, "n_nationkey int, text string, number string, nothing string, truth string")


def _bytes_of(value: Column, width: int) -> Column:
    """Little-endian bytes of a number that is not negative."""
    big = F.unhex(F.lpad(F.hex(value), 2 * width, "0"))
    return F.concat(*[F.substring(big, k, 1) for k in range(width, 0, -1)])


@query("n1_numeric_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'NaN' ELSE CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '' END || CAST(o_orderkey * 10007 AS VARCHAR) || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') END AS text FROM orders")
def numeric_text(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of two decimals in the stored form: a header of sign, scale and weight, then base-10000 digits."""
    o = fx.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 10007).alias("whole"), (F.col("o_orderkey") % 100).alias("cents"))
    groups = [F.expr(f"whole div {10000**k} % 10000") for k in (2, 1, 0)] + [F.col("cents") * 100]
    head = F.lit(0x8000 | 2 << 7 | 2) + F.when(F.col("o_orderkey") % 3 == 0, 0x2000).otherwise(0)
    data = F.when(F.col("o_orderkey") % 97 == 0, _bytes_of(F.lit(0xC000), 2)).otherwise(F.concat(_bytes_of(head, 2), *[_bytes_of(g, 2) for g in groups]))
    return o.select("o_orderkey", B.numeric_text(data).alias("text"))


@query("n3_inet_text", "SELECT event_id, '10.' || event_id // 65536 % 256 || '.' || event_id // 256 % 256 || '.' || event_id % 256 || CASE WHEN event_id % 2 = 0 THEN '/24' WHEN event_id % 3 = 0 THEN '/32' ELSE '' END AS text FROM events")
def inet_text(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    bits = F.when(e % 2 == 0, 24).otherwise(32)
    data = F.concat(F.unhex(F.lit("02")), F.unhex(F.lpad(F.hex(bits), 2, "0")), F.unhex(F.lpad(F.hex(e + (10 << 24)), 8, "0")))
    return fx.table(spark, d, "events").select("event_id", B.inet_text(data, (e % 3 == 0) | (e % 2 == 0)).alias("text"))


@query("n11_fixed_width", "SELECT event_id, event_id AS wide, CAST(event_id % 30000 - 32768 AS SMALLINT) AS narrow FROM events")
def fixed_width(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return fx.table(spark, d, "events").select("event_id", B.little_endian(_bytes_of(e, 8), 8).alias("wide"), B.little_endian(_bytes_of(e % 30000 + 32768, 2), 2).alias("narrow"))


@query("n14_crc32c")
def crc32c(spark: SparkSession, d: str) -> DataFrame:
    """SQL has no such checksum; ``tests/test_raw.py`` holds it to its definition."""
    return fx.table(spark, d, "events").select("event_id", B.crc32c(F.col("props").cast("binary")).alias("crc"))
