import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from changeloom.operators import backfill, ddl, progress, ranges, records, routing, timeline, transactions, values, versions
from changeloom.plans import fixtures
from changeloom.sources import sinks


def test_latest_state_is_order_free_and_takes_replays(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(9), lsn, rng.choice([None, 1.0, 2.0]), rng.random() < 0.2) for lsn in range(80)]
    want = {}
    for k, lsn, v, dead in rows:
        want[k] = (k, lsn, v, dead)
    schema = "k int, _lsn int, v double, _is_deleted boolean"
    for shuffled in (rows, rng.sample(rows, 80), rows + rows[30:]):
        df = spark.createDataFrame(shuffled, schema).repartition(3)
        got = versions.latest_state(df, ["k"], ["_lsn"])
        assert {tuple(r) for r in got.collect()} == {w for w in want.values() if not w[3]}
    df = spark.createDataFrame(rows, schema)
    packed = versions.compact(df, ["k"], ["_lsn"], 40)
    late = df.filter("_lsn >= 40")
    again = versions.latest_state(packed.unionByName(late), ["k"], ["_lsn"])
    assert {tuple(r) for r in again.collect()} == {w for w in want.values() if not w[3]}


def test_winner_with_null_stays_null_but_arg_max_skips(spark):
    df = spark.createDataFrame([(1, 1, "a", False), (1, 2, None, False)], "k int, _lsn int, v string, _is_deleted boolean")
    assert versions.latest_state(df, ["k"], ["_lsn"]).first().v is None
    assert versions.arg_max(df, ["k"], "v", "_lsn").first().v == "a"


def test_commit_lsn_decides_between_a_load_and_a_straddling_transaction(spark):
    """A row written before the load and committed after it must win: compare commit positions, not record positions."""
    load = spark.createDataFrame([(1, "loaded", 100, 100, False)], "k int, v string, _lsn int, commit_lsn int, _is_deleted boolean")
    live = spark.createDataFrame([(1, "live", 90, 110, False)], "k int, v string, _lsn int, commit_lsn int, _is_deleted boolean")
    both = versions.union_loads(load, live)
    assert versions.latest_state(both, ["k"], ["_lsn"]).first().v == "loaded"
    assert versions.latest_state(both, ["k"], ["commit_lsn", "_lsn"]).first().v == "live"


def test_asof_by_shuffle_equals_asof_by_broadcast(spark):
    rng = random.Random(2)
    log = fixtures.values(spark, [(k, v, f"{k}@{v}") for k in range(4) for v in sorted(rng.sample(range(100), 6))], "rel int, valid_from int, name string")
    changes = spark.createDataFrame([(i, rng.randrange(5), rng.randrange(120)) for i in range(200)], "id int, rel int, lsn int")
    joined = timeline.asof(changes, log, ["rel"])
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().sparkPlan().toString()
    first = {tuple(r) for r in joined.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = timeline.asof(changes, log, ["rel"])
        assert "SortMergeJoin" in joined._jdf.queryExecution().sparkPlan().toString()
        assert {tuple(r) for r in joined.collect()} == first
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partial_rows_fail(spark):
    df = spark.createDataFrame([(1, False), (2, True)], "lsn int, partial boolean")
    with pytest.raises(PySparkException, match="partial row at 2"):
        routing.reject_partial(df).collect()


def test_seal_by_bytes(spark):
    sizes = [50, 60, 10, 200, None, 90, 20, 5]
    df = spark.createDataFrame([("t", i, n) for i, n in enumerate(sizes)] + [("u", 0, 500)], "t string, lsn int, size int")
    got = {(r.t, r.lsn): r.batch for r in progress.seal_by_bytes(df, "t", "lsn", "size", 100).collect()}
    assert [got["t", i] for i in range(8)] == [0, 0, 1, 1, 2, 2, 2, 3] and got["u", 0] == 0


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_seal_by_bytes_by_steps(spark, rows):
    """Whatever the Arrow batches are, as if row by row."""
    rng = random.Random(5)
    data = [(t, i, rng.choice([None, 0, 1, 30, 99, 100, 250])) for t in (None, "a", "b") for i in range(rng.randrange(20, 60))]
    want = {}
    for t in (None, "a", "b"):
        held = batch = 0
        for _, i, n in sorted(r for r in data if r[0] == t):
            want[t, i] = batch
            held += n or 0
            if held >= 100:
                held, batch = 0, batch + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = progress.seal_by_bytes(spark.createDataFrame(data, "t string, lsn int, size int"), "t", "lsn", "size", 100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.t, r.lsn): r.batch for r in got} == want


def test_row_numbers_of_a_hot_group(spark):
    """One group of nearly all rows is numbered in several ranges."""
    rng = random.Random(6)
    keys = rng.sample(range(10**6), 500)
    df = spark.createDataFrame([("hot" if k % 50 else "cold", k) for k in keys], "t string, lsn long").repartition(3)
    got = {r.lsn: (r.t, r.row) for r in ranges.row_numbers(df, "t", "lsn", 8).collect()}
    for t in ("hot", "cold"):
        assert [got[k] for k in sorted(k for k in keys if ("hot" if k % 50 else "cold") == t)] == [(t, i) for i in range(sum(x == t for x, _ in got.values()))]
    assert len(ranges.range_splits(df, "lsn", 8)) >= 5


def test_watermark_stops_at_what_is_not_there(spark):
    acks = lambda *seqs: spark.createDataFrame([(s, s not in (6,), s != 3, s * 10) for s in seqs], "seq long, done boolean, publish boolean, commit_lsn long")
    mark = lambda *a, **k: progress.watermark(*a, **k).first().watermark
    assert mark(acks(0, 1, 3, 4)) == 10 and mark(acks(0, 1, 2, 3)) == 20 and mark(acks(4, 5, 6, 7)) == 50
    assert mark(acks(4, 5), first=3) is None and mark(acks(4, 5), first=4) == 50 and mark(acks(6)) is None
    assert mark(acks(1, 2), trailing=99) == 99 and mark(acks(1, 3), trailing=99) == 10 and mark(acks()) is None


def test_parity_tells_tables_apart(spark):
    one = spark.createDataFrame([("a", k, f"v{k}") for k in range(50)] + [("b", 1, None)], "g string, k int, v string")
    two = one.withColumn("v", F.when(F.col("k") == 7, F.lit("other")).otherwise(F.col("v")))
    own = lambda df: {r.g: (r.n, r.total, r.digest) for r in progress.parity(df, "g", "k", F.coalesce("v", F.lit("")), F.col("k")).collect()}
    assert own(one) == own(one.repartition(7)) and own(one)["a"] != own(two)["a"] and own(one)["b"] == own(two)["b"]


def test_truncates_of_lost_transactions_empty_nothing(spark):
    changes = spark.createDataFrame([(1, 10, "I", 0), (2, 20, "T", 0), (3, 31, "T", 1), (4, 30, "I", 1), (5, 40, "T", 1)], "lsn long, xid long, op string, rel long")
    ends = spark.createDataFrame([(10, "commit", 6), (20, "abort", 7), (30, "commit", 8), (40, "commit", 9)], "top_xid long, outcome string, commit_lsn long")
    ends = ends.withColumn("commit_ts", F.lit(0))
    rows = transactions.with_top_xid(changes, spark.createDataFrame([(31, 30)], "subxid long, top_xid long"))
    done = transactions.committed(rows, ends, spark.createDataFrame([(31,)], "xid long"))
    assert [tuple(r) for r in transactions.truncates(done).collect()] == [(1, 5)]
    assert [r.lsn for r in transactions.truncated(done.filter("op != 'T'"), transactions.truncates(done)).collect()] == [1]


def test_reassembly_outcomes(spark):
    chunks = spark.createDataFrame([("whole", 0, "ab", 4), ("whole", 1, "cd", 4), ("gap", 0, "ab", 4), ("gap", 2, "cd", 4), ("twice", 0, "ab", 4), ("twice", 0, "ab", 4), ("late", 1, "abcd", 4), ("long", 0, "abcde", 4)], "k string, seq int, body string, stored_size long")
    got = {r.k: (r.status, r.value) for r in values.reassemble(chunks, ["k"]).collect()}
    assert got == {"whole": ("Assembled", "abcd"), **{k: ("Mismatch", None) for k in ("gap", "twice", "late", "long")}}
    binary = values.reassemble(chunks.withColumn("body", F.col("body").cast("binary")), ["k"]).filter("k = 'whole'").first()
    assert bytes(binary.value) == b"abcd"


def test_fetch_asof_each_at_its_own_position(spark):
    store = spark.createDataFrame([(1, 1, 0, 7, 0, "ab", 10, False), (1, 1, 1, 7, 1, "cd", 11, False), (1, 1, 0, None, None, None, 20, True), (1, 1, 0, 8, 0, "xy", 30, False), (1, 2, 0, 7, 0, "AB", 40, False)] * 2, "relid long, blkno long, offnum int, chunk_id long, seq int, body string, lsn long, is_deleted boolean")
    at = [(1, 7, 4, x) for x in (5, 10, 15, 25, 35, 45)] + [(1, 8, 2, 25), (1, 8, 2, 35), (1, 9, 1, 50), (1, 7, 999, 45)]
    got = {(r.chunk_id, r.stored_size, r["at"]): (r.status, r.value) for r in values.fetch_asof(store, spark.createDataFrame(at, "relid long, chunk_id long, stored_size long, at long"), cap=100).collect()}
    assert got == {
        (7, 4, 5): ("Missing", None), (7, 4, 10): ("Mismatch", None), (7, 4, 15): ("Assembled", "abcd"), (7, 4, 25): ("Mismatch", None), (7, 4, 35): ("Mismatch", None), (7, 4, 45): ("Assembled", "ABcd"),
        (8, 2, 25): ("Missing", None), (8, 2, 35): ("Assembled", "xy"), (9, 1, 50): ("Missing", None), (7, 999, 45): ("TooLarge", None),
    }


def test_undecided_tuples_fail_a_load(spark):
    rows = spark.createDataFrame([(9, 0, 0x0100, "Committed", None, None), (9, 5, 0x1100, "Committed", None, None)], "xmin long, xmax long, infomask int, xmin_status string, xmax_status string, updater_status string")
    assert backfill.gated_load(rows.limit(1), 70).first()["_lsn"] == 70
    with pytest.raises(PySparkException, match="undecided tuple"):
        backfill.gated_load(rows, 70).collect()
    verdict = lambda has_log: [r.v for r in rows.select(backfill.visibility(has_log=F.lit(has_log)).alias("v")).collect()]
    assert verdict(True) == ["Emit", "Unresolvable"] and verdict(False) == ["Emit", "Defer"]
    unknown = rows.limit(1).withColumns({"infomask": F.lit(0), "xmin_status": F.lit(None).cast("string")})
    assert unknown.select(backfill.visibility().alias("v")).first().v == "Defer"


def test_descriptors_of_a_catalog_with_a_double(spark):
    tables = lambda *attnums: (spark.createDataFrame([(1, 9)], "oid long, ns_oid long"), spark.createDataFrame([(1, k, f"c{k}", 25, False) for k in attnums], "oid long, attnum int, name string, type_oid int, not_null boolean"), spark.createDataFrame([(9, "s")], "ns_oid long, ns string"), spark.createDataFrame([], "oid long, attnum int"))
    assert [a.attnum for a in timeline.assemble_descriptors(*tables(2, 1)).first().attributes] == [1, 2]
    with pytest.raises(PySparkException, match="column twice: 1"):
        timeline.assemble_descriptors(*tables(1, 1)).collect()
    classes, *rest = tables(1)
    with pytest.raises(PySparkException, match="relation twice: 1"):
        timeline.assemble_descriptors(classes.union(classes), *rest).collect()


def test_rowless_and_ineligible(spark):
    df = spark.createDataFrame([("Heap", "INSERT"), ("Heap", "LOCK"), ("Heap2", "MULTI_INSERT"), ("Heap2", "VISIBLE"), ("Btree", "INSERT")], "rmgr string, operation string")
    assert [r.ok for r in df.select(records.yields_rows().alias("ok")).collect()] == [True, False, True, False, False]


def test_staged_load(spark, tmp_path):
    staged = spark.createDataFrame([(1, "a", 50)], "k int, v string, _lsn int")
    live = spark.createDataFrame([(1, "old", 40), (2, "new", 60)], "k int, v string, _lsn int")
    folder = backfill.publish_staged(staged, live, f"file://{tmp_path}", 50)
    assert {tuple(r) for r in spark.read.parquet(folder).collect()} == {(1, "a", 50), (2, "new", 60)}
    with pytest.raises(ValueError):
        backfill.publish_staged(staged, live.select("v", "k", "_lsn"), f"file://{tmp_path}", 50)


def test_schema_follows_source(spark, tmp_path):
    one = ddl.Table((ddl.Column(1, "id", "bigint", False), ddl.Column(2, "a", "string"), ddl.Column(3, "b", "int")), (1,))
    two = ddl.Table((ddl.Column(1, "id", "bigint", False), ddl.Column(2, "a2", "string"), ddl.Column(4, "c", "int", True, 7)), (1,))
    assert [(w, c.name) for w, c in one.changes_to(two)] == [("rename", "a2"), ("add", "c"), ("drop", "b")]
    now = one.folded(two)
    assert now == ddl.Table(two.columns, (1,), (3,)) and now.schema().fieldNames() == ["id", "a2", "c"]
    path = f"file://{tmp_path}/t"
    ddl.to_physical(spark.createDataFrame([(1, "x", 5)], "id long, a string, b int"), one).withColumn("_present", F.array(F.lit(1), F.lit(2), F.lit(3))).write.parquet(f"{path}/v=1")
    ddl.to_physical(spark.createDataFrame([(2, "y", None)], "id long, a2 string, c int"), now).withColumn("_present", F.array(F.lit(1), F.lit(2), F.lit(4))).write.parquet(f"{path}/v=2")
    rows = ddl.to_logical(spark.read.option("mergeSchema", "true").parquet(path), now).collect()
    assert {tuple(r) for r in rows} == {(1, "x", 7), (2, "y", None)}
    retyped = ddl.Table((ddl.Column(1, "id", "int", False), *two.columns[1:]), (1,))
    assert [w for w, _ in now.changes_to(retyped)] == ["rejected"] and now.folded(retyped).columns[0].kind == "bigint"
    assert ddl.quote_name("a`b") == "`a``b`" and ddl.literal("it's") == "'it\\'s'" and ddl.literal(b"\x01") == "X'01'" and ddl.literal(None) == "NULL"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("I", 1), ("U", 2), ("D", 3), ("I", 4)], "op string, relid int")
    seen_rows, seen = sinks.observed(df)
    path = f"file://{tmp_path}"
    sinks.fan_out(seen_rows, [lambda d: sinks.append(d, f"{path}/a", 1), lambda d: sinks.append(d, f"{path}/a", 1), sinks.discard, lambda d: sinks.mirror_chunks(d, f"{path}/c")])
    assert spark.read.parquet(f"{path}/a").count() == 4
    assert spark.read.parquet(f"{path}/c").filter("relid = 2").count() == 1
    assert seen.get["inserts"] == 2 and seen.get["rows"] == 4
    assert "changeloom_lag 3\n" in sinks.metrics_text({"lag": 3})
