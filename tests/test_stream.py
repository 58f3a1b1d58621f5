import random
import time

import pytest
from pyspark.sql.types import StructType

from changeloom.operators import dataflow
from changeloom.operators.dataflow import ATTRIBUTES, CHANGES, ENDS, Timelines
from changeloom.operators.ddl import Column
from changeloom.sources.segments import RECORD_SCHEMA, Manifest, SegmentSource, list_segments, read_range, trim_segments, write_segments
from changeloom.streaming.apply import ChangeApplier, RefusedTransactions, stream
from changeloom.streaming.gauges import Gauges


COLUMNS = (Column(1, "k", "bigint", False), Column(2, "val", "double"))
#: Relations with a route, and one without.
RELATIONS, UNMAPPED = (0, 1, 2), 3


def records(seed=1, n=60):
    """Interleaved transactions with savepoints, aborts, rollbacks, prepared and open ones, and TRUNCATEs of them, and what they come to."""
    rng = random.Random(seed)
    lsn, live, out, xid, kept = 0, {}, [], 100, []
    for _ in range(n * 6):
        lsn += 16
        if rng.random() < 0.15 or not live:
            xid += 10
            live[xid] = {"subs": [], "lost": [], "rows": []}
        top = rng.choice(list(live))
        tx = live[top]
        if rng.random() < 0.2 and tx["rows"]:
            outcome = rng.choice(["commit", "commit", "abort"])
            prepared = rng.random() < 0.3
            if prepared:
                out.append({"kind": "end", "lsn": lsn, "xid": top, "outcome": "prepare", "ts_us": lsn})
                lsn += 16
            out.append({"kind": "end", "lsn": lsn, "xid": 1_000_000 + lsn if prepared else top, "twophase_xid": top if prepared else None, "outcome": outcome, "subxids": tx["subs"], "rolled_back": tx["lost"], "ts_us": lsn})
            if outcome == "commit" and not any(r["partial"] for r in tx["rows"] if r["xid"] not in tx["lost"] and r["rel"] != UNMAPPED and r["op"] != "T"):
                kept += [r for r in tx["rows"] if r["xid"] not in tx["lost"]]
            elif outcome == "commit":  # refused, but its truncates are applied
                kept += [r for r in tx["rows"] if r["xid"] not in tx["lost"] and r["op"] == "T"]
            del live[top]
            continue
        writer = top
        if rng.random() < 0.4:
            writer = top + len(tx["subs"]) + 1 if len(tx["subs"]) < 8 else tx["subs"][-1]
            if writer not in tx["subs"]:
                tx["subs"].append(writer)
                if rng.random() < 0.3:
                    tx["lost"].append(writer)
        op = "T" if rng.random() < 0.03 else rng.choice("IUUD")
        k = rng.randrange(12)
        row = {"kind": "row", "lsn": lsn, "tuple_idx": 0, "xid": writer, "db": 1, "rel": rng.choice((*RELATIONS, UNMAPPED)), "op": op, "partial": rng.random() < 0.01}
        row |= {"new": {1: str(k), 2: str(float(lsn))} if op in "IU" else None, "old": {1: str(k)} if op == "D" else None}
        tx["rows"].append(row)
        out.append(row)
    state, cut = {}, {}
    for r in sorted(kept, key=lambda r: r["lsn"]):
        if r["op"] == "T":
            cut[r["rel"]] = r["lsn"]
        elif r["rel"] != UNMAPPED:
            state[r["rel"], int((r["new"] or r["old"])[1])] = r
    return out, {((rel, k), r["lsn"]) for (rel, k), r in state.items() if r["op"] != "D" and r["lsn"] >= cut.get(rel, 0)}


def frame(spark, rows):
    names = [f.name for f in StructType.fromDDL(RECORD_SCHEMA)]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], RECORD_SCHEMA)


def lookups(spark, **more):
    attributes = [(1, "k", "bigint", True, False, None), (2, "val", "double", False, False, None)]
    schemas = spark.createDataFrame([(rel, 0, "Present", attributes) for rel in (*RELATIONS, UNMAPPED)], f"rel long, valid_from long, kind string, attributes {ATTRIBUTES}")
    routes = spark.createDataFrame([(rel, 0, f"t{rel}") for rel in RELATIONS], "rel long, valid_from long, target string")
    return Timelines(schemas, routes, target_db=1, **more)


def applier_of(spark, root, **more):
    return ChangeApplier(spark, root, lookups(spark), **more)


def state_of(applier):
    return {((rel, r.k), r["_lsn"]) for rel in RELATIONS for r in applier.state(COLUMNS, ["k"], f"t{rel}").collect()}


@pytest.mark.parametrize("batches", [1, 5])
def test_micro_batches_equal_an_interpreter(spark, tmp_path, batches):
    rows, want = records()
    applier = applier_of(spark, f"file://{tmp_path}/a")
    size = -(-len(rows) // batches)
    for k in range(batches):
        applier.apply(frame(spark, rows[k * size : (k + 1) * size]), k)
    assert state_of(applier) == want
    applier.apply(frame(spark, rows[:size]), batches - 1)  # a batch that was published before is left alone
    assert state_of(applier) == want


def test_unpublished_batch_is_invisible_and_runs_again(spark, tmp_path, monkeypatch):
    rows, want = records(2)
    applier = applier_of(spark, f"file://{tmp_path}/a")
    applier.apply(frame(spark, rows[:150]), 0)
    before = state_of(applier)

    def fail(value):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(applier.manifest, "write", fail)
        with pytest.raises(RuntimeError):
            applier.apply(frame(spark, rows[150:]), 1)
    assert state_of(applier) == before
    applier_of(spark, f"file://{tmp_path}/a").apply(frame(spark, rows[150:]), 1)
    assert state_of(applier) == want
    manifest = applier.manifest.read()
    assert manifest["batch"] == 1 and manifest["floor"] <= manifest["ack"] == max(r["lsn"] for r in rows)
    assert [p.name for p in (tmp_path / "a/open").iterdir() if p.is_dir()] == ["batch=1"]


def test_segment_stream_restarts(spark, tmp_path):
    rows, want = records(3)
    path, root, checkpoint = (f"file://{tmp_path}/{x}" for x in ("segments", "a", "checkpoint"))
    spark.dataSource.register(SegmentSource)
    half = rows[len(rows) // 2]["lsn"] // 512 * 512
    write_segments(frame(spark, [r for r in rows if r["lsn"] < half]), path, 512)
    applier = applier_of(spark, root)
    run = lambda: applier.start(spark.readStream.format("segments").option("path", path).option("maxSegments", "4").load(), checkpoint, interval="100 milliseconds")
    q = run()
    q.processAllAvailable()
    q.stop()
    first = applier.manifest.read()["batch"]
    write_segments(frame(spark, [r for r in rows if r["lsn"] >= half]), path, 512)
    q = run()
    q.processAllAvailable()
    q.stop()
    assert state_of(applier) == want and applier.manifest.read()["batch"] > first
    assert read_range(spark, path, 600, 1600).count() == sum(600 < r["lsn"] <= 1600 for r in rows)
    n = len(list_segments(path))
    assert len(trim_segments(path, 1024)) + len(list_segments(path)) == n


def test_file_stream(spark, tmp_path):
    rows, want = records(4)
    for k in range(3):
        frame(spark, rows[k * 150 : (k + 1) * 150 if k < 2 else None]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    applier, gauges = applier_of(spark, f"file://{tmp_path}/a"), Gauges()
    spark.streams.addListener(gauges)
    try:
        applier.start(stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/c").awaitTermination()
        for _ in range(100):
            if any(own.get("running") == 0 for own in gauges.streams.values()):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(gauges)
    assert state_of(applier) == want
    assert f"changeloom_stream_rows {len(rows)}\n" in gauges.text() and "changeloom_stream_running 0\n" in gauges.text()


def test_table_equals_stream(spark, tmp_path):
    """The dataflow over all records at once, as tables."""
    rows, want = records(5)
    df = frame(spark, rows)
    names = lambda schema: [f.name for f in StructType.fromDDL(schema)]
    _, _, done = dataflow.with_outcomes(df.filter("kind = 'row'").select(*names(CHANGES)), df.filter("kind = 'end'").select(*names(ENDS)))
    flow = dataflow.flow(done, lookups(spark))
    got = {((rel, r.k), r["_lsn"]) for rel in RELATIONS for r in dataflow.state(flow.versions, flow.truncates, COLUMNS, ["k"], f"t{rel}").collect()}
    assert got == want
    applier = applier_of(spark, f"file://{tmp_path}/a")
    for k in range(3):
        applier.apply(frame(spark, rows[k * 130 : (k + 1) * 130 if k < 2 else None]), k)
    order = lambda df: sorted(map(str, df.collect()))
    assert state_of(applier) == want and order(applier.refused()) == order(flow.refused) and flow.refused.count() > 0
    assert {r.rel for r in flow.unmapped.collect()} == {UNMAPPED}


def test_strict_fails_before_anything_is_published(spark, tmp_path):
    bad = {"kind": "row", "lsn": 16, "tuple_idx": 0, "xid": 7, "db": 1, "rel": 0, "op": "U", "new": {1: "5"}, "partial": True}
    end = {"kind": "end", "lsn": 32, "xid": 7, "outcome": "commit", "ts_us": 1, "subxids": [], "rolled_back": []}
    applier = applier_of(spark, f"file://{tmp_path}/a", strict=True)
    with pytest.raises(RefusedTransactions):
        applier.apply(frame(spark, [bad, end]), 0)
    assert applier.manifest.read() == {} and applier.versions().count() == 0


def test_truncate_of_an_aborted_transaction(spark, tmp_path):
    row = lambda lsn, xid, op, new=None: {"kind": "row", "lsn": lsn, "tuple_idx": 0, "xid": xid, "db": 1, "rel": 0, "op": op, "new": new}
    end = lambda lsn, xid, outcome: {"kind": "end", "lsn": lsn, "xid": xid, "outcome": outcome, "ts_us": lsn, "subxids": [], "rolled_back": []}
    applier = applier_of(spark, f"file://{tmp_path}/a")
    applier.apply(frame(spark, [row(16, 1, "I", {1: "5"}), end(32, 1, "commit"), row(48, 2, "T")]), 0)
    assert state_of(applier) == {((0, 5), 16)}  # still open
    applier.apply(frame(spark, [end(64, 2, "abort")]), 1)
    assert state_of(applier) == {((0, 5), 16)}
    applier.apply(frame(spark, [row(80, 3, "T"), row(96, 3, "I", {1: "6"}), end(112, 3, "commit")]), 2)
    assert state_of(applier) == {((0, 6), 96)}


def test_large_values_schemas_and_routes(spark, tmp_path):
    """Chunks from the own transaction and from the store, an added column's default, a dropped column, and a route that comes later."""
    attributes = lambda *more: [(1, "k", "bigint", True, False, None), *more]
    big = (2, "body", "string", False, False, None)
    schemas = spark.createDataFrame([(0, 0, "Present", attributes(big)), (0, 200, "Present", attributes((*big[:4], True, None), (3, "n", "int", True, False, "7")))], f"rel long, valid_from long, kind string, attributes {ATTRIBUTES}")
    routes = spark.createDataFrame([(0, 0, None), (0, 50, "t0")], "rel long, valid_from long, target string")
    t = Timelines(schemas, routes, chunk_rels=spark.createDataFrame([(9,)], "rel long"))
    chunk = lambda lsn, xid, seq, body, off: {"kind": "row", "lsn": lsn, "tuple_idx": 0, "xid": xid, "db": 1, "rel": 9, "op": "I", "blkno": 1, "offnum": off, "new": {1: "77", 2: str(seq), 3: body}}
    row = lambda lsn, xid, k, size=None, natts=2, **more: {"kind": "row", "lsn": lsn, "tuple_idx": 0, "xid": xid, "db": 1, "rel": 0, "op": "U", "natts": natts, "new": {1: str(k), **more.get("new", {})}, "large": {2: (9, 77, size, size)} if size else None}
    end = lambda lsn, xid: {"kind": "end", "lsn": lsn, "xid": xid, "outcome": "commit", "ts_us": lsn, "subxids": [], "rolled_back": []}
    applier = ChangeApplier(spark, f"file://{tmp_path}/a", t)
    applier.apply(frame(spark, [row(8, 1, 1), end(16, 1), chunk(60, 2, 0, "ab", 1), chunk(61, 2, 1, "cd", 2), row(62, 2, 2, 4), end(70, 2), row(80, 3, 3, 4), end(90, 3)]), 0)
    gone = {"kind": "row", "lsn": 100, "tuple_idx": 0, "xid": 4, "db": 1, "rel": 9, "op": "D", "blkno": 1, "offnum": 2, "old": {}}
    applier.apply(frame(spark, [gone, end(110, 4), row(120, 5, 4, 4), end(130, 5), row(140, 6, 5), chunk(141, 6, 0, "x", 3), row(142, 6, 6, 4), end(150, 6)]), 1)
    applier.apply(frame(spark, [row(210, 7, 7), end(215, 7), row(220, 8, 8, natts=3, new={2: "dropped", 3: "x"}), end(225, 8)]), 2)
    columns = (*COLUMNS[:1], Column(2, "body", "string"), Column(3, "n", "int", False))
    got = {r.k: (r.body, r.n) for r in applier.state(columns, ["k"], "t0").collect()}
    # 1 had no route at its commit; 2 has its own chunks, 3 those of the store; 4's value lost a chunk, so it is NULL; 5 and 6 are
    # refused together, as 6's own transaction holds only a part; 7 was written before n came; 8's n is no number
    assert got == {2: ("abcd", 0), 3: ("abcd", 0), 4: (None, 0), 7: (None, 7), 8: (None, 0)}
    assert {(r.lsn, r.verdict) for r in applier.refused().collect()} == {(140, "apply"), (142, "error_gap")}


def test_manifest(tmp_path):
    m = Manifest(f"file://{tmp_path}/x/m")
    assert m.read() == {}
    m.write({"a": 1})
    m.write({"a": 2})
    assert m.read() == {"a": 2} and [p.name for p in (tmp_path / "x").iterdir()] == ["m.000000000001.json"]


def test_stages_of_empty_input(spark, tmp_path):
    applier = applier_of(spark, f"file://{tmp_path}/a")
    assert state_of(applier) == set()
    applier.apply(frame(spark, []), 0)
    assert state_of(applier) == set() and applier.versions().count() == applier.refused().count() == 0
