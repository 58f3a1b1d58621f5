"""Work that no single task may hold: frequent keys and large batches."""

import pytest
from pyspark.sql import functions as F

from changeloom.operators import backfill as B


@pytest.fixture
def shuffled(spark):
    """Joins of small tables by a shuffle, as those of large ones are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_status_of_a_frequent_xid(spark, shuffled, monkeypatch):
    """Most tuples have an xmax of 0: they are dealt to all tasks, and each still has the status of its own xid."""
    monkeypatch.setattr(B, "FREQUENT", 500, raising=False)
    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(0).alias("xid"))
    log = spark.range(0, 4000, 8).select(F.col("id").alias("xid"), (F.col("id") / 8 % 3).cast("int").alias("bits"))
    patch = spark.range(0, 4000, 12).select(F.col("id").alias("xid"), (F.col("id") % 24 == 0).alias("committed"))
    found = B.xid_status(rows, log, patch, 3500, 100)

    def status(xid):
        if xid % 12 == 0:
            return "Committed" if xid % 24 == 0 else "Aborted"
        if xid >= 3500 or xid < 100:
            return "InProgress" if xid >= 3500 else "Unknown"
        return {1: "Committed", 2: "Aborted"}.get(xid // 8 % 3 if xid % 8 == 0 else 0, "InProgress")

    assert sorted(map(tuple, found.select("id", "xid", "status").collect())) == [(i, x, status(x)) for i in range(4000) for x in [i if i % 4 == 0 else 0]]
    most = max(r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert most < 2000


def test_a_batch_of_records_is_several_files(spark, shuffled, monkeypatch, tmp_path):
    """No micro-batch of ``t4_stream_state`` is one file, which one task would read."""
    from changeloom.plans import QUERIES, flows

    made = {}
    monkeypatch.setattr(flows, "new_path", lambda _, what: made.setdefault(what, f"file://{tmp_path}/{what}"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        QUERIES["t4_stream_state"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "records").glob("part-*.parquet"))) > 3


def test_fold_of_many_columns(spark, shuffled, monkeypatch):
    """A fold's joins and window are dealt by the number of rows: no task sorts all of them, though they are a few bytes."""
    from changeloom.operators import ranges, timeline

    monkeypatch.setattr(ranges, "TASK_ROWS", 500)
    slots = spark.range(1000).select(F.col("id").alias("rel"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attnum"))
    side = lambda name, dropped: slots.select("rel", "attnum", F.expr(name).alias("name"), F.lit(20).alias("type_oid"), F.lit(-1).alias("typmod"), F.lit(False).alias("not_null"), F.expr(dropped).alias("dropped"))
    old = side("'c' || attnum", "attnum = 3")
    new = side("CASE WHEN attnum = 2 THEN 'd2' ELSE 'c' || attnum END", "attnum = 1 AND rel % 2 = 0")
    mapping = old.filter("NOT dropped").select("rel", "attnum", F.expr("CASE WHEN attnum = 2 AND rel % 3 = 0 THEN 'mine' ELSE name END").alias("name"))
    found = timeline.folded_mapping(mapping, timeline.schema_diff(old, new))
    want = []
    for rel in range(1000):
        names = [(1, "c1")] * (rel % 2) + [(2, "d2" if rel % 3 else "mine"), (3, "c3")]
        want += [(rel, k, attnum, name) for k, (attnum, name) in enumerate(names, 1)]
    assert sorted(map(tuple, found.collect())) == want
    most = max(r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert most < 800
