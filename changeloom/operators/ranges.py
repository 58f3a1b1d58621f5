"""Work that no single task may hold: order-preserving ranges of a numeric key, and rows dealt by their number."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task sorts, about.
TASK_ROWS = 1_000_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows`` by their keys in as many tasks as a shuffle has, or more, so that each gets about ``TASK_ROWS`` of ``n`` rows.

    Spark joins the partitions of a shuffle by their compressed bytes, which many rows may be; it leaves these as they
    are. What one task may hold anyhow is left to Spark.
    """
    if n <= TASK_ROWS:
        return rows
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS)), *keys)


def range_splits(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 split points of a numeric key into ranges of about as many rows."""
    if n <= 1:
        return []
    found = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], min(0.01, 0.2 / n))
    return sorted(set(map(int, found)))


def with_range(df: DataFrame, key: str, splits: list[int], name: str) -> DataFrame:
    """``name``: which of the ranges between ``splits`` a key is in, by binary search in the JVM (0 for null)."""
    if not splits:
        return df.withColumn(name, F.lit(0))
    edges = [-float("inf"), *map(float, splits), float("inf")]
    keyed = df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(-float("inf"))))
    return Bucketizer(splits=edges, inputCol="_key", outputCol="_range").transform(keyed).withColumn(name, F.col("_range").cast("int")).drop("_key", "_range")


def row_numbers(rows: DataFrame, by: str, order: str, n: int | None = None) -> DataFrame:
    """``row`` from 0 of each row in its group, by a numeric ``order`` that is unique in the group.

    Rows are numbered inside ranges of the order; a group's ranges start where the rows of those before them end, by a
    table of as many rows as groups and ranges. So a group that holds all rows is numbered by as many tasks as any other.
    """
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = with_range(rows, order, range_splits(rows, order, n), "_part")
    sizes = own.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(by, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order)) - 1
    return own.withColumn("_inside", inside).join(starts, [by, "_part"]).withColumn("row", F.col("_start") + F.col("_inside")).drop("_part", "_inside", "_start")
