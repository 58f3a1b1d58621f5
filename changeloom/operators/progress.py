"""Progress and operations: watermarks, floors, sealing, rates, checksums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import row_numbers

SEGMENT = 16 << 20


def class_counts(records: DataFrame, size: Column) -> DataFrame:
    """A5. Records and bytes by class, by (rmgr, class) and by (rmgr, route), in one pass."""
    return records.withColumn("_size", size).groupingSets([["class"], ["rmgr", "class"], ["rmgr", "route"]], "rmgr", "class", "route").agg(F.count(F.lit(1)).alias("records"), F.sum("_size").alias("bytes"))


def catalog_fraction(records: DataFrame) -> DataFrame:
    """A6. Catalog records over all, 0 without any."""
    return records.agg(F.coalesce(F.count_if(F.col("class") == "Catalog") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("fraction"))


def first_open(acks: DataFrame, first: int | None = None) -> DataFrame:
    """A7, W5. ``seq``: the first from ``first`` on (the least there is, by default) that is not done, or not there.

    A seq behind a done one is open if it is not done itself: an anti join by seq, no sort over all.
    """
    done = acks.filter("done").select("seq")
    start = acks.agg(F.min("seq")).scalar() if first is None else F.lit(first)
    begin = acks.agg(F.min("seq").alias("seq")) if first is None else acks.agg(F.lit(first).cast("long").alias("seq"))
    behind = done.select((F.col("seq") + 1).alias("seq")).unionByName(begin)
    return behind.join(done, "seq", "left_anti").filter(F.col("seq") >= start).agg(F.min("seq").alias("seq"))


def watermark(acks: DataFrame, first: int | None = None, trailing: int | None = None) -> DataFrame:
    """A7, T1, W5. The greatest commit_lsn of the longest done prefix of the dense seqs (seq, done, publish, commit_lsn).

    A seq that is missing ends the prefix as one that is not done does. Seqs that are not to be published move the prefix
    on, but not the watermark. ``trailing``, a position without any transaction behind the last, counts only when all is done.
    """
    open_seq = first_open(acks, first).scalar()
    mark = F.max(F.when((F.col("seq") < open_seq) & F.col("publish"), F.col("commit_lsn")))
    if trailing is not None:
        mark = F.greatest(mark, F.when(F.max("seq") < open_seq, F.lit(trailing)))
    return acks.agg(mark.alias("watermark"))


def resume_floor(first_lsns: DataFrame, ack: int, filter_durable: int) -> DataFrame:
    """A8. The least of what is in flight and the ack, aligned down to a segment, and not above what the filter has made durable."""
    low = F.least(F.coalesce(F.min("first_lsn"), F.lit(ack)), F.lit(ack))
    return first_lsns.agg(F.least(low - low % SEGMENT, F.lit(filter_durable)).cast("long").alias("floor"))


def seal_by_rows(rows: DataFrame, table: str, order: str, budget: int) -> DataFrame:
    """A9, W7. ``batch`` of each row when a table's batch closes at ``budget`` rows; (table, order) must be unique.

    A table that holds most rows is numbered by ranges, so it is not one task.
    """
    return row_numbers(rows, table, order).withColumn("batch", F.floor(F.col("row") / budget)).drop("row")


def seal_by_bytes(rows: DataFrame, table: str, order: str, size: str, budget: int) -> DataFrame:
    """A9, A10. ``batch`` when a table's batch closes with the row that reaches ``budget`` bytes; (table, order) must be unique.

    Where a batch ends depends on where the one before it ended, so a table's sizes go through one task, in order: three
    numbers a row, a search for each batch and not a step for each row, and nothing held but what is open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, held, number = None, False, 0, 0
        for batch in batches:
            tables, sizes = batch.column(0), batch.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            names = tables.dictionary_encode()
            codes = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]]) if len(codes) else np.zeros(1, np.int64)
            out = np.zeros(len(codes), np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if not begun or tables[a].as_py() != now:
                    now, begun, held, number = tables[a].as_py(), True, 0, 0
                sums, at = np.cumsum(sizes[a:b]), 0
                while at < b - a:
                    passed = int(sums[at - 1]) if at else 0
                    end = int(np.searchsorted(sums, passed + budget - held))  # the row that reaches the budget
                    out[a + at : a + min(end + 1, b - a)] = number
                    if end >= b - a:
                        held += int(sums[-1]) - passed
                        break
                    held, number, at = 0, number + 1, end + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "batch"])

    own = rows.select(F.col(table), F.col(order), F.col(size)).repartition(F.col(table)).sortWithinPartitions(table, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{schema}, batch long")


def counts_by(rows: DataFrame, *by: str | Column, name: str = "n") -> DataFrame:
    """A11, A12, A19. Rows by sequence, by operation, by mode and state: counters summed up map-side."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def rows_per_interval(rows: DataFrame, micros: str, seconds: int = 2) -> DataFrame:
    """A17. Rows by interval of their commit time; ``bucket`` is the interval's number since 1970."""
    own = rows.select(F.window(F.timestamp_micros(micros), f"{seconds} seconds").alias("w"))
    return own.groupBy(F.expr(f"unix_micros(w.start) div {seconds * 1_000_000}").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def distinct_positions(store: DataFrame) -> DataFrame:
    """A18. Tuple positions that a relation's chunks have ever had."""
    return store.groupBy("relid").agg(F.countDistinct("blkno", "offnum").alias("positions"))


def capped(rows: DataFrame, order: Sequence[Column], cap: int) -> DataFrame:
    """O6. The first ``cap`` rows, as a report shows them: a top-k, without a sort over all."""
    return rows.orderBy(*order).limit(cap)


def rate_30s(samples: DataFrame, by: str, seconds: str = "at_s", value: str = "total") -> DataFrame:
    """A13, W6. (last - first) / elapsed over each sample's last 30 s; NULL for one sample or no time between."""
    last = Window.partitionBy(by).orderBy(seconds).rangeBetween(-30, 0)
    rows = samples.withColumns({"_n": F.count(F.lit(1)).over(last), "_v": F.col(value) - F.first(value).over(last), "_t": F.col(seconds) - F.first(seconds).over(last)})
    return rows.withColumn("rate", F.when((F.col("_n") > 1) & (F.col("_t") > 0), F.col("_v") / F.col("_t"))).drop("_n", "_v", "_t")


def percentiles(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """A14. Nearest rank: min, p50, p90, p99, max and the mean to 6 digits."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(*(by or [])).agg(F.min(value).alias("min"), rank(0.5).alias("p50"), rank(0.9).alias("p90"), rank(0.99).alias("p99"), F.max(value).alias("max"), F.round(F.avg(F.col(value).cast("decimal(20,6)")), 6).cast("double").alias("mean"))


def throughput(curve: DataFrame) -> DataFrame:
    """A15. Peak rows a second and greatest backlog of cumulative counts (run, at_s, sent, arrived)."""
    before = Window.partitionBy("run").orderBy("at_s")
    step = (F.col("arrived") - F.lag("arrived").over(before)) / F.nullif(F.col("at_s") - F.lag("at_s").over(before), F.lit(0))
    return curve.withColumn("_rate", step).groupBy("run").agg(F.max("_rate").alias("peak_rate"), F.max(F.col("sent") - F.col("arrived")).alias("max_backlog"))


def checksums(rows: DataFrame, by: str, order: str, value: Column, total: Column) -> DataFrame:
    """A16. Count, sum and the md5 of all values in order, of each group; a group's values are one row, so use ``parity`` for large ones."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s.v), "")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"), F.md5(text).alias("digest"))


def parity(rows: DataFrame, by: str, order: str, value: Column, total: Column) -> DataFrame:
    """A16 for groups of any size. Count, sum and a digest that is the sum of 60 bits of each row's md5, its order value included.

    Two tables agree in a group if they hold equal rows; sums are added up map-side, so nothing of a group is in one place.
    """
    own = F.conv(F.substring(F.md5(F.concat(F.col(order).cast("string"), F.lit("|"), value)), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"), F.sum(own).alias("digest"))


def trim(segments: DataFrame, replay: int, keep_bytes: int, redo: int) -> DataFrame:
    """F18. Segments that end at or before the least of (replay - keep_bytes) and redo."""
    return segments.filter(F.col("end_lsn") <= min(replay - keep_bytes, redo))


def resume_choice(override: Column, bootstrap_end: Column, manifest_ack: Column, head: Column) -> Column:
    """T8."""
    return F.coalesce(override, bootstrap_end, manifest_ack, head)
