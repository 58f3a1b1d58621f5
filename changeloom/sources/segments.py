"""Change records in segment files, and a stream of them by log position.

A segment holds the records of [start, end) and is named by both, in fixed-width hex, so names sort by position. The
stream's offset is an lsn; ``maxSegments`` a trigger bounds what a micro-batch takes in.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.dataflow import CHANGES

#: kind: row (a change, TRUNCATE with op T included) or end. For ends, xid is the top transaction's or a prepared one's
#: (``twophase_xid``); subxids lists its savepoints, rolled_back those that were undone.
RECORD_SCHEMA = f"kind string, {CHANGES}, outcome string, twophase_xid bigint, subxids array<bigint>, rolled_back array<bigint>, ts_us bigint"
_NAME = re.compile(r"^([0-9A-F]{16})-([0-9A-F]{16})\.parquet$")


def segment_name(start: int, end: int) -> str:
    return f"{start:016X}-{end:016X}.parquet"


def write_segments(records: DataFrame, path: str, span: int) -> None:
    """Cut records into segments of ``span`` positions, one file each, written by the tasks and moved into place whole."""
    names = [f.name for f in records.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                name = segment_name(now * span, (now + 1) * span)
                pq.write_table(pa.Table.from_batches(held).select(names), f"{root}/.{name}", filesystem=store)
                store.move(f"{root}/.{name}", f"{root}/{name}")
                yield pa.RecordBatch.from_pydict({"name": [name]})

        for batch in batches:
            slots = batch.column("slot").to_pylist()
            cuts = [0, *(k for k in range(1, len(slots)) if slots[k] != slots[k - 1]), len(slots)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if slots[a] != now:
                        yield from close()
                        now, held = slots[a], []
                    held.append(batch.slice(a, b - a))
        yield from close()

    dealt = records.withColumn("slot", F.expr(f"lsn div {span}")).repartition("slot").sortWithinPartitions("slot", "lsn", "tuple_idx")
    dealt.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def list_segments(path: str) -> list[tuple[int, int, str]]:
    """(start, end, file) in order."""
    store, root = pafs.FileSystem.from_uri(path)
    found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((int(m[1], 16), int(m[2], 16), f.path) for f in found if (m := _NAME.match(f.base_name)))


def read_range(spark: SparkSession, path: str, after: int, upto: int) -> DataFrame:
    """S8. Archived records of (after, upto], from the segments that can hold some."""
    store, _ = pafs.FileSystem.from_uri(path)
    scheme = path.split("://")[0] if "://" in path else "file"
    files = [f"{scheme}://{p}" for a, b, p in list_segments(path) if b > after and a <= upto]
    rows = spark.read.schema(RECORD_SCHEMA).parquet(*files) if files else spark.createDataFrame([], RECORD_SCHEMA)
    return rows.filter((F.col("lsn") > after) & (F.col("lsn") <= upto))


def trim_segments(path: str, cutoff: int) -> list[str]:
    """F18. Delete segments that end at or before ``cutoff``; returns what went."""
    store, _ = pafs.FileSystem.from_uri(path)
    gone = [p for _, b, p in list_segments(path) if b <= cutoff]
    for p in gone:
        store.delete_file(p)
    return gone


@dataclass
class _Segment(InputPartition):
    file: str
    after: int
    upto: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.start = int(options.get("startingLsn", 0))
        self.most = int(options.get("maxSegments", 0))
        self.at = self.start

    def initialOffset(self) -> dict:
        return {"lsn": self.start}

    def latestOffset(self) -> dict:
        ahead = [b for _, b, _ in list_segments(self.path) if b > self.at]
        if ahead:
            self.at = ahead[min(len(ahead), self.most) - 1] if self.most else ahead[-1]
        return {"lsn": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["lsn"])
        return [_Segment(p, start["lsn"], end["lsn"]) for a, b, p in list_segments(self.path) if b > start["lsn"] and a < end["lsn"]]

    def read(self, partition: _Segment) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=self.names):
                lsn = batch.column("lsn").to_numpy()
                yield batch.filter(pa.array((lsn >= partition.after) & (lsn < partition.upto)))

    def commit(self, end: dict) -> None:
        pass


class SegmentSource(DataSource):
    """``spark.readStream.format("segments")``; options ``path``, ``startingLsn``, ``maxSegments``."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options, schema)


class Manifest:
    """K10. A small JSON document. Each writing is a file of its own with the next number, moved into place whole, so that a
    reader finds the one before or the new one, also where a store has no atomic replace; older ones are deleted."""

    def __init__(self, path: str):
        self.store, self.path = pafs.FileSystem.from_uri(path)

    def _files(self) -> list[str]:
        folder, _, name = self.path.rpartition("/")
        found = self.store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(f.path for f in found if re.fullmatch(rf"{re.escape(name)}\.\d{{12}}\.json", f.base_name))

    def read(self) -> dict:
        if not (files := self._files()):
            return {}
        with self.store.open_input_stream(files[-1]) as f:
            return json.loads(f.read())

    def write(self, value: dict) -> None:
        before = self._files()
        number = int(before[-1].split(".")[-2]) + 1 if before else 0
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        with self.store.open_output_stream(f"{self.path}.new") as f:
            f.write(json.dumps(value, sort_keys=True).encode())
        self.store.move(f"{self.path}.new", f"{self.path}.{number:012d}.json")
        for path in before:
            self.store.delete_file(path)
