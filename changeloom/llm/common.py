"""What the training-data operators share: tables, the shared folder, ordered ranges, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranges import range_splits, with_range  # noqa: F401
from ..sources.shared import Scratch, materialise, new_path, shared_dir  # noqa: F401

#: Bytes of text that a Python helper holds in its own buffers at a time; a longer text is a slice by itself.
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch, where the session sets none.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with Arrow batches of bounded size."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, unless the session has bounds of its own: texts make wide rows."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(bound))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_broadcast(df: DataFrame, rows: int, limit: int = 2_000_000) -> DataFrame:
    """Hint a broadcast only where ``rows`` (counted by the caller) is within ``limit``; else leave it to a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose texts hold about ``limit`` bytes together."""
    ends = np.cumsum(np.diff(byte_offsets(texts)))
    a, n = 0, len(texts)
    while a < n:
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield a, min(b, n)
        a = b


def filled(array: pa.Array) -> pa.Array:
    """A plain string array with null as the empty text."""
    array = array.cast(pa.string()) if array.type != pa.string() else array
    return array.fill_null("") if array.null_count else array


def texts_of(array: pa.Array) -> Iterator[str]:
    """The texts as Python strings, a slice of them at a time; null ones are empty."""
    array = filled(array)
    for a, b in slices(array):
        yield from array.slice(a, b - a).to_pylist()


def byte_offsets(array: pa.Array) -> np.ndarray:
    """Offsets into ``text_bytes`` of a string or binary array without nulls."""
    raw = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int32)
    return raw.astype(np.int64) - raw[0]


def text_bytes(array: pa.Array) -> np.ndarray:
    """All UTF-8 bytes of a string array, texts end to end."""
    if not len(array) or array.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    raw = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], dtype=np.uint8)[raw[0] : raw[-1]]


def split_mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc32_mod(key: str, n: int) -> Column:
    """crc32 of a key as text, modulo n; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n
