"""Token ids in ORC: one file per range of document ids, in ascending order.

ORC writes integers run-length encoded in stripes, with an index entry for every ``ROW_INDEX_STRIDE`` rows and a
Bloom filter on ``doc_id``; a reader takes stripes in parallel, and a filter on ``doc_id`` skips files, stripes
and row groups by their statistics.

The files hold ``doc_id, shard, start_in_shard, n_tokens, ids``. A document's place among all ids is its shard's first
place plus ``start_in_shard``; the shards' first places are a small table beside the files, a row for each file, so a
look-up of documents reads nothing but their stripes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ENCODED_BYTES, BatchEncoder
from .common import filled, map_batches, partitions, range_splits, slices, with_range

FILE_SCHEMA = "doc_id long, shard int, start_in_shard long, n_tokens int, ids array<int>"
SHARDS = "_shards"
END_ID, ROW_INDEX_STRIDE, BLOOM_FPP = 2, 2000, 0.01


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = END_ID, shards: int | None = None, row_index_stride: int = ROW_INDEX_STRIDE, bloom_fpp: float = BLOOM_FPP) -> None:
    """Encode ``docs`` (``doc_id, text``; others ignored) and write them to ORC files under ``path``.

    Null texts are empty. Rows go in the order of ``(doc_id, text)``, null doc_ids first; repeated rows are kept.
    An empty table gives an empty set of files. The text is shuffled once, into ranges of equal size.
    """
    n = shards or partitions(docs.sparkSession)
    splits = range_splits(docs, "doc_id", n)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = with_range(rows, "doc_id", splits, "shard").repartitionById(len(splits) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at_shard, start = BatchEncoder(tokenizer_path), None, 0
        for batch in batches:
            texts = filled(batch.column("text"))
            for a, b in slices(texts, ENCODED_BYTES):
                flat, at = encoder.encode(texts.slice(a, b - a))
                sizes = np.diff(at) + 1
                ids = np.insert(flat, at[1:], end_id)
                shard = batch.column("shard").slice(a, b - a).to_numpy()
                if shard[0] != at_shard:
                    at_shard, start = shard[0], 0
                starts = start + np.cumsum(sizes) - sizes
                for k in np.flatnonzero(np.diff(shard)) + 1:  # a later shard of the same task starts at 0 again
                    starts[k:] -= starts[k]
                    at_shard = shard[k]
                start = int(starts[-1] + sizes[-1])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(shard), pa.array(starts), pa.array(sizes.astype(np.int32)), lists], ["doc_id", "shard", "start_in_shard", "n_tokens", "ids"])

    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(bloom_fpp), "orc.row.index.stride": str(row_index_stride), "orc.create.index": "true", "compression": "zstd"}
    map_batches(dealt, run, FILE_SCHEMA).write.options(**options).orc(path)
    spark, at, places = docs.sparkSession, 0, []
    sizes = spark.read.schema(FILE_SCHEMA).orc(path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each file
    for r in sorted(sizes):
        places.append((r.shard, at))
        at += r.n
    spark.createDataFrame(places, "shard int, first long").coalesce(1).write.parquet(f"{path}/{SHARDS}")


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows with ``start``, a document's place among all ids. ``doc_ids`` is pushed down to the ORC index."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    firsts = F.broadcast(spark.read.schema("shard int, first long").parquet(f"{path}/{SHARDS}"))  # as many rows as files
    return rows.join(firsts, "shard").select(*rows.columns, (F.col("first") + F.col("start_in_shard")).alias("start"))


def with_ids_crc32(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy().astype(np.int64)
            at = at - at[0] if len(at) else at
            crc = [zlib.crc32(flat[at[k] : at[k + 1]].tobytes()) for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows.select("doc_id", "start", "ids"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
