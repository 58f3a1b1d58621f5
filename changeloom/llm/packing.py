"""Cost-balanced packing of documents into token sequences of a fixed capacity.

Attention over a piece of n tokens costs about ``linear * n + quadratic * n * n``. Within a pool of documents,
whole sequences are cut off the documents that are longer than the capacity; what is left is taken in
descending order and goes to the sequence of lowest cost that has room. What fits nowhere whole is cut over the
sequences of lowest cost. The rest of a pool's tokens, less than one sequence, fills sequences whose lengths are
powers of two, which need no padding.

A pool is what one task has read, in its order, up to ``pool_tokens``; no shuffle, and memory bound by the pool.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ENCODED_BYTES, BatchEncoder
from .common import filled, map_batches, slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CAPACITY, END_ID = 2048, 1
#: Tokens of a pool, and of attention's two costs: a token's, and a pair's.
POOL_TOKENS, LINEAR, QUADRATIC = 4 << 20, 1.0, 1 / 1024


class _Rooms:
    """Open sequences by room: a heap by cost for each, and the least of each range of rooms in a tree over them."""

    def __init__(self, capacity: int):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.base = 1 << capacity.bit_length()
        self.least: list[tuple[float, int, int]] = [_NONE] * (2 * self.base)

    def _settle(self, room: int) -> None:
        own, k = self.heaps[room], self.base + room
        self.least[k] = (*own[0], room) if own else _NONE
        while k := k >> 1:
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])

    def push(self, room: int, cost: float, s: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, s))
            self._settle(room)

    def pop(self, n: int) -> tuple[float, int] | None:
        """The sequence of lowest cost among all that have room for ``n``; None if none has."""
        k = self.base + n
        best = self.least[k]
        while k > 1:
            if not k & 1:
                best = min(best, self.least[k + 1])
            k >>= 1
        if best is _NONE:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._settle(best[2])
        return best[:2]


_NONE = (float("inf"), -1, -1)


def pack_pool(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, and the number of sequences."""
    pieces: list[tuple[int, int, int, int, int]] = []
    n_seq, tails = 0, []
    for doc, n in enumerate(lengths.tolist()):
        for k in range(n // capacity):
            pieces.append((doc, k * capacity, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            tails.append((n % capacity, doc, n - n % capacity))
    total = sum(n for n, _, _ in tails)
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> b & 1]
    open_ = _Rooms(capacity)
    for s, room in enumerate(rooms):
        open_.push(room, 0.0, s)
    left, used = list(rooms), [0] * len(rooms)
    tails.sort(key=lambda t: (-t[0], t[1]))

    def put(s: int, doc: int, start: int, n: int) -> None:
        pieces.append((doc, start, n, n_seq + s, used[s]))
        used[s] += n
        left[s] -= n

    rest = []
    for n, doc, start in tails:
        if (found := open_.pop(n)) is None:
            rest.append((n, doc, start))
            continue
        c, s = found
        put(s, doc, start, n)
        open_.push(left[s], c + linear * n + quadratic * n * n, s)
    for n, doc, start in rest:  # cut: room only falls, so they still fit nowhere whole
        while n:
            c, s = open_.pop(1)
            m = min(n, left[s])
            put(s, doc, start, m)
            open_.push(left[s], c + linear * m + quadratic * m * m, s)
            start, n = start + m, n - m
    return pieces, n_seq + len(rooms)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = END_ID, pool_tokens: int = POOL_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    docs: ``doc_id, text``; other columns are ignored. A null or empty text is its end id alone. A null doc_id and
    repeated rows are packed like any other row. An empty table gives no row. ``sequence_id`` holds the partition
    in its upper bits, so equal input partitions give equal ids, also when a task runs again. One document longer
    than ``pool_tokens`` is a pool by itself.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def flush(part: int, pool: int, ids: list, docs_: list) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        pieces, n_seq = pack_pool(lengths, capacity, linear, quadratic)
        doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True)) if pieces else (np.zeros(0, np.int64),) * 5
        cuts = [ids[d][s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        columns = [pa.array(docs_, pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(c.tobytes()) for c in cuts], pa.int64()), pa.array(lengths[doc]), pa.array(seq + ((part << 34) + (pool << 20))), pa.array(offset)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(np.concatenate(cuts).astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = BatchEncoder(tokenizer_path), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = pool = 0
        for batch in batches:
            texts = filled(batch.column("text"))
            for a, b in slices(texts, ENCODED_BYTES):
                flat, at = encoder.encode(texts.slice(a, b - a))
                for k, doc in enumerate(batch.column("doc_id").slice(a, b - a).to_pylist()):
                    ids.append(np.append(flat[at[k] : at[k + 1]], np.int32(end_id)).astype("<u4"))
                    names.append(doc)
                    held += len(ids[-1])
                    if held >= pool_tokens:
                        yield flush(part, pool, ids, names)
                        ids, names, held, pool = [], [], 0, pool + 1
        if ids:
            yield flush(part, pool, ids, names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA + (", ids array<int>" if with_ids else ""))
