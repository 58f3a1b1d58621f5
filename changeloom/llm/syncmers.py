"""Document fingerprints from closed syncmers.

A k-mer of a text's UTF-8 bytes is a closed syncmer if the least of its s-mers, by a hash, is its first or its last.
That depends on the k-mer alone, so two texts that share a passage share its syncmers, wherever it stands: anchors for
positional matching. A text's fingerprint is the ``size`` least hashes of its syncmers; the likeness of two fingerprints
estimates the similarity of the syncmer sets, with a standard error of at most 0.5 / sqrt(size). ``aligned`` is exact: it
takes all anchors of both texts and counts those that they have in one order.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_offsets, filled, map_batches, partitions, range_splits, slices, split_mix, text_bytes, with_range

K, S = 16, 5
#: Hashes of a fingerprint: 64 have a standard error of 0.06.
SKETCH = 64


def closed_syncmers(texts: pa.Array, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions in the batch and hashes of all closed syncmers, and the first of each text.

    A text shorter than ``k`` bytes, but not empty, is one anchor by itself.
    """
    data, at = text_bytes(texts), byte_offsets(texts)
    n, width = len(data), k - s + 1
    sizes = np.diff(at)
    found, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n >= k:
        wide = data.astype(np.uint64)
        small = wide[: n - s + 1].copy()
        for j in range(1, s):
            small = (small << np.uint64(8)) | wide[j : n - s + 1 + j]
        small = split_mix(small)
        least, span = small, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: n - k + 1], least[width - span : width - span + n - k + 1])
        edge = (small[: n - k + 1] == least) | (small[width - 1 :] == least)
        room = np.repeat(at[1:], sizes)[: n - k + 1] - np.arange(n - k + 1) >= k
        found = np.flatnonzero(edge & room)
        hashes = np.zeros(len(found), np.uint64)
        for j in range(k):
            hashes = hashes * np.uint64(0x100000001B3) + wide[found + j] + np.uint64(1)
        hashes = split_mix(hashes)
    return _with_whole(texts, found, hashes, (sizes > 0) & (sizes < k))


def _with_whole(texts: pa.Array, found: np.ndarray, hashes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors with one more at the start of ``which`` texts: the hash of the whole text."""
    data, at = text_bytes(texts), byte_offsets(texts)
    short = np.flatnonzero(which)
    if len(short):
        raw = data.tobytes()
        own = np.array([int.from_bytes(hashlib.blake2b(raw[at[i] : at[i + 1]], digest_size=8).digest(), "little") for i in short], np.uint64)
        found, hashes = np.concatenate([found, at[short]]), np.concatenate([hashes, own])
        order = np.argsort(found, kind="stable")
        found, hashes = found[order], hashes[order]
    return found, hashes, np.searchsorted(found, at)


def text_anchors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``closed_syncmers``, and an anchor by itself for any other text that is not empty but has none."""
    found, hashes, first = closed_syncmers(texts)
    return _with_whole(texts, found, hashes, (np.diff(byte_offsets(texts)) > 0) & (np.diff(first) == 0))


def sketches(texts: pa.Array, size: int = SKETCH) -> list[np.ndarray]:
    """``least_hashes`` of the texts' anchors."""
    _, hashes, first = text_anchors(texts)
    return least_hashes(hashes, first, size)


def least_hashes(hashes: np.ndarray, first: np.ndarray, size: int = SKETCH) -> list[np.ndarray]:
    """The ``size`` least distinct hashes of each text, 32 bits of each, ascending; fewer for texts with fewer syncmers."""
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    n = np.diff(first)
    # the least are below a bound that so many pass, nearly always; a text where too few do is taken whole
    bound = np.minimum(1.0, 4 * size / np.maximum(n, 1)) * (1 << 32)
    low = values < np.repeat(bound, n)
    rows = np.repeat(np.arange(len(n)), n)
    values_low, rows_low = values[low], rows[low]
    order = np.argsort((rows_low.astype(np.uint64) << np.uint64(32)) | values_low, kind="stable")
    values_low, rows_low = values_low[order], rows_low[order]
    cuts = np.searchsorted(rows_low, np.arange(len(n) + 1))
    out = []
    for i in range(len(n)):
        own = np.unique(values_low[cuts[i] : cuts[i + 1]])
        if len(own) < size and bound[i] < (1 << 32):
            own = np.unique(values[first[i] : first[i + 1]])
        out.append(own[:size])
    return out


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u4").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Share of both among the least of either: 1 for equal ones (two empty ones too), 0 if nothing is shared."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:size]
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), least).sum() / len(least))


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the anchors of two texts, given as their hashes in order, that stand in one order in both; 1 for equal ones.

    The k-th anchor of a hash in one text matches the k-th in the other; of the matches, the longest run that rises in both counts.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    keys = []
    for x in (a, b):
        order = np.argsort(x, kind="stable")
        new = np.concatenate([[True], x[order][1:] != x[order][:-1]])
        nth = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        key = np.empty(len(x), np.uint64)
        key[order] = x[order] + split_mix(nth.astype(np.uint64))
        keys.append(key)
    _, at, there = np.intersect1d(*keys, return_indices=True)
    there = there[np.argsort(at)]
    if (np.diff(there) > 0).all():
        n = len(there)
    else:
        ends: list[int] = []  # the least end of a rising run of each length
        for t in there.tolist():
            k = bisect.bisect_left(ends, t)
            ends[k : k + 1] = [t]
        n = len(ends)
    return 2 * n / (len(a) + len(b))


def fingerprints(docs: DataFrame, *, size: int = SKETCH) -> DataFrame:
    """``doc_id, fingerprint`` of every row of ``docs`` (``doc_id, text``); null texts are empty, with an empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column("text"))
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([to_text(x) for x in sketches(texts.slice(a, b - a), size)], pa.string())], ["doc_id", "fingerprint"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fingerprint string")


def anchors(docs: DataFrame) -> DataFrame:
    """``doc_id, position, hash`` of every closed syncmer (or of the whole text, if it has none), positions in bytes of its text, for positional matching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column("text"))
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                found, hashes, first = text_anchors(part)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(found - np.repeat(byte_offsets(part)[:-1], n)), pa.array(hashes.view(np.int64))], ["doc_id", "position", "hash"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, position long, hash long")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, aligned_edited double"


def compare_with_next(docs: DataFrame, *, size: int = SKETCH) -> DataFrame:
    """Each text against an edit of it that ends as the next document begins, and against that next document.

    ``near_edited`` and ``near_next`` are likenesses of fingerprints, ``aligned_edited`` that of all anchors by position.

    The order is descending (doc_id, text), null doc_ids last; after the last comes the first. The last half of a text's
    code points (rounded down) gives way to as many of the next text's first, or all. Null texts are empty; repeated
    rows count each; a single document is its own next. The texts are shuffled once, into ranges of doc_ids; each
    range also gets the row that follows its last.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    splits = range_splits(rows, "doc_id", partitions(docs.sparkSession))
    rows = with_range(rows, "doc_id", splits, "range")
    tops = {r["range"]: r.top for r in rows.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}  # a row a range
    used = sorted(tops)
    above = [(k, tops[k], up) for k, up in zip(used, used[1:] + used[:1], strict=True)]
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(above, "range int, top long, above int")), "range")
    here, there = F.struct(F.col("range").alias("to"), F.lit(False).alias("follows")), F.struct(F.col("above").alias("to"), F.lit(True).alias("follows"))
    both = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(here, there)).otherwise(F.array(here))
    rows = rows.select("doc_id", "text", F.explode(both).alias("at")).select("doc_id", "text", "at.to", "at.follows")
    dealt = rows.repartitionById(len(splits) + 1, F.col("to")).sortWithinPartitions("to", "follows", F.desc_nulls_last("doc_id"), F.desc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows that wait for their next one: doc_id, text, follows, range

        def compared(rows_: list[tuple]) -> Iterator[pa.RecordBatch]:
            """All rows but the last, and but those that are there for the row before them."""
            at = [k for k in range(len(rows_) - 1) if not rows_[k][2] and rows_[k][3] == rows_[k + 1][3]]
            if not at:
                return
            texts = [r[1] for r in rows_]
            _, hashes, first = text_anchors(pa.array(texts, pa.string()))
            own = least_hashes(hashes, first, size)
            edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in at]
            _, edit_hashes, edit_first = text_anchors(pa.array(edited, pa.string()))
            edits = least_hashes(edit_hashes, edit_first, size)
            columns = [
                pa.array([rows_[k][0] for k in at], pa.int64()),
                pa.array([len(texts[k]) for k in at], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([to_text(own[k]) for k in at], pa.string()),
                pa.array([to_text(x) for x in edits], pa.string()),
                pa.array([likeness(own[k], x, size) for k, x in zip(at, edits, strict=True)], pa.float64()),
                pa.array([likeness(own[k], own[k + 1], size) for k in at], pa.float64()),
                pa.array([aligned(hashes[first[k] : first[k + 1]], edit_hashes[edit_first[n] : edit_first[n + 1]]) for n, k in enumerate(at)], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in EDITED.split(", ")])

        for batch in batches:
            texts = filled(batch.column("text"))
            ids, follows, to = (batch.column(c).to_pylist() for c in ("doc_id", "follows", "to"))
            for a, b in slices(texts):
                held += zip(ids[a:b], texts.slice(a, b - a).to_pylist(), follows[a:b], to[a:b], strict=True)
                yield from compared(held)
                held = held[-1:]

    return map_batches(dealt, run, EDITED)
