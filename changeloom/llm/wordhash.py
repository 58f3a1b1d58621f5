"""64-bit hashes of the words of Arrow text batches, whole batches at a time."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import byte_offsets, split_mix, text_bytes

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words without the six ASCII white-space bytes, and words of ASCII letters and digits and all beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


#: Elements that are hashed at a time, so that the work space does not follow the longest text.
WINDOW = 1 << 18


@functools.cache
def _powers(n: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (BASE, BASE_INVERSE))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, end) of ``data``; runs are in order and don't overlap."""
    up, down = _powers()
    out = (ends - starts).astype(np.uint64)
    for a in range(0, len(data), WINDOW):
        b = min(a + WINDOW, len(data))
        low, high = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b, side="left"))
        if low >= high:
            continue
        sums = data[a:b].astype(np.uint64)
        sums += np.uint64(1)
        sums *= up[: b - a]
        np.cumsum(sums, out=sums)
        s, e = np.maximum(starts[low:high] - a, 0), np.minimum(ends[low:high] - a, b - a)
        part = (sums[e - 1] - np.where(s > 0, sums[np.maximum(s - 1, 0)], np.uint64(0))) * down[s]
        if starts[low] < a:  # it began in an earlier window
            part[:1] *= np.uint64(pow(BASE, int(a - starts[low]), 1 << 64))
        out[low:high] += part
    return split_mix(out)


@dataclass
class Words:
    """Words of a batch of texts, in order: hashes, byte bounds in the batch, and the first word of each text (and the end)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    bytes_at: np.ndarray


def words_of(texts: pa.Array, kind: np.ndarray) -> Words:
    """texts: strings without nulls, lower-cased here over A-Z; kind: which bytes make words."""
    data, at = LOWER[text_bytes(texts)], byte_offsets(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(texts) + 1, np.int64), at)
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    hashes = run_hashes(data, starts, ends)
    return Words(hashes, starts, ends, np.searchsorted(starts, at), at)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words (of all words of a shorter text), with repeats, and the first of each text."""
    counts = np.diff(words.first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(words.first[:-1] - first[:-1], n) + np.arange(first[-1])
    length = np.repeat(np.minimum(counts, size), n)
    out = length.astype(np.uint64)
    for k in range(size):
        use = length > k
        term = words.hashes[np.where(use, at + k, 0)] if len(words.hashes) else np.zeros(len(at), np.uint64)
        out = out * np.uint64(BASE) + np.where(use, term, np.uint64(0))
    return split_mix(out), first


def distinct_by_row(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the first of each."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], np.searchsorted(rows[keep], np.arange(len(first)))
