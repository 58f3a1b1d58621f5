"""Benchmark decontamination with an FM-index over each shard of the training texts.

A benchmark item's windows are its runs of ``window`` words (an item of fewer words is one window). A task cuts its
documents into shards, builds an FM-index over a shard's words (suffix order, Burrows-Wheeler transform, a wavelet
matrix for ranks, every eighth suffix position kept) and searches all windows backwards at once; occurrences are
located from the kept positions and merged into removal spans.

The index is over what can match: words that no benchmark item has only separate, and so do runs of benchmark words
shorter than the shortest window. Documents are neither shuffled nor gathered. The windows are broadcast; those of a
benchmark of more than ``block_windows`` in blocks of about that many, one after the other, of which the driver and the
tasks hold one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filled, map_batches, slices
from .wordhash import ALNUM, Words, words_of

WINDOW, BLOCK_WINDOWS, SHARD_BYTES, SAMPLE = 10, 1_000_000, 4 << 20, 8
HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WaveletMatrix:
    """Ranks of symbols in a sequence, for arrays of symbols and positions."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        rest = symbols
        for bit in range(max(1, (n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1 == 1
            counts = np.zeros(len(rest) + 1, np.int64)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((bit, counts, len(rest) - int(counts[-1])))
            rest = np.concatenate([rest[~ones], rest[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i."""
        low = np.zeros_like(i)
        for bit, counts, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            low = np.where(one, zeros + counts[low], low - counts[low])
            i = np.where(one, zeros + counts[i], i - counts[i])
        return i - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; symbols end with their only 0."""
    n = len(symbols)
    rank, k = symbols.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, np.int64)
        fresh[0] = 0
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        self.bwt = symbols[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        self.ranks = WaveletMatrix(self.bwt, n_symbols)
        self.kept = order % sample == 0
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept)])
        self.positions = order[self.kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of patterns of one length, one a row."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            a = self.first[c] + self.ranks.rank(c, low[live])
            b = self.first[c] + self.ranks.rank(c, high[live])
            low[live], high[live] = a, b
            live = live[b > a]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a kept one."""
        rows, out, steps, live = rows.copy(), np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(live):
            done = self.kept[rows[live]]
            at = live[done]
            out[at] = self.positions[self.kept_before[rows[at]]] + steps
            live = live[~done]
            c = self.bwt[rows[live]]
            rows[live] = self.first[c] + self.ranks.rank(c, rows[live])
            steps += 1
        return out


@dataclass
class Windows:
    """Benchmark windows: sorted hashes of their words, windows of each length as symbols (from 2), and each one's items."""

    vocabulary: np.ndarray
    by_length: list[tuple[np.ndarray, np.ndarray]]
    items: list[tuple[str, ...]]


def windows_of(rows: list[tuple[np.ndarray, tuple[str, ...]]]) -> Windows:
    vocabulary = np.unique(np.concatenate([w for w, _ in rows])) if rows else np.zeros(0, np.uint64)
    lengths = np.array([len(w) for w, _ in rows], np.int64)
    by_length = []
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        by_length.append((np.searchsorted(vocabulary, np.stack([rows[k][0] for k in at])) + 2, at))
    return Windows(vocabulary, by_length, [i for _, i in rows])


def occurrences(windows: Windows, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, first word and length of all occurrences in documents whose words have these hashes."""
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(windows.vocabulary):
        return none, none, none
    place = np.minimum(np.searchsorted(windows.vocabulary, hashes), len(windows.vocabulary) - 1)
    known = windows.vocabulary[place] == hashes
    edge = np.zeros(len(hashes) + 1, bool)
    edge[first] = True
    begins, closes = known.copy(), known.copy()
    begins[1:] &= ~known[:-1] | edge[1:-1]
    closes[:-1] &= ~known[1:] | edge[1:-1]
    a, b = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    shortest = min(p.shape[1] for p, _ in windows.by_length)
    a, b = a[b - a >= shortest], b[b - a >= shortest]
    if not len(a):
        return none, none, none
    sizes = b - a + 1  # and a separator
    ends = np.cumsum(sizes)
    at = np.repeat(a - (ends - sizes), sizes) + np.arange(ends[-1])
    symbols = place[np.minimum(at, len(place) - 1)] + 2
    symbols[ends - 1] = 1
    symbols = np.append(symbols, 0)
    index = FMIndex(symbols, len(windows.vocabulary) + 2)
    found = []
    for patterns, names in windows.by_length:
        low, high = index.search(patterns)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append((names[which], at[index.locate(rows)], np.full(len(rows), patterns.shape[1], np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def hit_words(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are inside an occurrence."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + length, -1)
    return np.cumsum(marks)[:-1] > 0


def cut_words(text: str, words: Words, hit: np.ndarray) -> str:
    """The text without its removal spans: each from the first to the last of neighbouring words that are hit."""
    raw, parts, done = text.encode(), [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        parts.append(raw[done : words.starts[a]])
        done = int(words.ends[b - 1])
    return b" ".join([*parts, raw[done:]]).decode()


def cut_windows(text: str, windows: Windows) -> str:
    """The text without its removal spans, until no window is left."""
    while True:
        words = words_of(pa.array([text], pa.string()), ALNUM)
        _, at, length = occurrences(windows, words.hashes, words.first)
        if not len(at):
            return text
        text = cut_words(text, words, hit_words(at, length, len(words.hashes)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows ``words array<long>`` (word hashes) with the sorted ``items`` that have them, as text; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ids, out, names = words_of(filled(batch.column("text")), ALNUM), batch.column("item_id").to_pylist(), [], []
            for k, item in enumerate(ids):
                own = words.hashes[words.first[k] : words.first[k + 1]].view(np.int64)
                spans = [own[s : s + window] for s in range(len(own) - window + 1)] if len(own) >= window else [own] if len(own) else []
                out += [s.tolist() for s in spans]
                names += [item] * len(spans)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64())), pa.array(names, pa.string())], ["words", "item_id"])

    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).filter(F.col("item_id").isNotNull())
    return map_batches(items, run, "words array<long>, item_id string").groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


@dataclass
class _Blocks:
    """The windows as a table, and how many blocks to take it in."""

    rows: DataFrame
    number: int

    def broadcasts(self) -> Iterator[Broadcast]:
        """One block after the other; each is destroyed when the next is asked for."""
        for k in range(self.number):
            part = self.rows.filter(F.pmod(F.xxhash64("words"), F.lit(self.number)) == k)
            shared = self.rows.sparkSession.sparkContext.broadcast(windows_of([(np.array(r.words, np.int64).view(np.uint64), tuple(r["items"])) for r in part.toLocalIterator()]))
            yield shared
            shared.destroy()


def _blocks(benchmark: DataFrame, window: int, block_windows: int, scratch: Scratch) -> _Blocks:
    rows = scratch.write(benchmark_windows(benchmark, window), "windows")
    return _Blocks(rows, max(1, -(-rows.count() // block_windows)))


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Documents with their words' hashes and each one's first word, up to about ``shard_bytes`` of text together."""
    held: list[pa.RecordBatch] = []
    hashes: list[np.ndarray] = []
    first, n_bytes = [np.zeros(1, np.int64)], 0

    def out():
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        return rows[0] if rows else held[0], np.concatenate(hashes), np.concatenate(first)

    for batch in batches:
        texts = filled(batch.column("text"))
        for a, b in slices(texts):
            words = words_of(texts.slice(a, b - a), ALNUM)
            held.append(batch.slice(a, b - a))
            hashes.append(words.hashes)
            first.append(words.first[1:] + first[-1][-1])
            n_bytes += int(words.bytes_at[-1])
            if n_bytes >= shard_bytes:
                yield out()
                held, hashes, first, n_bytes = [], [], [np.zeros(1, np.int64)], 0
    if held:
        yield out()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Words are runs of ASCII letters (A-Z lower-cased), digits and everything beyond ASCII. Null and empty texts have no
    words and are clean; null item_ids are no items, others count as text; repeated rows are reported each; other columns
    are ignored. With an empty benchmark every document is clean.
    """
    scratch = Scratch(docs.sparkSession)
    blocks = _blocks(benchmark, window, block_windows, scratch)
    if blocks.number > 1:
        return _hits_in_blocks(docs, blocks, shard_bytes, scratch)
    shared = next(blocks.broadcasts())
    scratch.drop("windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for rows, hashes, first in _shards(batches, shard_bytes):
            which, at, length = occurrences(windows, hashes, first)
            sums = np.concatenate([[0], np.cumsum(hit_words(at, length, len(hashes)))])
            n_hit = sums[first[1:]] - sums[first[:-1]]
            n_items, digest = np.zeros(len(n_hit), np.int64), np.full(len(n_hit), nothing, object)
            doc = np.searchsorted(first, at, side="right") - 1
            pairs = np.unique(np.stack([doc, which], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            for chunk in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else []:
                items = sorted({i for w in chunk[:, 1].tolist() for i in windows.items[w]})
                n_items[chunk[0, 0]], digest[chunk[0, 0]] = len(items), hashlib.sha256(",".join(items).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(first)), pa.array(n_hit), pa.array(n_items), pa.array(digest.tolist(), pa.string()), pa.array(n_hit > 0)], HITS.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", "))

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, HITS)


def _spans_by_row(rows: DataFrame, blocks: _Blocks, shard_bytes: int, scratch: Scratch) -> DataFrame:
    """``row, n_words, spans, items`` of each row (``row, text``) and block of windows; the blocks' results are written one by one."""
    schema = "row long, n_words long, spans array<struct<a: long, b: long>>, items array<string>"

    def of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, hashes, first in _shards(batches, shard_bytes):
                which, at, length = occurrences(shared.value, hashes, first)
                doc = np.searchsorted(first, at, side="right") - 1
                spans: list[set] = [set() for _ in range(part.num_rows)]
                items: list[set] = [set() for _ in range(part.num_rows)]
                for d, w, p, n in zip(doc.tolist(), which.tolist(), at.tolist(), length.tolist(), strict=True):
                    spans[d].add((p - int(first[d]), p - int(first[d]) + n))
                    items[d].update(shared.value.items[w])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(np.diff(first)), pa.array([[{"a": a, "b": b} for a, b in sorted(s)] for s in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                    ["row", "n_words", "spans", "items"],
                )

        return map_batches(rows.select("row", "text"), run, schema)

    found = None
    for k, shared in enumerate(blocks.broadcasts()):
        own = scratch.write(of(shared), f"spans-{k}")
        found = own if found is None else found.unionByName(own)
    return found


def _hits_in_blocks(docs: DataFrame, blocks: _Blocks, shard_bytes: int, scratch: Scratch) -> DataFrame:
    """For a benchmark beyond one block: each block's spans and items, joined by row."""
    rows = scratch.write(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = _spans_by_row(rows, blocks, shard_bytes, scratch)
    both = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0).cast("long"), s.b - F.greatest(s.a, acc.end))).alias("n"), F.greatest(acc.end, s.b).alias("end")),
        lambda acc: acc.n,
    )
    names = F.array_sort("items")
    out = rows.select("row", "doc_id").join(both, "row").withColumn("n_hit", covered)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with all benchmark windows cut out of ``text`` (and ``n_chars`` counted anew where it is a column).

    Texts without a window stay as they are, null texts too; a text in which the cut leaves no word goes. All columns
    are kept, and rows with null or repeated doc_ids. An empty table stays empty, and an empty benchmark cuts nothing.
    Cutting is repeated until no window is left, as two ends may join to a new one.
    """
    scratch = Scratch(docs.sparkSession)
    blocks = _blocks(benchmark, window, block_windows, scratch)
    if blocks.number == 1:
        out = _cut(docs, next(blocks.broadcasts()), shard_bytes)
        scratch.drop("windows")
        return out
    rows, names = docs, docs.columns
    while True:  # the same rounds as ``cut_windows``, over all blocks each
        rows = scratch.write(rows.toDF(*(f"c{k}" for k in range(len(names)))).withColumns({"text": F.col(f"c{names.index('text')}").cast("string"), "row": F.monotonically_increasing_id()}), "rows")
        found = _spans_by_row(rows, blocks, shard_bytes, scratch).filter(F.size("spans") > 0)
        if found.isEmpty():
            return rows.drop("text", "row").toDF(*names)
        spans = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        rows = _cut_spans(rows.join(spans, "row", "left").drop("text", "row"), names).toDF(*names)


def _cut_spans(rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns ``names`` of rows with these columns and ``spans``, word ranges to cut."""
    plain = rows.drop("spans")
    columns = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            own = batch.select(columns)
            hit = [k for k, x in enumerate(spans) if x]

            def cut(k: int, text: str) -> str:
                words = words_of(pa.array([text], pa.string()), ALNUM)
                a, b = (np.array([x[c] for x in spans[k]], np.int64) for c in "ab")
                return cut_words(text, words, hit_words(a, b - a, len(words.hashes)))

            yield _with_texts(own, names, hit, cut)

    return map_batches(rows, run, plain.schema)


def _with_texts(rows: pa.RecordBatch, names: list[str], hit: list[int], cut: Callable[[int, str], str]) -> pa.RecordBatch:
    """Rows (their columns called ``names``) whose texts at ``hit`` are cut, and counted anew; those that lose their last word go."""
    if not hit:
        return rows
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    texts, keep = rows.column(at_text).to_pylist(), np.ones(rows.num_rows, bool)
    chars = rows.column(at_chars).to_pylist() if at_chars is not None else None
    for k in hit:
        texts[k] = cut(k, texts[k])
        keep[k] = bool(len(words_of(pa.array([texts[k]], pa.string()), ALNUM).hashes))
        if chars is not None:
            chars[k] = len(texts[k])
    columns = list(rows.columns)
    columns[at_text] = pa.array(texts, rows.column(at_text).type)
    if chars is not None:
        columns[at_chars] = pa.array(chars, rows.column(at_chars).type)
    return pa.RecordBatch.from_arrays(columns, schema=rows.schema).filter(pa.array(keep))


def _cut(docs: DataFrame, shared: Broadcast, shard_bytes: int) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, first in _shards(batches, shard_bytes):
            _, at, _ = occurrences(shared.value, hashes, first)
            hit = np.unique(np.searchsorted(first, at, side="right") - 1).tolist()
            yield _with_texts(rows, names, hit, lambda _, text: cut_windows(text, shared.value))

    return map_batches(docs, run, docs.schema)
