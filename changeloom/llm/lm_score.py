"""Cross-entropy difference of two matched bigram models, for choosing documents like a target.

Both models share one vocabulary, every word of the counted documents, so no token of theirs is unknown. Words are
counted over all documents; the background's counts are scaled to the target's number of tokens, so both are smoothed
alike. A document's score is the mean over its tokens of the target's loss less the background's, in nats: the lower,
the more it is like the target.

The tables grow with the corpus and are never in one place. Counts are dealt out by hash: a document's distinct bigrams
go, with their number, to the bucket of their word, where the counts of the whole corpus come together and each
bigram's loss is added up by document; a document's partial sums are added at the end. A word with over 1 / ``SHARES``
of the tokens is common: fewer than ``SHARES`` words are, so their counts are broadcast, and their bigrams are dealt
out by both words, so that no bucket holds all of a common word. That changes where a bigram is counted, not its loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast, filled, map_batches, partitions, slices, split_mix
from .wordhash import ALNUM, words_of

#: Weight of the unigram in a bigram's probability, in counts, and what is added to each unigram count.
BACKOFF, ADDED = 50.0, 0.5
SHARES = 65_535
#: Buckets at least, and tokens of a bucket; counts of words and documents that a task holds before it passes them on.
BUCKETS, BUCKET_TOKENS, HELD = 256, 1 << 20, 1 << 20
#: What a row holds: documents of a slice, bigrams of two common words, and other bigrams.
DOCS, COMMON, OTHER = 0, 1, 2

WORDS = "word long, n_target long, n_background long, end_target long, end_background long"
DEALT = "bucket int, slice long, size int, kind int, key binary, word binary, row binary, n binary"
SCORED = "doc_id long, n_tokens long, ce_target double, ce_background double, score double"


@dataclass
class Common:
    """Common words: sorted hashes, and counts by model of each and of the start (the last row); corpus figures."""

    words: np.ndarray
    single: np.ndarray
    context: np.ndarray
    scale: np.ndarray
    total: np.ndarray
    vocabulary: int
    same: bool

    def back(self, single: np.ndarray) -> np.ndarray:
        """Probabilities of words by their counts, a column for each model."""
        return (single * self.scale + ADDED) / (self.total * self.scale + ADDED * self.vocabulary)

    def context_loss(self, context: np.ndarray) -> np.ndarray:
        return np.log(context * self.scale + BACKOFF)

    def models(self, n: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """``n`` in the column of its model; twice where only one kind of documents is there."""
        own = np.stack([n * (kind == 1), n * (kind == 0)], 1).astype(np.float64)
        return np.repeat(own.sum(1, keepdims=True), 2, 1) if self.same else own


def _sum_by(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(groups, values[:, m], n) for m in (0, 1)], 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word of ``docs`` (``text, is_target``) occurs, and how often as a text's last, by model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            rows = np.concatenate([c for _, c in held])
            return words, np.stack([np.bincount(at, rows[:, k], len(words)) for k in range(4)], 1).astype(np.int64)

        def batch_of(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(4))], [c.split()[0] for c in WORDS.split(", ")])

        for batch in batches:
            texts, target = filled(batch.column("text")), batch.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(texts):
                own = words_of(texts.slice(a, b - a), ALNUM)
                n = np.diff(own.first)
                words, at = np.unique(own.hashes, return_inverse=True)
                mine, last, of = np.repeat(target[a:b], n), at[own.first[1:][n > 0] - 1], target[a:b][n > 0]
                held.append((words, np.stack([np.bincount(x, minlength=len(words)) for x in (at[mine], at[~mine], last[of], last[~of])], 1)))
                if len(held) > 1 and sum(len(w) for w, _ in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield batch_of(*held.pop())
        if held:
            yield batch_of(*merged())

    counts = map_batches(docs.select("text", "is_target").filter("is_target IS NOT NULL"), run, WORDS)
    return counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in counts.columns[1:]))


def common_words(words: DataFrame, shares: int = SHARES) -> Common:
    sums = words.agg(F.count(F.lit(1)).alias("words"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in words.columns[1:])).first()
    rows = words.filter((F.col("n_target") + F.col("n_background")) * shares > sums.n_target + sums.n_background).collect()  # under ``shares`` rows
    found = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 5)
    hashes = np.ascontiguousarray(found[:, 0]).view(np.uint64)
    found, hashes = found[np.argsort(hashes)], np.sort(hashes)
    # the start of texts is never a word, and is the context of as many as there are ends
    single = np.concatenate([found[:, 1:3], [[0, 0]]]).astype(np.float64)
    context = np.concatenate([found[:, 1:3] - found[:, 3:5], [[sums.end_target, sums.end_background]]]).astype(np.float64)
    total = np.array([sums.n_target, sums.n_background], np.float64)
    same = not total.all()
    if same:
        single, context, total = (np.repeat(x.sum(-1, keepdims=True), 2, -1) for x in (single, context, total))
    scale = np.array([1.0, 1.0 if same else total[0] / total[1]])
    return Common(hashes, single, context, scale, total, sums.words + 1, same)


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct combination first is, in the order of the keys, and how often it is there."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _deal(texts: pa.Array, ids: pa.Array, kinds: np.ndarray, number: int, own: Common, context_loss: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A slice's documents, and its bigrams by bucket. A last word that isn't common is there with key 0, too."""
    words = words_of(texts, ALNUM)
    n, start, size = np.diff(words.first), len(own.words), len(texts)
    row, now = np.repeat(np.arange(size), n), words.hashes
    at = np.searchsorted(own.words, now)
    at = np.where(own.words[np.minimum(at, start - 1)] == now, at, -1) if start else np.full(len(now), -1)
    heads = words.first[:-1][n > 0]
    before, before_at = np.zeros_like(now), np.full(len(now), -1)
    before[1:], before_at[1:] = now[:-1], at[:-1]
    before[heads], before_at[heads] = 0, start
    known = before_at >= 0
    base = _sum_by(row[known], context_loss[before_at[known]], size)
    out = [(number % buckets, DOCS, ids.fill_null(0).to_numpy().tobytes(), base.tobytes(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), n.astype(np.int64).tobytes())]

    def by_bucket(kind: int, bucket: np.ndarray, key: np.ndarray, word: np.ndarray | None, rows: np.ndarray, count: np.ndarray) -> None:
        order = np.lexsort((word if word is not None else key, bucket))
        bucket, key, rows = bucket[order], key[order], rows[order].astype(np.uint16 if size <= 1 << 16 else np.uint32)
        word = None if word is None else word[order]
        count = ((count[order] << 2) | kinds[rows]).astype(np.uint32)
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out.append((int(bucket[a]), kind, key[a:b].tobytes(), b"" if word is None else word[a:b].tobytes(), rows[a:b].tobytes(), count[a:b].tobytes()))

    both = known & (at >= 0)
    key, rows = ((before_at[both].astype(np.uint32) << np.uint32(16)) | at[both].astype(np.uint32)), row[both]
    first, count = _distinct((rows.astype(np.uint64) << np.uint64(32)) | key)
    key, rows = key[first], rows[first]
    by_bucket(COMMON, (split_mix(key) % np.uint64(buckets)).astype(np.int64), key, None, rows, count)

    last = words.first[1:][n > 0] - 1
    last = last[at[last] < 0]
    key = np.maximum(split_mix(split_mix(before[~both]) + now[~both]), np.uint64(1))
    key, word, rows = np.concatenate([key, np.zeros(len(last), np.uint64)]), np.concatenate([now[~both], now[last]]), np.concatenate([row[~both], row[last]])
    common = np.concatenate([at[~both] >= 0, np.zeros(len(last), bool)])
    first, count = _distinct(rows, key)
    key, word, rows = key[first], word[first], rows[first]
    by_bucket(OTHER, (np.where(common[first], key, word) % np.uint64(buckets)).astype(np.int64), key, word, rows, count)

    bucket, kind, *blobs = zip(*out, strict=True)
    k = len(out)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([number] * k, pa.int64()), pa.array([size] * k, pa.int32()), pa.array(kind, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], [c.split()[0] for c in DEALT.split(", ")])


def _losses(own: Common, kind: int, key: np.ndarray, word: np.ndarray, n: np.ndarray, model: np.ndarray) -> np.ndarray:
    """What each entry of a bucket adds to its document's losses; all entries with its key or rarer word are here."""
    counted, times = own.models(n, model), n[:, None]
    keys, at = np.unique(key, return_inverse=True)
    pairs = _sum_by(at, counted, len(keys)) * own.scale
    if kind == COMMON:
        return -times * np.log(pairs + BACKOFF * own.back(own.single[(keys & np.uint32(0xFFFF)).astype(np.int64)]))[at]
    words, of = np.unique(word, return_inverse=True)
    follows = key != 0
    single = _sum_by(of[follows], counted[follows], len(words))
    context = own.context_loss(single - _sum_by(of[~follows], counted[~follows], len(words)))
    if len(own.words):
        place = np.minimum(np.searchsorted(own.words, words), len(own.words) - 1)
        common = own.words[place] == words
        single[common] = own.single[place[common]]
        context[common] = 0.0  # added where the text was read
    found = -np.log(pairs[at] + BACKOFF * own.back(single)[of]) + context[of]
    return times * np.where(follows[:, None], found, -context[of])


def score_corpus(docs: DataFrame, *, shares: int = SHARES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """``doc_id, n_tokens, ce_target, ce_background, score`` for every row of ``docs`` (``doc_id, text, is_target``).

    The models are those of all rows that are the target's, and of all that are not; a row whose ``is_target`` is null
    is in neither, but is scored. A text without words scores 0, and so do all if a model would be empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "is_target")
    scratch = Scratch(spark)
    common = common_words(scratch.write(word_counts(docs), "words"), shares)
    scratch.drop("words")
    buckets = max(BUCKETS, 1 << max(0, int(common.total.sum()) // bucket_tokens).bit_length())
    shared = spark.sparkContext.broadcast(common)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = shared.value, TaskContext.get().partitionId() << 32
        context_loss = own.context_loss(own.context)
        for batch in batches:
            texts = filled(batch.column("text"))
            kinds = batch.column("is_target").cast(pa.int8()).fill_null(2).to_numpy().astype(np.int64)
            for a, b in slices(texts):
                yield _deal(texts.slice(a, b - a), batch.column("doc_id").slice(a, b - a), kinds[a:b], number, own, context_loss, buckets)
                number += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums: dict[int, np.ndarray] = {}
        bucket, held = (-1, -1), []

        def close() -> None:
            key = np.concatenate([np.frombuffer(k, np.uint32 if bucket[1] == COMMON else np.uint64) for _, _, k, _, _, _ in held])
            word = np.concatenate([np.frombuffer(w, np.uint64) for _, _, _, w, _, _ in held])
            n = np.concatenate([np.frombuffer(c, np.uint32) for *_, c in held]).astype(np.int64)
            found, at = _losses(own, bucket[1], key, word, n >> 2, n & 3), 0
            for number, size, _, _, row, c in held:
                m = len(c) // 4
                rows = np.frombuffer(row, np.uint16 if len(row) == 2 * m else np.uint32)
                if number not in sums:
                    sums[number] = np.zeros((size, 2))
                sums[number] += _sum_by(rows, found[at : at + m], size)
                at += m
            held.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            number, kind, key, word, row, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(kind, pa.int32()), *(pa.array(x, pa.binary()) for x in (key, word, row, n))], ["slice", "kind", "key", "word", "row", "n"])

        def partial() -> Iterator[pa.RecordBatch]:
            if sums:
                yield batch_of([(number, OTHER, None, s.tobytes(), None, None) for number, s in sums.items()])
            sums.clear()

        for batch in batches:
            for b, number, size, kind, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == DOCS:
                    yield batch_of([(number, kind, *blobs)])
                    continue
                if held and bucket != (b, kind):
                    close()
                    if sum(map(len, sums.values())) > HELD:
                        yield from partial()
                bucket = b, kind
                held.append((number, size, *blobs))
        if held:
            close()
        yield from partial()

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        head = next(r for r in rows if r["kind"] == DOCS)
        n = np.frombuffer(head["n"], np.int64)
        means = sum(np.frombuffer(r["word"], np.float64) for r in rows).reshape(-1, 2) / np.maximum(n, 1)[:, None]
        ids = pa.array(np.frombuffer(head["key"], np.int64), mask=np.frombuffer(head["row"], np.uint8).astype(bool))
        columns = [ids, pa.array(n), *(pa.array(np.ascontiguousarray(x)) for x in (means[:, 0], means[:, 1], means[:, 0] - means[:, 1]))]
        return pa.table(columns, names=[c.split()[0] for c in SCORED.split(", ")])

    tasks = min(buckets, partitions(spark))
    dealt = map_batches(docs, deal, DEALT).repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket", "kind")
    parts = map_batches(dealt, count, "slice long, kind int, key binary, word binary, row binary, n binary")
    return parts.groupBy("slice").applyInArrow(add, SCORED)


def with_target(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, text, is_target``: whether the doc_id is among ``target``'s (null ones are not)."""
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("is_target", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.join(bounded_broadcast(ids, ids.count()), "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
