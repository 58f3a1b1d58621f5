"""Language identification by words first, then by ever shorter character n-grams.

A known word has its log frequency in each language. An unseen word falls back to its character n-grams of the
longest order of which any is known, with a discount for each order it falls. A text's score for a language is the
mean over its words; the model is fitted on a bounded sample of labelled texts and keeps every word and n-gram of it.

Words are runs of letters, lower-cased letter by letter. Texts are read as arrays of code points, words and n-grams as
64-bit hashes, a slice of texts at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_offsets, filled, map_batches, slices, split_mix, text_bytes
from .wordhash import BASE, run_hashes

#: Labelled texts of each language that the model is fitted on, about.
SAMPLE_PER_LANGUAGE = 1500
ORDERS, DISCOUNT, SMOOTH = (4, 3, 2, 1), 0.8, 0.5
#: A text's evidence counts as that of so many words at most, so that a mixed text doesn't look sure.
EVIDENCE_WORDS = 30
UNKNOWN = "und"
_SPACE = np.uint32(32)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its lower case where that is one code point."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        if len(x := chr(c).lower()) == 1:
            lower[c] = ord(x)
    return letter, lower


@dataclass
class LetterRuns:
    """Lower-cased code points of texts, end to end, the runs of letters in them, and each run's text."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def letter_runs(texts: pa.Array) -> LetterRuns:
    """texts: strings without nulls."""
    letter, lower = _letters()
    data, at = text_bytes(texts), byte_offsets(texts)
    points = lower[np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)]
    if len(points) < len(data):
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])[at]
    n = len(points)
    if not n:
        none = np.zeros(0, np.int64)
        return LetterRuns(points, none, none, none)
    inside = letter[points]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return LetterRuns(points, starts, np.flatnonzero(closes) + 1, np.searchsorted(at, starts, side="right") - 1)


def gram_hashes(runs: LetterRuns, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the words ``which``, each with a space before and behind, and the place of each one's word in ``which``."""
    starts, sizes = runs.starts[which], runs.ends[which] - runs.starts[which]
    # the grams of " word " that aren't a space alone
    count, skip = np.maximum(sizes + 3 - n, 0) if n > 1 else sizes, 0 if n > 1 else 1
    owner = np.repeat(np.arange(len(which)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + skip - 1  # in the word; -1: the space before it
    start, size = starts[owner], sizes[owner]
    out = np.full(len(owner), n, np.uint64)
    for _ in range(n):
        inside = (at >= 0) & (at < size)
        point = np.where(inside, runs.points[np.where(inside, start + at, 0)], _SPACE)
        out = out * np.uint64(BASE) + point.astype(np.uint64) + np.uint64(1)
        at = at + 1
    return split_mix(out), owner


def _mixed(h: int) -> int:
    return int(split_mix(np.array([h % (1 << 64)], np.uint64))[0])


def gram_code(gram: str) -> int:
    """The hash of one n-gram; the plain form of ``gram_hashes``."""
    h = len(gram)
    for c in gram:
        h = h * BASE + ord(c) + 1
    return _mixed(h)


def word_code(word: str) -> int:
    """The hash of one word; the plain form of ``run_hashes``."""
    return _mixed(len(word) + sum((ord(c) + 1) * pow(BASE, k, 1 << 64) for k, c in enumerate(word)))


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [g for k in range(len(padded) - n + 1) if (g := padded[k : k + n]).strip()]


@dataclass
class Table:
    """Sorted hashes of words or n-grams, and the log frequencies of each in each language."""

    hashes: np.ndarray
    values: np.ndarray

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash; -1 for none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


@dataclass
class LanguageModel:
    """``tables[n]``: known words (n = 0) and n-grams; ``fallback``: the language of texts of which nothing is known."""

    languages: list[str]
    tables: dict[int, Table]
    fallback: int = 0

    def vector(self, word: str) -> np.ndarray | None:
        """What a lower-cased word says; None if nothing of it is known. The plain form of ``vectors``."""
        for fallen, n in enumerate((0, *ORDERS)):
            codes = [gram_code(g) for g in grams(word, n)] if n else [word_code(word)]
            rows = self.tables[n].rows(np.array(codes, np.uint64))
            if (rows >= 0).any():
                return self.tables[n].values[rows[rows >= 0]].mean(axis=0, dtype=np.float64) * DISCOUNT**fallen
        return None

    def vectors(self, runs: LetterRuns, which: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row for each of the words ``which``, and whether anything of it is known."""
        out, known = np.zeros((len(which), len(self.languages))), np.zeros(len(which), bool)
        left = np.arange(len(which))
        for fallen, n in enumerate((0, *ORDERS)):
            table = self.tables[n]
            found, owner = gram_hashes(runs, which[left], n) if n else (hashes, left)
            rows = table.rows(found)
            rows, owner = rows[rows >= 0], owner[rows >= 0]
            times = np.bincount(owner, minlength=len(left))
            hit = times > 0
            at = left[hit]
            for k in range(out.shape[1]):
                out[at, k] = np.bincount(owner, table.values[rows, k], len(left))[hit] / times[hit] * DISCOUNT**fallen
            known[at] = True
            left = left[~hit]
            if not len(left):
                break
        return out, known


def fit(docs: DataFrame, *, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from rows of ``docs`` (``doc_id, text, lang``); rows without text or lang teach nothing.

    The sample of a language is about ``sample_per_language`` texts, chosen by a hash of the doc_id. Counts are summed up
    in Spark; the tables of the sample come to the driver as numbers.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], {n: Table(np.zeros(0, np.uint64), np.zeros((0, 0))) for n in (0, *ORDERS)})
    languages = sorted(sizes)
    number = F.lit(-1)
    share = F.lit(0.0)
    for k, name in enumerate(languages):
        number = F.when(F.col("lang") == name, k).otherwise(number)
        share = F.when(F.col("lang") == name, min(1.0, sample_per_language / sizes[name])).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).select("text", number.alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = filled(batch.column("text")), batch.column("lang").to_numpy()
            for a, b in slices(texts):
                runs = letter_runs(texts.slice(a, b - a))
                hashes, of = run_hashes(runs.points, runs.starts, runs.ends), langs[a:b][runs.text]
                for lang in np.unique(of).tolist():
                    mine = np.flatnonzero(of == lang)
                    words, first, times = np.unique(hashes[mine], return_index=True, return_counts=True)
                    found = [(0, words, times)]
                    for n in ORDERS:
                        codes, owner = gram_hashes(runs, mine[first], n)
                        codes, at = np.unique(codes, return_inverse=True)
                        found.append((n, codes, np.bincount(at, times[owner], len(codes)).astype(np.int64)))
                    n, codes, times = (np.concatenate(x) for x in zip(*((np.full(len(c), n, np.int32), c, t) for n, c, t in found), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), lang, np.int32)), pa.array(n), pa.array(codes.view(np.int64)), pa.array(times)], ["lang", "n", "gram", "count"])

    counts = map_batches(sample, count, "lang int, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    kept = counts.toArrow()  # bounded by the sample, as numbers
    lang, order, gram, times = (kept.column(c).to_numpy() for c in ("lang", "n", "gram", "count"))
    tables = {}
    for n in (0, *ORDERS):
        mine = order == n
        hashes, at = np.unique(gram[mine].astype(np.int64).view(np.uint64), return_inverse=True)
        own = np.bincount(at * len(languages) + lang[mine], times[mine], len(hashes) * len(languages)).reshape(-1, len(languages))
        tables[n] = Table(hashes, np.log((own + SMOOTH) / (own.sum(0) + SMOOTH * (len(hashes) + 1))).astype(np.float32))
    return LanguageModel(languages, tables, max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k)))


def score_text(model: LanguageModel, text: str) -> tuple[str, float]:
    """Language and score of one text, word by word; the plain form of what ``predict`` does by slices."""
    lower = _letters()[1]
    words = "".join(chr(lower[ord(c)]) if c.isalpha() else " " for c in text).split()
    if not words or not model.languages:
        return UNKNOWN, 0.0
    vectors = [v for w in words if (v := model.vector(w)) is not None]
    if not vectors:
        return model.languages[model.fallback], 1 / len(model.languages)
    x = np.sum(vectors, axis=0) / len(vectors) * min(len(vectors), EVIDENCE_WORDS)
    best = int(np.argmax(x))  # the first in alphabetical order of equals
    return model.languages[best], float(1 / np.exp(x - x[best]).sum())


def _scored(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's language (-1: unknown) and its score."""
    runs, n = letter_runs(texts), len(texts)
    if not model.languages:
        return np.full(n, -1), np.zeros(n)
    hashes, first, at = np.unique(run_hashes(runs.points, runs.starts, runs.ends), return_index=True, return_inverse=True)
    vectors, known = model.vectors(runs, first, hashes)
    words = np.bincount(runs.text, minlength=n)
    n_known = np.bincount(runs.text, known[at], n)
    sums = np.stack([np.bincount(runs.text, vectors[at, k], n) for k in range(vectors.shape[1])], 1)
    x = sums * (np.minimum(n_known, EVIDENCE_WORDS) / np.maximum(n_known, 1))[:, None]
    best = np.argmax(x, axis=1)
    score = 1 / np.exp(x - x[np.arange(n), best][:, None]).sum(1)
    best = np.where(n_known > 0, best, model.fallback)
    return np.where(words > 0, best, -1), np.where(words > 0, score, 0.0)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs`` (``doc_id, text``), from its whole text.

    ``und`` with score 0 for a null text or one without a letter (or for any text, if nothing was learned). A text of
    which no word or n-gram is known gets the commonest language at the score of a guess. Repeated rows and null
    doc_ids are scored like any other row; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*shared.value.languages, UNKNOWN], pa.string())
        for batch in batches:
            texts = filled(batch.column("text"))
            for a, b in slices(texts):
                best, score = _scored(shared.value, texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.4) -> DataFrame:
    """Rows of ``docs`` whose language is known with at least ``min_score``; all columns stay as they are.

    Texts that ``predict`` calls ``und`` go: null ones, and ones without a letter. Null doc_ids, repeated rows and other
    columns make no difference; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(at_text))
            for a, b in slices(texts):
                best, score = _scored(shared.value, texts.slice(a, b - a))
                yield batch.slice(a, b - a).filter(pa.array((best >= 0) & (score >= min_score)))

    return map_batches(docs, run, docs.schema)
