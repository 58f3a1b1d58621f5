"""Toxicity from a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, strips marks, maps look-alike letters and digits that stand for letters, and drops zero-width
characters; ``l``, ``1`` and ``i`` are one letter. Lexicon entries are words, or word beginnings (with a final ``*``);
matches inside an exception phrase don't count. The weights found are summed, once as they are and once over the
length of the text, and a logistic curve makes the score of both.

All is learned from a bounded sample of labelled texts: the lexicon from what toxic texts have and others lack, and the
exceptions, pairs of words of which one is an entry, from what other texts have and toxic ones lack.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast, map_batches, texts_of

#: Labelled texts that are learned from at most.
SAMPLE = 20_000
#: An entry's least documents, and its least log ratio of toxic to other documents; an exception's greatest share of toxic ones.
LEAST_DOCS, LEAST_RATIO, EXCEPTION_SHARE = 3, 2.5, 0.1
STEMS = (4, 5, 6, 7)
#: What a text still counts for the next entry, for each entry already chosen in it.
DECAY = 0.7

# Letters of other scripts that look like Latin ones, and characters that stand for letters.
_LOOK_ALIKE = dict(zip("аеорсухіјѕһԁԛԝвнкмтгαβγδεηικνορτυχωℓ∂", "aeopcyxijshdqwbhkmtrabydenikvoptuxwld", strict=True))
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i", "|": "i"}
_NO_WIDTH = "­​‌‍⁠﻿"


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D7FF)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if plain and plain != chr(code):
            out[code] = "".join(_STANDS_FOR.get(c, c) for c in plain)
    out |= {c: None for c in range(0x300, 0x370)} | {ord(c): None for c in _NO_WIDTH}
    return out | {ord(a): _STANDS_FOR.get(b, b) for a, b in (_LOOK_ALIKE | _STANDS_FOR).items()}


_FOLD = _table()
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def terms(folded: str) -> set[str]:
    """Words of a folded text and their beginnings."""
    words = set(_WORD.findall(folded))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


@dataclass
class ToxicityModel:
    """``lexicon``: weight of each folded entry; ``curve``: intercept and slopes for the sum and the density."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)


class Matcher:
    def __init__(self, model: ToxicityModel):
        import ahocorasick

        self.model, self.automaton, found = model, ahocorasick.Automaton(), {}
        for entry, weight in model.lexicon.items():
            found.setdefault(entry.rstrip("*"), []).append((entry.endswith("*"), weight))
        for phrase in model.exceptions:
            found.setdefault(fold(phrase), []).append((False, None))
        for text, kinds in found.items():
            self.automaton.add_word(text, (len(text), kinds))
        if found:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Where words with an entry begin that no exception covers, and the weight of each one's heaviest entry."""
        hits, safe = [], []
        if len(self.automaton):
            for end, (n, kinds) in self.automaton.iter(folded):
                start = end - n + 1
                if start and (folded[start - 1].isalnum()):
                    continue
                closed = end + 1 == len(folded) or not folded[end + 1].isalnum()
                for begins, weight in kinds:
                    if weight is None:
                        if closed:
                            safe.append((start, end))
                    elif begins != closed:  # a beginning has more behind it
                        hits.append((start, end, weight))
        best: dict[int, float] = {}
        for start, end, weight in hits:
            if not any(a <= start and end <= b for a, b in safe):
                best[start] = max(best.get(start, 0.0), weight)
        return best

    def features(self, text: str) -> tuple[float, float]:
        """Sum of the weights found, one a word, and that sum over the words of the text."""
        folded = fold(text)
        total = sum(self.hits(folded).values())
        return total, total / max(1, len(_WORD.findall(folded))) if total else 0.0

    def pairs(self, text: str) -> set[str]:
        """Words with an entry together with the word before or behind, where a single space is between."""
        folded = fold(text)
        if not (hits := self.hits(folded)):
            return set()
        words, out = [m.span() for m in _WORD.finditer(folded)], set()
        for (a, b), (c, d) in zip(words, words[1:], strict=False):
            if (a in hits or c in hits) and folded[b:c] == " ":
                out.add(folded[a:d])
        return out

    def score(self, text: str) -> float:
        a, b, c = self.model.curve
        total, density = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(total) + c * math.log1p(100 * density)))))


def choose_entries(candidates: dict[str, float], toxic: list[list[str]], least: float) -> list[str]:
    """Entries that explain toxic texts which others don't yet.

    Each text counts less for each entry already chosen in it, so what merely stands beside known entries in
    many copies of a text is left out. Of equals, words go before beginnings, and longer before shorter.
    """
    inside: dict[str, list[int]] = {}
    for k, own in enumerate(toxic):
        for t in own:
            if t in candidates:
                inside.setdefault(t, []).append(k)
    weight, out = [1.0] * len(toxic), []

    def turn(t: str) -> tuple[float, bool, int, str]:
        return -round(sum(weight[k] for k in inside[t]) * candidates[t], 6), t.endswith("*"), -len(t), t

    heap = [turn(t) for t in inside]
    heapq.heapify(heap)
    while heap:
        before = heapq.heappop(heap)
        t = before[-1]
        if sum(weight[k] for k in inside[t]) < least:
            continue
        if (now := turn(t)) != before:  # gains only fall, so an old one is a bound
            heapq.heappush(heap, now)
            continue
        out.append(t)
        for k in inside[t]:
            weight[k] *= DECAY
    return out


def fit_curve(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[float, float, float]:
    """Logistic regression on log(1 + sum) and log(1 + 100 density) by damped Newton steps."""
    x = np.stack([np.ones(len(features)), np.log1p(features[:, 0]), np.log1p(100 * features[:, 1])], 1)
    w = np.array([-2.0, 1.0, 0.5])
    penalty = np.diag([1e-4, ridge, ridge]) * len(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - labels) + penalty @ w)
        w -= np.clip(step, -1, 1)
        if abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, exceptions: Sequence[str] = ()) -> ToxicityModel:
    """Learn from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``); null texts and labels teach nothing.

    Of more than ``sample`` labelled doc_ids, those with the least hashes are used, about. A doc_id with several labels
    counts as toxic if any is. Equal texts count once. Without a toxic or without another text every score is 0.02, so
    too for empty tables. ``exceptions`` are phrases to hold beside those that are learned.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(min(1.0, sample / max(1, n)) * 1_000_003)) if n > sample else marks
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").join(bounded_broadcast(chosen, 2 * sample), "doc_id")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")

    def counted(found: dict[int, Counter]) -> pa.RecordBatch:
        keys = list(found[0] | found[1])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([found[k][x] for x in keys], pa.int64()) for k in (1, 0))], ["term", "toxic", "other"])

    def summed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
        found = map_batches(rows, run, "term string, toxic long, other long")
        return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, mark in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                found[int(mark == 1)].update(terms(fold(text)))
            yield counted(found)

    sizes = {r.toxic: r.n for r in rows.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_other:
        return ToxicityModel({}, tuple(exceptions))
    ratio = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    best = summed(count).withColumn("ratio", ratio).filter((F.col("toxic") >= LEAST_DOCS) & (F.col("ratio") >= LEAST_RATIO))
    candidates = {r.term: r.ratio for r in best.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(t for t in terms(fold(x)) if t in shared.value) for x in texts_of(batch.column("text"))], pa.list_(pa.string()))], ["terms"])

    toxic = [r.terms for r in map_batches(rows.filter("toxic = 1").select("text"), listed, "terms array<string>").collect()]  # of the sample
    lexicon = {t: float(candidates[t]) for t in choose_entries(candidates, toxic, max(2.0, 0.003 * n_toxic))}
    shared.destroy()
    bare = docs.sparkSession.sparkContext.broadcast(ToxicityModel(lexicon, tuple(exceptions)))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(bare.value)
        for batch in batches:
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, mark in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                found[int(mark == 1)].update(matcher.pairs(text))
            yield counted(found)

    learned = summed(paired).filter((F.col("other") >= LEAST_DOCS) & (F.col("toxic") <= EXCEPTION_SHARE * (F.col("toxic") + F.col("other"))))
    model = ToxicityModel(lexicon, (*exceptions, *sorted(r.term for r in learned.select("term").collect())))  # of the sample
    bare.destroy()
    weighed = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weighed.value)
        for batch in batches:
            found = [matcher.features(x) for x in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.float64()), pa.array([int(x == 1) for x in batch.column("toxic").to_pylist()], pa.int64())], ["total", "density", "toxic"])

    points = map_batches(rows, measured, "total double, density double, toxic long").toArrow()  # a row for each text of the sample
    points = np.stack([points.column(c).to_numpy() for c in ("total", "density", "toxic")], 1).astype(np.float64)
    model.curve = fit_curve(points[:, :2], points[:, 2])
    weighed.destroy()
    scratch.drop()
    return model


def predict(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs`` (``doc_id, text``), from its whole text.

    Null and empty texts have the score of a text without any match. Repeated rows and null doc_ids are scored like
    any other row; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            scores = np.array([matcher.score(t) for t in texts_of(batch.column("text"))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``limit``; all columns stay as they are.

    Null and empty texts are kept, as are null doc_ids and repeated rows; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([matcher.score(t) < limit for t in texts_of(batch.column(at_text))], pa.bool_()))

    return map_batches(docs, run, docs.schema)
