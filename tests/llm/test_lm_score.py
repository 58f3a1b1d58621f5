import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from changeloom.llm import lm_score as M
from changeloom.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs):
    """Of (doc_id, text, is_target), with a symbol for every word."""
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, _ in docs]
    vocabulary = 1 + len({w for own, d in zip(words, docs) if d[2] is not None for w in own})
    models = [Counter(p for own, d in zip(words, docs) if d[2] is side for p in zip(["", *own], own)) for side in (True, False)]
    n = [sum(m.values()) for m in models]
    tables = []
    for m, scale in zip(models, (1.0, n[0] / n[1])):
        after, before = Counter(), Counter()
        for (a, b), c in m.items():
            after[b] += c * scale
            before[a] += c * scale
        total = sum(after.values()) + M.ADDED * vocabulary
        tables.append(lambda a, b, m=m, s=scale, u=after, f=before, t=total: -math.log((m[a, b] * s + M.BACKOFF * (u[b] + M.ADDED) / t) / (f[a] + M.BACKOFF)))
    return [(d[0], len(own), *(sum(t(*p) for p in zip(["", *own], own)) / max(1, len(own)) for t in tables)) for own, d in zip(words, docs)]


@pytest.mark.parametrize("shares", [1, 50, 65_535])
def test_all_words_have_counts_of_their_own(spark, shares):
    """Whichever words count as common."""
    rng = random.Random(6)
    text = lambda base: " ".join(f"{base}{int(rng.paretovariate(0.4)) % 9000}" for _ in range(rng.randrange(1, 300)))
    docs = [(k, text("a" if k % 3 else "B, b"), k % 3 == 0) for k in range(60)]
    docs += [(60, None, False), (61, "", True), (3, "a1 a2", True), (None, "a1 é a2", False), (62, "a1 " * 9000, False), (63, "a1 unheard words a2", None), (64, "single", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, is_target boolean").repartition(3)
    got = sorted(M.score_corpus(df, shares=shares).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    want = sorted(plain(docs), key=lambda r: (str(r[0]), r[1]))
    assert [(r.doc_id, r.n_tokens) for r in got] == [w[:2] for w in want]
    for r, w in zip(got, want, strict=True):
        assert (r.ce_target, r.ce_background) == (pytest.approx(w[2], abs=1e-9), pytest.approx(w[3], abs=1e-9))
        assert r.score == pytest.approx(r.ce_target - r.ce_background)


def test_rare_words_are_told_apart(spark):
    """Texts whose words are all rare: a rare word of the target lowers its document's score only, at any vocabulary."""
    docs = [(k, " ".join(f"w{k * 40 + j}" for j in range(40)), k % 2 == 0) for k in range(100)]
    scores = {r.doc_id: r.score for r in M.score_corpus(spark.createDataFrame(docs, "doc_id long, text string, is_target boolean")).collect()}
    assert max(s for k, s in scores.items() if k % 2 == 0) < 0 < min(s for k, s in scores.items() if k % 2)
    assert max(scores.values()) - min(scores.values()) == pytest.approx(2 * scores[1])


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b c", False), (2, None, False)], "doc_id long, text string, is_target boolean")
    assert sorted((r.doc_id, r.n_tokens, r.score) for r in M.score_corpus(df).collect()) == [(1, 3, 0.0), (2, 0, 0.0)]
    assert M.score_corpus(df.limit(0)).count() == 0


def test_target_by_doc_id(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7)], "doc_id long, text string, is_target int")
    marked = M.with_target(df, spark.createDataFrame([(2,), (2,), (None,)], "doc_id long"))
    assert sorted(map(tuple, marked.collect()), key=str) == [(1, "a", False), (2, "b", True), (None, "c", False)]


@pytest.mark.parametrize("background, least", [("all others", 0.78), ("quality 0", 0.74)])
def test_unseen_labels_are_ranked(spark, background, least):
    """Of documents whose label no model was told, those of the target's kind score lower; with "quality 0", no model has seen them either."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    told = labels.filter("doc_id % 2 = 0")
    marked = M.with_target(docs, told.filter("quality = 1"))
    if background == "quality 0":
        other = told.filter("quality = 0").select("doc_id", F.lit(True).alias("other"))
        marked = marked.join(other, "doc_id", "left").withColumn("is_target", F.when(F.col("is_target") | F.col("other"), F.col("is_target")))
    scores = {r.doc_id: r.score for r in M.score_corpus(marked).collect()}
    rest = [(scores[r.doc_id], r.quality) for r in labels.filter("doc_id % 2 = 1").collect()]
    good, bad = ([s for s, q in rest if q == k] for k in (1, 0))
    auc = np.mean([np.mean(np.array(good) < b) for b in bad])
    assert auc > least, auc
