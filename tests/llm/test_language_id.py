import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from changeloom.llm import language_id as L
from changeloom.llm import wordhash
from changeloom.llm.common import crc32_mod, table
from changeloom.llm.queries import op5_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_plain_form(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in op5_language_id(spark, SF).collect()}
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    held = [r for r in rows.values() if r.held_out]
    assert len(rows) == len(truth) and held
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)
    model = L.fit(docs.filter(crc32_mod("doc_id", 4) != 2))
    for r in list(rows.values())[:150]:
        lang, score = L.score_text(model, truth[r.doc_id][1])
        assert r.lang_pred == lang and r.score == pytest.approx(score)


def test_cases(spark):
    train = [(k, t, l, "x") for k, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chien et le chat", "fr"), (None, "es"), ("perro", None)] * 3)]
    model = L.fit(spark.createDataFrame(train, "doc_id long, text string, lang string, score string"))
    assert model.languages == ["de", "en", "fr"]
    rows = [(1, None), (2, ""), (3, "12 34 ²!"), (4, "THE dog"), (4, "THE dog"), (None, "katzen und hunde"), (5, "日本語"), (6, "chien " * 20000)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred) for r in L.predict(df, model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (5, "de"), (6, "fr")]
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [4, 4, None, 6]
    none = L.fit(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"))
    assert {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}
    assert L.predict(df.limit(0), model).count() == 0


def test_backoff_goes_down_by_order():
    def own(rows):
        codes = np.array([(L.gram_code if n else L.word_code)(g) for n, g in rows], np.uint64)
        order = np.argsort(codes)
        return L.Table(codes[order], np.array([[x, -x] for x in rows.values()]).reshape(-1, 2)[order])

    tables = {0: own({(0, "word"): 1.0}), 4: own({(4, " wor"): 2.0, (4, "worx"): 4.0}), 3: own({(3, "ord"): 3.0}), 2: own({}), 1: own({(1, "z"): 4.0})}
    model = L.LanguageModel(["a", "b"], tables)
    assert model.vector("word")[0] == 1.0
    assert model.vector("worx")[0] == pytest.approx(3.0 * 0.8)
    assert model.vector("xord")[0] == pytest.approx(3.0 * 0.8**2)
    assert model.vector("zq")[0] == pytest.approx(4.0 * 0.8**4)
    assert model.vector("qq") is None
    text = "word worx xord zq qq z"
    runs = L.letter_runs(pa.array([text]))
    got, known = model.vectors(runs, np.arange(6), L.run_hashes(runs.points, runs.starts, runs.ends))
    want = [model.vector(w) for w in text.split()]
    assert known.tolist() == [w is not None for w in want]
    assert got[known].tolist() == [pytest.approx(w) for w in want if w is not None]


def test_hashes_equal_their_plain_forms(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcÄé日 𐐀\n1_") for _ in range(rng.randrange(0, 60))) for _ in range(40)] + ["", "x" * 900]
    monkeypatch.setattr(wordhash, "WINDOW", 64)  # words that run over several windows
    runs = L.letter_runs(pa.array(texts))
    words = [(k, "".join(x).lower()) for k, t in enumerate(texts) for is_word, x in itertools.groupby(t, str.isalpha) if is_word]
    assert runs.text.tolist() == [k for k, _ in words]
    assert L.run_hashes(runs.points, runs.starts, runs.ends).tolist() == [L.word_code(w) for _, w in words]
    for n in L.ORDERS:
        codes, owner = L.gram_hashes(runs, np.arange(len(words)), n)
        assert list(zip(owner.tolist(), codes.tolist())) == [(k, L.gram_code(g)) for k, (_, w) in enumerate(words) for g in L.grams(w, n)]


def test_every_word_of_the_sample_is_kept(spark):
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(12_000)]
    rows = [(k, " ".join(words[k * 100 : k * 100 + 100]), "en") for k in range(120)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    known = model.tables[0].rows(np.array([L.word_code(w) for w in [*words, "unseen"]], np.uint64)) >= 0
    assert known.tolist() == [True] * len(words) + [False]
