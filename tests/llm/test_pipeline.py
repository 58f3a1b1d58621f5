import random

import pytest

import corpus_pipeline as P
from changeloom.llm.common import Scratch
from changeloom.llm.toxicity import Matcher
from changeloom.llm.queries import toxicity_model
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_near_dedup import brute as brute_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with a case of each kind planted."""
    rng = random.Random(12)
    words = {"en": [f"{a}{b}ing" for a in "bcdfgh" for b in "aeiou"], "de": [f"{a}{b}ung" for a in "klmnpr" for b in "äöüei"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + (str(rng.randrange(99)) if rng.random() < 0.3 else "") for _ in range(n))
    rows = [(k, text(lang := rng.choice(["en", "de"]), rng.randrange(20, 200)), lang) for k in range(160)]
    passage = text("en", 30)
    rows[20] = (20, f"{rows[20][1]} {passage} {rows[21][1]}", "en")
    rows[30] = (30, passage, "en")
    rows[40] = (40, rows[41][1] + " more", rows[41][2])
    rows[50] = (50, rows[41][1], rows[41][2])
    rows[60], rows[61], rows[62] = (60, None, "en"), (61, "123 456 !!", "en"), (62, "", None)
    for k in range(100, 130):
        rows[k] = (k, f"{rows[k][1][:90]} zork vile {rows[k][1][90:]}", rows[k][2])
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(d, t, g, "s", len(t or "")) for d, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(100 <= k < 130)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}", rows, passage


def test_stages(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        docs.write.parquet(f"{path}/after-{name}")
        docs = spark.read.parquet(f"{path}/after-{name}")
        seen[name] = before, {r.doc_id: r for r in docs.collect()}
    before, after = seen["language_id"]
    assert set(before) - set(after) == {60, 61, 62} and all(after[k] == before[k] for k in after)
    before, after = seen["toxicity"]
    assert set(before) - set(after) == set(range(100, 130)) and all(after[k] == before[k] for k in after)
    before, after = seen["near_dedup"]
    assert set(after) == {d for d, _, _, kept in brute_groups([(k, r.text) for k, r in before.items()]) if kept}
    assert not {41, 50} & set(after) and 40 in after
    before, after = seen["decontamination"]
    hits = {d: (n, h) for d, n, h, *_ in brute_hits([(k, r.text) for k, r in before.items()], [(1, passage)])}
    assert set(before) - set(after) == {k for k, (n, h) in hits.items() if h and n == h} == {30}
    assert all(after[k] == before[k] for k in after if not hits[k][1])
    assert passage not in after[20].text and after[20].n_chars == len(after[20].text)
    packed = P.run(spark, path).collect()
    assert {r.doc_id for r in packed} == set(after) == {r.doc_id for r in P.pack(spark, docs, path).collect()}
    whole = {}
    for r in packed:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert all(sum(n for _, n in own) == total for (_, total), own in whole.items())


def test_model_is_of_the_labels(spark, folder):
    model = toxicity_model(spark, spark.read.parquet(f"{folder[0]}/documents.parquet"), folder[0])
    assert {"zork", "vile"} & {t.rstrip("*") for t in model.lexicon} and Matcher(model).score("nothing") < 0.5


@pytest.mark.parametrize("case", ["empty tables", "nulls and repeats"])
def test_edges(spark, tmp_path, case):
    """No documents, benchmark or labels; null and repeated doc_ids, and columns named like the stages' own."""
    path, text = f"file://{tmp_path}", "the quiet river runs along the old stone wall toward the harbour"
    rows = [] if case == "empty tables" else [(1, text, "en"), (1, text, "en"), (None, text, "en"), (None, None, None), (2, f"{text} and back again by the hill", "en"), (3, text.upper(), None), (4, "", "en")]
    extra = "score double, row string, component string, key int, c0 string, spans string, id long"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    spark.createDataFrame([(d, t, g, "s", len(t or ""), 0.5, "r", "c", 1, "z", "s", 9) for d, t, g in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark)
    for name, stage in P.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, path), name)
        assert docs.columns == columns
    want = [] if case == "empty tables" else [(None, text), (1, text), (1, text), (2, f"{text} and back again by the hill")]
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(want, key=str)
    packed = P.pack(spark, docs, path).collect()
    assert sorted({r.doc_id for r in packed}, key=str) == sorted({d for d, _ in want}, key=str)
