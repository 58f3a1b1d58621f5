import random

import pytest

from changeloom.llm import toxicity as T
from changeloom.llm.common import table
from changeloom.llm.queries import op8_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    rows = {r.doc_id: r for r in op8_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    held = [(r.predicted, labels[d]) for d, r in rows.items() if r.held_out and d in labels]
    hit = sum(p and t for p, t in held)
    # some texts are labelled toxic that share no word with others so labelled; they bound the recall
    assert hit / sum(t for _, t in held) > 0.85 and hit / sum(p for p, _ in held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_folding_boundaries_and_exceptions():
    m = T.Matcher(T.ToxicityModel({"idiot": 3.0, "trash": 2.0, "vequ*": 1.0}, ("trash can",)))
    total = lambda t: m.features(t)[0]
    assert total("You 1D10T!") == total("іdiоt") == total("ídi​ot") == total("ｉｄｉｏｔ") == 3.0
    assert total("idiotic") == total("xidiot") == total("the trash can") == total("Trash-bag no")- 2.0 == 0.0
    assert total("vequta") == 1.0 and total("vequ") == 0.0 and total("trash trash can") == 2.0
    assert m.features("idiot a b c")[1] == 3.0 / 4
    assert m.score("idiot") > m.score("idiot " + "word " * 5000) > m.score("")


def plain_features(model, text):
    """By looking for every entry at every place."""
    folded = T.fold(text)
    alone = lambda a: a == 0 or not folded[a - 1].isalnum()
    covered = set()
    for phrase in map(T.fold, model.exceptions):
        for a in range(len(folded)):
            if folded.startswith(phrase, a) and alone(a) and (a + len(phrase) == len(folded) or not folded[a + len(phrase)].isalnum()):
                covered.add((a, a + len(phrase)))
    best = {}
    for a in range(len(folded)):
        for entry, weight in model.lexicon.items():
            stem = entry.rstrip("*")
            b = a + len(stem)
            more = b < len(folded) and folded[b].isalnum()
            if folded.startswith(stem, a) and alone(a) and more == entry.endswith("*") and not any(c <= a and b <= d for c, d in covered):
                best[a] = max(best.get(a, 0.0), weight)
    words = "".join(c if c.isalnum() else " " for c in folded).split()
    return sum(best.values()), sum(best.values()) / max(1, len(words))


def test_equal_to_brute_force():
    rng = random.Random(13)
    model = T.ToxicityModel({"bad": 2.0, "badi*": 3.0, "ba*": 1.0, "sad": 1.5, "dab": 0.5}, ("bad dab", "not sad"))
    m = T.Matcher(model)
    for _ in range(300):
        text = "".join(rng.choice(["bad", "badly", "b4d", "BAD", "dab", "not", "sad", "ѕаd", " ", " ", "-", "x", "i"]) for _ in range(rng.randrange(0, 25)))
        assert m.features(text) == pytest.approx(plain_features(model, text))


def test_exceptions_are_learned(spark):
    """``bin`` after ``trash`` is said in texts that are not toxic."""
    docs = [(k, f"you are trash number{k} indeed") for k in range(40)] + [(100 + k, f"the trash bin number{k} stands there") for k in range(12)] + [(200 + k, f"fine words number{k}") for k in range(600)]
    marks = [(k, int(k < 100)) for k, _ in docs]
    model = T.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert "trash" in model.lexicon and T.fold("trash bin") in model.exceptions and T.fold("are trash") not in model.exceptions
    m = T.Matcher(model)
    assert m.score("you are trash here") > 0.5 > m.score("a trash bin here")


def test_choice_leaves_out_companions():
    toxic = [["bad", "worse", f"x{k % 2}"] for k in range(4)] + [["bad", "copy"]] * 6 + [["worse"]] * 5
    scores = dict.fromkeys(["bad", "worse", "copy", "x0", "x1"], 3.0)
    # six texts with "bad" are left a weight of DECAY each
    assert T.choose_entries(scores, toxic, 6 * T.DECAY + 0.1) == ["bad", "worse"]


def test_cases(spark):
    docs = [(k, f"fine words number {k}") for k in range(30)] + [(100 + k, f"you zork{'s' * (k % 3)} number {k} zork") for k in range(12)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, toxic string")
    marks = [(k, 0) for k in range(30)] + [(100 + k, 1) for k in range(12)] + [(None, 1), (3, None), (5, 0)]
    model = T.fit(df, spark.createDataFrame(marks, "doc_id long, toxic int"))
    test = spark.createDataFrame([(1, None), (2, ""), (3, "a zork"), (3, "a zork"), (None, "fine"), (4, "zork " * 20000)], "doc_id long, text string")
    got = T.predict(test, model).collect()
    assert [r.predicted for r in got] == [0, 0, 1, 1, 0, 1] and T.predict(test.limit(0), model).count() == 0
    assert [r.doc_id for r in T.keep_clean(test, model).collect()] == [1, 2, None]
    assert T.fit(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).lexicon == {}
    none = T.fit(df, spark.createDataFrame(marks[:30], "doc_id long, toxic int"))
    assert {r.predicted for r in T.predict(test, none).collect()} == {0}
