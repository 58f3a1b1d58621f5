import random
import re

import numpy as np

import pytest

from changeloom.llm import near_dedup
from changeloom.llm.components import connected_components
from changeloom.llm.near_dedup import CHUNKS, DISTANCE, SYMBOLS, bucket_keys, drop_near_duplicates, first_shared_key, near_duplicates


def brute(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(docs))


def corpus():
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, docs = text(60), []
    for _ in range(30):
        base = text(rng.randrange(3, 200))
        docs.append(base)
        for _ in range(rng.randrange(0, 6)):
            edit = list(base)
            for _ in range(rng.randrange(0, 8)):
                edit[rng.randrange(len(edit))] = f"e{rng.randrange(4000)}"
            docs.append(edit)
    family = text(120)
    for _ in range(80):
        edit = list(family)
        for _ in range(rng.randrange(0, 5)):
            edit[rng.randrange(len(edit))] = f"f{rng.randrange(4000)}"
        docs.append(edit)
    docs += [text(20) + passage + text(20) for _ in range(60)]
    rng.shuffle(docs)
    rows = [(k * 3 + 1, rng.choice([" ", "\n", " \t"]).join(w if rng.random() < 0.9 else w.upper() for w in d)) for k, d in enumerate(docs)]
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (8000, "ONE  two"), (9004, rows[5][1]), (9005, "x"), (9006, "word " * 5000), (7, "word " * 4000)]


def test_equal_to_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, component string").repartition(5)
    out = near_duplicates(df)
    assert sorted(tuple(r) for r in out.collect()) == brute(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [d for d, _, _, k in brute(docs) if k]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (3, "a B c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(near_duplicates(df).collect(), key=str)
    assert [tuple(r) for r in got] == [(3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False), (None, 2, None, True), (None, 2, None, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_pigeonhole():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (300, SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for k in range(300):
        b[k, rng.permutation(SYMBOLS)[:DISTANCE]] ^= 1
    ka, kb = bucket_keys(a), bucket_keys(b)
    first = first_shared_key(a, b)
    for k in range(300):
        shared = np.flatnonzero(ka[k] == kb[k])
        assert len(shared) and first[k] == shared[0]
    assert len(set(ka[0].tolist())) == ka.shape[1] == CHUNKS * 10


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100, 180)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def boilerplate():
    """Texts that share most of their words but not three quarters of their shingles, with pairs and groups among them that do."""
    rng = random.Random(21)
    common = [f"c{k}" for k in range(40)]
    docs = [[*common[: rng.randrange(34, 40)], *(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 30)))] for _ in range(150)]
    docs += [[*docs[k][:-2], f"v{k}"] for k in range(40)]
    family = [*common, *(f"f{k}" for k in range(20))]
    docs += [[*family[:30], f"x{k}", *family[30:]] for k in range(60)]
    docs += [common[: 20 + k % 15] for k in range(30)]
    rng.shuffle(docs)
    return [(k, " ".join(d)) for k, d in enumerate(docs)]


@pytest.mark.parametrize("block", [1024, 40, 8])
def test_large_buckets_of_several_components(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = boilerplate()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == brute(docs)


def test_recall_of_barely_similar_pairs(spark):
    """Two thousand pairs at similarity 0.75 to 0.80, where the bound on the signatures is nearest; no other links."""
    rng = random.Random(22)
    rows, pairs = [], 0
    while pairs < 2000:
        n = rng.randrange(60, 200)
        a = [f"p{rng.randrange(10**7)}" for _ in range(n)]
        b = list(a)
        for k in range(0, n - 5):
            if 100 * overlap(a, b) < 80 * (2 * (n - 4) - overlap(a, b)):
                break
            b[(k * 5 + 2) % n] = f"q{rng.randrange(10**7)}"
        both = overlap(a, b)
        if 75 * (2 * (n - 4) - both) <= 100 * both:
            rows += [(2 * pairs, " ".join(a)), (2 * pairs + 1, " ".join(b))]
            pairs += 1
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    linked = sum(r.component_id == r.doc_id - 1 for r in found if r.doc_id % 2)
    assert linked >= 0.999 * pairs and all(r.component_id in (r.doc_id, r.doc_id - r.doc_id % 2) for r in found)


def overlap(a, b):
    return len({tuple(a[i : i + 5]) for i in range(len(a) - 4)} & {tuple(b[i : i + 5]) for i in range(len(b) - 4)})
