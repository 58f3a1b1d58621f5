import hashlib
import random
import re

import numpy as np
import pytest

from changeloom.llm.decontaminate import FMIndex, benchmark_hits, decontaminate, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None:
            for s in range(max(1, len(w) - window + 1)) if w else []:
                wins.setdefault(tuple(w[s : s + window]), set()).add(i)
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if own := wins.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    got |= own
        names = sorted(map(str, got))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    vocab = ["a", "b", "the", "Été", "x9", "z", "q", "ouf"]
    item = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, item(rng.choice([12, 15, 30]))) for k in range(8)] + [(8, "Only four words here"), (9, None), (10, "..."), (None, item(11)), (11, item(12)), (3, "the end")]
    docs = []
    for k in range(60):
        parts = [item(rng.randrange(0, 30))] + [rng.choice(items)[1] or "" for _ in range(rng.randrange(0, 3))] + ["only, FOUR-words  here!"] * rng.randrange(0, 2) + [f"w{rng.randrange(99)} " * rng.randrange(9)]
        rng.shuffle(parts)
        docs.append((k, rng.choice([" ", "\n", ". "]).join(parts)))
    return docs + [(60, None), (61, ""), (5, docs[5][1]), (None, items[0][1]), (62, "Ünter " * 3000)], items


def test_fm_index():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 300), 0)
    order = suffix_order(text)
    assert sorted(range(301), key=lambda i: text[i:].tolist()) == order.tolist()
    index = FMIndex(text, 5)
    for n in (1, 3, 5):
        pats = rng.integers(1, 5, (20, n))
        low, high = index.search(pats)
        for p, a, b in zip(pats, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(301 - n) if (text[i : i + n] == p).all()]


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_hits_equal_brute_force(spark, block):
    docs, items = cases()
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, item_id string")
    got = benchmark_hits(df, spark.createDataFrame(items, "item_id long, text string"), block_windows=block, shard_bytes=2000)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_cut_leaves_no_window(spark, block):
    docs, items = cases()
    df = spark.createDataFrame([(d, t, "s", len(t or "")) for d, t in docs], "doc_id long, text string, source string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate(df, bench, shard_bytes=3000, block_windows=block)
    rows = out.collect()
    assert out.columns == df.columns and not any(r[5] for r in brute([(r.doc_id, r.text) for r in rows], items))
    assert all(r.n_chars == len(r.text or "") for r in rows)
    clean = {d for d, _, n, *_ in brute(docs, items) if not n}
    kept = {r.doc_id: r.text for r in rows}
    assert all(kept[d] == t for d, t in docs if d in clean)
    whole = {r.doc_id: r.text for r in decontaminate(df, bench).collect()}
    assert kept == whole
    assert decontaminate(df, bench.limit(0)).count() == df.count() and decontaminate(df.limit(0), bench, block_windows=block).count() == 0
    assert benchmark_hits(df, bench.limit(0)).filter("contaminated").count() == 0
    assert benchmark_hits(df.limit(0), bench).count() == 0


def test_cuts_that_join_a_window_of_another_block(spark):
    """The second item's window appears when the first item's is cut out of its middle."""
    one, two = " ".join(f"a{k}" for k in range(10)), " ".join(f"b{k}" for k in range(10))
    text = f"start {two[:14]} {one} {two[15:]} end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for items in ([(1, one), (2, two)], [(1, two), (2, one)]):
        for block in (1, 100):
            bench = spark.createDataFrame(items, "item_id long, text string")
            assert decontaminate(df, bench, block_windows=block).first().text.split() == ["start", "end"]


def test_text_item_ids(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    got = benchmark_hits(df, spark.createDataFrame([("set/7", "two"), ("set/10", "two three")], "item_id string, text string")).first()
    assert got.n_items == 2 and got.items_sha256 == hashlib.sha256(b"set/10,set/7").hexdigest()
