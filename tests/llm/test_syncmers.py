import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from changeloom.llm import syncmers as S
from changeloom.llm.common import split_mix


def plain(text, k=S.K, s=S.S):
    """Positions of the closed syncmers of one text, by the definition."""
    b = text.encode()
    rank = lambda i: int(split_mix(np.array([int.from_bytes(b[i : i + s], "big")], np.uint64))[0])
    out = []
    for i in range(len(b) - k + 1):
        inner = [rank(j) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out if len(b) >= k or not b else [0]


def test_positions_by_definition():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcé \n") for _ in range(n)) for n in (0, 1, 15, 16, 17, 200, 0, 90)] + ["aaaaaaaaaaaaaaaaaaaaaaaaa"]
    found, hashes, first = S.closed_syncmers(pa.array(texts))
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for k, t in enumerate(texts):
        assert (found[first[k] : first[k + 1]] - at[k]).tolist() == plain(t)
    assert len(hashes) == len(found)


def test_sketch_is_exact_bottom():
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(n)}" for _ in range(n)) for n in (5, 40, 700, 5000)]
    for t, own in zip(texts, S.sketches(pa.array(texts)), strict=True):
        _, h, _ = S.closed_syncmers(pa.array([t]))
        assert own.tolist() == sorted({int(x) >> 32 for x in h})[: S.SKETCH]
        assert S.from_text(S.to_text(own)).tolist() == own.tolist()


def plain_aligned(a, b):
    """By the table of longest rising runs; repeated anchors are matched in order."""
    if not a or not b:
        return float(len(a) == len(b))
    nth = lambda x: [(h, x[:i].count(h)) for i, h in enumerate(x)]
    place = {k: i for i, k in enumerate(nth(b))}
    rise = []
    for k in nth(a):
        if k in place:
            rise.append((place[k], 1 + max((n for p, n in rise if p < place[k]), default=0)))
    return 2 * max((n for _, n in rise), default=0) / (len(a) + len(b))


def test_aligned_counts_anchors_in_one_order():
    rng = random.Random(12)
    for _ in range(40):
        a = [rng.randrange(30) for _ in range(rng.randrange(0, 40))]
        b = rng.choice([a, a[5:] + a[:5], [rng.randrange(30) for _ in range(20)], [*a[:10], 99, *a[10:]]])
        assert S.aligned(np.array(a, np.uint64), np.array(b, np.uint64)) == pytest.approx(plain_aligned(a, b))


def test_longer_sketches_are_nearer_the_truth():
    rng = random.Random(14)
    words = [f"w{rng.randrange(9999)}" for _ in range(900)]
    texts = pa.array([" ".join(words), " ".join(words[:450] + [f"v{k}" for k in range(450)])])
    (_, h, at) = S.text_anchors(texts)
    one, two = (set((h[at[k] : at[k + 1]] >> np.uint64(32)).tolist()) for k in (0, 1))
    true = len(one & two) / len(one | two)
    assert S.likeness(*S.sketches(texts, 1 << 20), 1 << 20) == pytest.approx(true)
    assert abs(S.likeness(*S.sketches(texts, 512), 512) - true) < 0.05


@pytest.mark.parametrize("parts", [1, 7])
def test_compare_with_next(spark, parts):
    rng = random.Random(10)
    rows = [(k * k, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(0, 300))), "x") for k in range(60)] + [(5000, None, "x"), (5001, "é" * 7, "x"), (5002, "word " * 6000, "x"), (16, "twice", "y"), (None, "last", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, follows string").repartition(parts)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    got = {(r.doc_id, r.edited_sha256): r for r in S.compare_with_next(df).collect()}
    assert len(got) == len(rows)
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        text, nxt = a[1] or "", b[1] or ""
        edited = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
        r = got[a[0], hashlib.sha256(edited.encode()).hexdigest()]
        mine, edit, other = S.sketches(pa.array([text, edited, nxt]))
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), S.to_text(mine), S.to_text(edit))
        assert (r.near_edited, r.near_next) == (S.likeness(mine, edit), S.likeness(mine, other))
        whole, part = (S.text_anchors(pa.array([x]))[1].tolist() for x in (text, edited))
        assert r.aligned_edited == pytest.approx(plain_aligned(whole, part))
        assert 0 <= r.near_next <= 1 and (text != edited or r.near_edited == 1)


def test_small_tables(spark):
    df = spark.createDataFrame([(3, "only one document here, its own next")], "doc_id long, text string")
    r = S.compare_with_next(df).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert S.compare_with_next(df.limit(0)).count() == S.fingerprints(df.limit(0)).count() == 0
    assert S.anchors(df).count() == len(plain("only one document here, its own next"))
    same = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in S.fingerprints(same).collect()}
    assert prints[1] == prints[2] != prints[3] == ""


def test_texts_without_a_syncmer_differ():
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(16, 26))) for _ in range(400)]
    bare = [t for t in texts if not plain(t)]
    assert len(bare) > 5
    own = S.sketches(pa.array([*bare, bare[0], ""]))
    assert [len(x) for x in own] == [1] * (len(bare) + 1) + [0]
    assert S.likeness(own[0], own[-2]) == 1 and all(S.likeness(own[0], x) == 0 for x in own[1:-2]) and S.likeness(own[0], own[-1]) == 0
