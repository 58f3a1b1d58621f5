import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from changeloom.llm.bpe import BatchEncoder, _tokenizer
from changeloom.llm.packing import pack_documents, pack_pool

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab 1.'s\n\té 　 \x85<|>endoftext", max_size=40), max_size=6))
def test_cut_encoding_equals_whole(texts):
    t = _tokenizer(PATH)
    texts.append("a <|endoftext|> b")
    ids, at = BatchEncoder(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pool_is_whole_and_gapless():
    rng = random.Random(3)
    for _ in range(30):
        lengths = np.array([rng.choice([1, 2, 5, 100, 900, 2048, 2049, 5000]) for _ in range(rng.randrange(0, 60))], np.int64)
        pieces, n = pack_pool(lengths, 2048)
        spans = {}
        for doc, start, length, seq, offset in pieces:
            assert length > 0 and seq < n
            spans.setdefault(("d", doc), []).append((start, length))
            spans.setdefault(("s", seq), []).append((offset, length))
        padding = 0
        for (kind, k), own in spans.items():
            at = 0
            for start, length in sorted(own):
                assert start == at
                at += length
            if kind == "d":
                assert at == lengths[k]
            else:
                assert at <= 2048
                padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert padding == 0


def test_pack_documents(spark, whole):
    rows = [(1, "hello world " * 1500, "x"), (2, None, "y"), (2, "", "y"), (None, "été  deux", None), (7, "a b c", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string").coalesce(1)
    out = pack_documents(df, PATH, with_ids=True).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.start)):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids)
        got.setdefault((r.doc_id, r.doc_tokens), []).extend(r.ids)
    assert got[(1, len(whole(rows[0][1])) + 1)] == whole(rows[0][1]) + [1]
    assert got[(2, 1)] == [1, 1] and got[(7, 4)] == whole("a b c") + [1]
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_a_document_longer_than_its_pool(spark, whole):
    """Pools of a hundred tokens, one document of thousands, and ties of equal lengths."""
    rows = [(k, "a b c d e f g h") for k in range(40)] + [(99, "hello world " * 3000), (100, "tail end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = pack_documents(df, PATH, pool_tokens=100, with_ids=True).collect()
    got, places = {}, {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(r.ids)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: ids[:-1] for d, ids in got.items()} == {d: whole(t) for d, t in rows} and all(ids[-1] == 1 for ids in got.values())
    for own in places.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]


def test_whole_while_any_sequence_has_room():
    """Every tail goes to the sequence of lowest cost among all that have room, also where many cheaper ones lack it."""
    rng = random.Random(4)
    pools = [[1500] * 500 + [900] * 1000 + [300] * 1000, [rng.choice([40, 300, 700, 900, 1500, 2047]) for _ in range(900)]]
    for lengths in pools:
        total = sum(lengths)
        left = [2048] * (total // 2048) + [1 << b for b in range(11, -1, -1) if (total % 2048) >> b & 1]
        cost, want = [0.0] * len(left), {}
        for doc in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            n = lengths[doc]
            if fits := [s for s in range(len(left)) if left[s] >= n]:
                s = want[doc] = min(fits, key=lambda k: (cost[k], k))
                cost[s], left[s] = cost[s] + n + n * n / 1024, left[s] - n
        pieces, _ = pack_pool(np.array(lengths, np.int64), 2048)
        assert {doc: s for doc, _, n, s, _ in pieces if n == lengths[doc]} == want
