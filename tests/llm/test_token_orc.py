import zlib

import numpy as np
import public_tokenizers

from changeloom.llm.token_orc import read_token_orc, with_ids_crc32, write_token_orc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = [(9 - i, x, i) for i, x in enumerate(["a b", None, "", "word " * 3000, "été", "x  y", "b", "c", "d"])] + [(None, "none", 0), (4, "été", 1)]
    write_token_orc(spark.createDataFrame(rows, "doc_id long, text string, shard int"), f"file://{tmp_path}/o", PATH)
    got = sorted(with_ids_crc32(read_token_orc(spark, f"file://{tmp_path}/o")).collect(), key=lambda r: r.start)
    at, want = 0, []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    one = read_token_orc(spark, f"file://{tmp_path}/o", [6]).collect()
    assert [r.doc_id for r in one] == [6] and one[0].start == next(w[1] for w in want if w[0] == 6)


def test_empty(spark, tmp_path):
    write_token_orc(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/o", PATH)
    assert with_ids_crc32(read_token_orc(spark, f"file://{tmp_path}/o")).count() == 0


def test_look_up_reads_few_rows(spark, tmp_path):
    """Files, stripes and row groups without the doc_id are skipped, and no ids are read for the offsets."""
    df = spark.range(40_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    write_token_orc(df, f"file://{tmp_path}/o", PATH, shards=4)
    found = spark.read.orc(f"file://{tmp_path}/o").filter("doc_id = 12345")
    assert [r.doc_id for r in found.collect()] == [12345]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 0 < scan.metrics().apply("numOutputRows").value() <= 4000
    one = read_token_orc(spark, f"file://{tmp_path}/o", [12345])
    assert one.count() == 1 and "EqualTo(doc_id,12345)" in one._jdf.queryExecution().executedPlan().toString()
    firsts = spark.read.parquet(f"file://{tmp_path}/o/_shards").collect()
    assert len(firsts) == 4 and min(r["first"] for r in firsts) == 0
