import base64
import hashlib
import io

import pytest

from changeloom.llm import warc as W


def write(spark, rows, path, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    W.register(spark)
    W.page_records(df, min_revisit_bytes=options.pop("min_revisit_bytes", 0)).write.format("warc").options(**options).mode("append").save(path)


ROWS = [(5, "http://a/", "<p>é</p>"), (2, "http://b/\r\nEvil: 1", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "u", None), (3, "u", ""), (4, "u", "x\r\n\r\nWARC/1.1\r\n" * 9000), (None, "n", "<p>é</p>"), (2, "again", "<p>é</p>"), (7, "u", "alone")]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    path = f"file://{tmp_path}/w"
    write(spark, ROWS, path, compression=compression, max_file_bytes="200")
    df = spark.read.format("warc").option("verify", "true").load(path)
    got = df.select(W.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", W.page_of("refers_to_id").alias("refers_to"), "payload").collect()
    first = {}
    for p, _, h in ROWS:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in ROWS:
        data = (h or "").encode()
        again = p is not None and first[h or ""] != p
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None, None if again else data))
    assert sorted(map(str, (tuple(r)[:5] + ((bytes(r.payload) if r.payload is not None else None),) for r in got))) == sorted(map(str, want))
    assert not list((tmp_path / "w").glob("_staged*"))


def test_push_down(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write(spark, ROWS, path)
    lean = spark.read.format("warc").schema("record_type string, record_id string, payload_bytes long").load(path)
    found = lean.filter("record_type = 'revisit' AND record_id IN ('<urn:page:5>', '<urn:page:7>', '<urn:page:9>')")
    assert sorted(r.record_id for r in found.collect()) == ["<urn:page:5>", "<urn:page:9>"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("filterPushdown", "").split("BatchScan")[0]
    assert spark.read.format("warc").load(path).filter("target_uri LIKE 'http://b/%'").count() == 1
    assert spark.read.format("warc").load(f"file://{tmp_path}/nothing").count() == 0


def test_short_payloads_are_responses_and_empty(spark, tmp_path):
    write(spark, ROWS, f"file://{tmp_path}/a", min_revisit_bytes=1)
    kinds = {(r.record_id, r.record_type) for r in spark.read.format("warc").load(f"file://{tmp_path}/a").collect()}
    assert ("<urn:page:3>", "response") in kinds and ("<urn:page:5>", "revisit") in kinds
    df = spark.createDataFrame([], "page_id long, url string, html string")
    W.page_records(df).write.format("warc").mode("append").save(f"file://{tmp_path}/b")
    assert spark.read.format("warc").load(f"file://{tmp_path}/b").count() == 0


def stream(rows, compressed=False):
    data = [W.record_bytes("response", f"<urn:page:{k}>", None, "d", None, body) for k, body in rows]
    return b"".join(map(W._gzip, data) if compressed else data)


def test_damage_is_reported():
    data = stream([(1, b"payload")])
    assert next(W.records(io.BytesIO(data), False, verify=True))["payload"] == b"payload"
    for broken, compressed, what in [
        (data[:-9], False, "cut off"),
        (data.replace(b"payload\r", b"PAYLOAD\r"), False, "digest"),
        (stream([(1, b"payload")], True)[:-12], True, "cut off"),
        (data.replace(b"Content-Length: 7\r\n\r\n", b"\r\n\r\n", 1).replace(b"Content-Length: ", b"Length: "), False, "no Content-Length"),
        (data.replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: x"), False, "no Content-Length"),
        (data.replace(b"payload", b"payload, and more"), False, "does not end"),
        (data.replace(b"WARC/1.1", b"HTTP/1.1"), False, "version"),
        (stream([(1, b"x" * 5000)], True).replace(b"x", b"y")[:30] + b"\0" * 60, True, "WARC record near byte 0"),
    ]:
        with pytest.raises(ValueError, match=what):
            list(W.records(io.BytesIO(broken), compressed, verify=True))


@pytest.mark.parametrize("compressed", [False, True])
def test_damage_can_be_skipped(compressed):
    parts = [stream([(k, b"payload %d" % k * 50)], compressed) for k in range(6)]
    if compressed:
        parts[1] = parts[1][:40] + b"\xff" * 20 + parts[1][60:]
        parts[3] = W._gzip(stream([(3, b"p")]).replace(b"\nContent-Length", b"\nLength"))
    else:
        parts[1] = parts[1].replace(b"payload 1", b"payload one", 1)
        parts[3] = parts[3].replace(b"msgtype=response\r\nContent-Length", b"msgtype=response\r\nLength")
    got = [r["record_id"] for r in W.records(io.BytesIO(b"".join(parts)), compressed, verify=True, skip_damaged=True)]
    assert got == [f"<urn:page:{k}>" for k in (0, 2, 4, 5)]
    changed = stream([(0, b"payload"), (1, b"other")]).replace(b"payload\r", b"PAYLOAD\r")
    assert [r["record_id"] for r in W.records(io.BytesIO(changed), False, verify=True, skip_damaged=True)] == ["<urn:page:1>"]
    cut = stream([(0, b"payload"), (1, b"other")], compressed)[:-20]
    assert [r["record_id"] for r in W.records(io.BytesIO(cut), compressed, skip_damaged=True)] == ["<urn:page:0>"]


def test_sizes_are_those_of_the_block():
    head = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n"
    record = lambda block: head % len(block) + block + b"\r\n\r\n"
    blocks = [b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\nabc", b"HTTP/1.1 200 OK\r\nContent-Length:\r\n\r\nabcd", b"HTTP/1.1 200 OK", b"", b"HTTP/1.1 204 No\r\n\r\n"]
    data = b"".join(map(record, blocks)) + record(b"x\r\n\r\n12345").replace(b"response", b"revisit").replace(b"x\r\n", b"x\r\nContent-Length: 7\r\n").replace(b"Content-Length: 10", b"Content-Length: 29")
    data += record(b"last\r\n\r\n").replace(b"application/http", b"text/plain")
    for payload in (True, False):
        got = list(W.records(io.BytesIO(b"\r\n\r\n" + data), False, payload=payload))
        assert [r["payload_bytes"] for r in got] == [3, 4, 15, 0, 0, 7, 8]
    assert [r["payload"] for r in W.records(io.BytesIO(data), False)][:5] == [b"abc", b"abcd", b"HTTP/1.1 200 OK", b"", b""]


@pytest.mark.parametrize("compressed", [False, True])
def test_large_payloads_and_split_files(spark, tmp_path, compressed, monkeypatch):
    rows = [(k, bytes([97 + k % 26]) * n) for k, n in enumerate([3, 5 << 20, 0, W.BUFFER, W.BUFFER - 200, 7, 3 << 20, 40, 50, 60])]
    data = stream(rows, compressed)
    assert [len(r["payload"]) for r in W.records(io.BytesIO(data), compressed, verify=True)] == [len(b) for _, b in rows]
    assert [r["payload_bytes"] for r in W.records(io.BytesIO(data), compressed, payload=False)] == [len(b) for _, b in rows]
    (tmp_path / "w").mkdir()
    (tmp_path / f"w/a.warc{'.gz' * compressed}").write_bytes(data)
    (tmp_path / f"w/b.warc{'.gz' * compressed}").write_bytes(b"")
    W.register(spark)
    for split in (700, 100_000, len(data) // 3, len(data) - 1):
        df = spark.read.format("warc").option("split_bytes", split if compressed else max(split, 100_000)).option("verify", "true").load(f"file://{tmp_path}/w")
        assert df.rdd.getNumPartitions() > 1 or split >= len(data)
        assert sorted((r.record_id, r.payload_bytes) for r in df.select("record_id", "payload_bytes").collect()) == sorted((f"<urn:page:{k}>", len(b)) for k, b in rows)
    # every cut of the file into ranges gives each record once
    small = stream([(k, b"WARC/1.1\r\n\r\n" * (k % 4)) for k in range(12)], compressed)
    for split in range(1, len(small), 37 if compressed else 61):
        got = []
        for a in range(0, len(small), split):
            if (first := W.first_record(io.BytesIO(small), compressed, a, min(a + split, len(small)))) is not None:
                got += [r["record_id"] for r in W.records(io.BytesIO(small), compressed, start=first, end=min(a + split, len(small)))]
        assert got == [f"<urn:page:{k}>" for k in range(12)], split
