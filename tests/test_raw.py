import ipaddress
from decimal import Decimal

from pyspark.sql import functions as F

from changeloom.functions import raw


def stored(text: str, long: bool = False) -> bytes:
    """A numeric as it is stored, from its text."""
    if text in ("NaN", "Infinity", "-Infinity"):
        return {"NaN": 0xC000, "Infinity": 0xD000, "-Infinity": 0xF000}[text].to_bytes(2, "little")
    negative, body = text.startswith("-"), text.lstrip("-")
    whole, _, tail = body.partition(".")
    whole = whole.rjust(-(-len(whole) // 4) * 4, "0")
    digits = whole + tail.ljust(-(-len(tail) // 4) * 4, "0")
    groups = [int(digits[k : k + 4]) for k in range(0, len(digits), 4)]
    weight = len(whole) // 4 - 1
    while groups and groups[0] == 0:
        groups.pop(0)
        weight -= 1
    while groups and groups[-1] == 0:
        groups.pop()
    if not groups:
        weight = 0
    short = -64 <= weight <= 63 and len(tail) <= 63 and not long
    head = (0x8000 | (0x2000 if negative else 0) | len(tail) << 7 | weight & 0x7F).to_bytes(2, "little") if short else ((0x4000 if negative else 0) | len(tail)).to_bytes(2, "little") + weight.to_bytes(2, "little", signed=True)
    return head + b"".join(g.to_bytes(2, "little") for g in groups)


def test_numeric(spark):
    texts = ["0", "0.00", "1", "-1.50", "10000", "123456789.000100", "0.0001", "-0.00000012", "99999999999999999999999999.99", "NaN", "Infinity", "-Infinity", "1" * 80 + ".1234"]
    rows = [(k, bytearray(stored(t))) for k, t in enumerate(texts)] + [(99, None)] + [(200 + k, bytearray(stored(t, True))) for k, t in enumerate(texts) if t[-1] != "y"]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, b binary").select("id", raw.numeric_text("b").alias("t")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == t and got.get(200 + k, t) == t
    assert got[99] is None and Decimal(got[5]) == Decimal(texts[5])


def test_inet(spark):
    cases = [("10.0.0.1", 32, False, "10.0.0.1"), ("10.0.0.0", 8, False, "10.0.0.0/8"), ("10.0.0.1", 32, True, "10.0.0.1/32"), ("2001:db8::1", 128, False, "2001:db8::1"), ("2001:0:0:1:0:0:0:1", 64, False, "2001:0:0:1::1/64"), ("::", 0, True, "::/0")]
    rows = [(k, bytearray(bytes([2 if ":" not in a else 3, n]) + ipaddress.ip_address(a).packed), c) for k, (a, n, c, _) in enumerate(cases)]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, b binary, c boolean").select("id", raw.inet_text("b", "c").alias("t")).collect()}
    assert [got[k] for k in range(len(cases))] == [t for *_, t in cases]


def test_integers_and_crc(spark):
    values = [0, 1, -1, 2**31 - 1, -(2**31), 2**62, -(2**63), 300]
    df = spark.createDataFrame([(v, bytearray(v.to_bytes(8, "little", signed=True))) for v in values], "v long, b binary")
    assert all(r.v == r.x for r in df.select("v", raw.little_endian(F.col("b"), 8).alias("x")).collect())
    assert df.select(raw.little_endian(F.col("b"), 4).alias("x")).filter("x IS NOT NULL").count() == 0
    small = spark.createDataFrame([(v, bytearray(v.to_bytes(2, "little", signed=True))) for v in (-32768, -1, 5)], "v int, b binary")
    assert all(r.v == r.x for r in small.select("v", raw.little_endian(F.col("b"), 2).alias("x")).collect())
    sums = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (None,), (bytearray(b"\0" * 32),)], "b binary").coalesce(1).select(raw.crc32c("b").alias("c"))
    assert [r.c for r in sums.collect()] == [0xE3069283, 0, None, 0x8A9136AA]
