"""Binary forms of source values, for rows that were stored undecoded.

Fixed-width values are JVM expressions. Numbers of any precision, addresses and CRC32C, which Spark lacks, are Arrow
UDFs; keep them off hot paths by decoding when rows are loaded.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


def little_endian(data: Column, width: int) -> Column:
    """N11. A signed little-endian integer of 2, 4 or 8 bytes; NULL if the width is another."""
    kind = {2: "smallint", 4: "int", 8: "bigint"}[width]
    flipped = F.concat(*[F.substring(data, k, 1) for k in range(width, 0, -1)])
    high = F.conv(F.hex(F.substring(flipped, 1, 1)), 16, 10).cast("bigint")
    rest = F.conv(F.hex(F.substring(flipped, 2, width - 1)), 16, 10).cast("bigint")
    value = F.shiftleft(F.when(high >= 128, high - 256).otherwise(high), 8 * (width - 1)) + rest
    return F.when(F.octet_length(data) == width, value.cast(kind))


def _numeric(data: bytes) -> str:
    head = int.from_bytes(data[:2], "little")
    if head & 0xC000 == 0xC000:
        return {0xC000: "NaN", 0xD000: "Infinity", 0xF000: "-Infinity"}[head & 0xF000]
    if head & 0x8000:
        negative, scale, at = bool(head & 0x2000), (head & 0x1F80) >> 7, 2
        weight = (head & 0x3F) - (64 if head & 0x40 else 0)
    else:
        negative, scale, at = bool(head & 0x4000), head & 0x3FFF, 4
        weight = int.from_bytes(data[2:4], "little", signed=True)
    groups = [int.from_bytes(data[k : k + 2], "little") for k in range(at, len(data), 2)]
    whole = "".join(f"{groups[k] if k < len(groups) else 0:04d}" for k in range(weight + 1)).lstrip("0") or "0"
    tail = "0000" * max(0, -weight - 1) + "".join(f"{g:04d}" for g in groups[max(0, weight + 1) :])
    sign = "-" if negative and groups else ""
    return f"{sign}{whole}.{tail[:scale].ljust(scale, '0')}" if scale else f"{sign}{whole}"


@F.pandas_udf(StringType())
def numeric_text(data: pd.Series) -> pd.Series:
    """N1. A stored numeric as text: all digits of its scale, NaN and infinities by name."""
    return data.map(lambda b: None if b is None else _numeric(bytes(b)))


@F.pandas_udf(StringType())
def inet_text(data: pd.Series, is_cidr: pd.Series) -> pd.Series:
    """N3. An address (family 2 or 3, prefix length, bytes); the length is left out of a full inet, never of a cidr."""

    def one(b, cidr) -> str | None:
        if b is None:
            return None
        b = bytes(b)
        size = {2: 4, 3: 16}.get(b[0])
        if size is None or len(b) < 2 + size:
            raise ValueError(f"not an address: {b.hex()}")
        text = str(ipaddress.ip_address(b[2 : 2 + size]))
        return f"{text}/{b[1]}" if cidr or b[1] != 8 * size else text

    return pd.Series([one(b, c) for b, c in zip(data, is_cidr, strict=True)], dtype=object)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0x82F63B78), table >> np.uint32(1))
    return table


@F.pandas_udf(LongType())
def crc32c(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """N14. CRC-32C of each value; all values of a batch step through their bytes together."""
    table = _crc_table()
    for data in parts:
        values = [b"" if b is None else bytes(b) for b in data]
        sizes = np.array([len(b) for b in values])
        order = np.argsort(-sizes, kind="stable")
        crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
        flat, starts = np.frombuffer(b"".join(values), np.uint8), np.cumsum(sizes) - sizes
        live = len(values)
        for k in range(int(sizes.max(initial=0))):
            while live and sizes[order[live - 1]] <= k:
                live -= 1
            at = order[:live]
            crc[at] = table[(crc[at] ^ flat[starts[at] + k]) & 0xFF] ^ (crc[at] >> np.uint32(8))
        out = pd.Series((crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64), dtype="Int64")
        yield out.mask(pd.Series([b is None for b in data]))
