"""Text and number forms of source values, as column expressions (N*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_DAYS, EPOCH_MICROS = 10_957, 946_684_800_000_000
SEGMENT = 16 << 20


def _abs(x: Column) -> Column:
    return F.abs(x)


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def time_text(micros: Column) -> Column:
    """N8. ``HH:MM:SS[.ffffff]``, zeros at the end of the fraction left out, with a sign; hours may pass 99."""
    us = F.abs(micros)
    hours = F.floor(us / 3_600_000_000)
    hour_text = F.when(hours < 100, _two(hours)).otherwise(hours.cast("string"))
    clock = F.concat(hour_text, F.lit(":"), _two(F.floor(us / 60_000_000) % 60), F.lit(":"), _two(F.floor(us / 1_000_000) % 60))
    rest = us % 1_000_000
    fraction = F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(rest.cast("string"), 6, "0"), "0+$", "")))
    return F.concat(F.when(micros < 0, "-").otherwise(""), clock, fraction)


def interval_text(months: Column, days: Column, micros: Column) -> Column:
    """N4. ``1 year 2 mons 3 days 04:05:06.7``; nothing at all is ``00:00:00``."""
    years, mons = F.when(months < 0, -F.floor(-months / 12)).otherwise(F.floor(months / 12)), F.when(months < 0, -(-months % 12)).otherwise(months % 12)
    part = lambda n, one, many: F.when(n != 0, F.concat(n.cast("string"), F.lit(" "), F.when(F.abs(n) == 1, one).otherwise(many)))
    text = F.concat_ws(" ", part(years, "year", "years"), part(mons, "mon", "mons"), part(days, "day", "days"), F.when(micros != 0, time_text(micros)))
    return F.when((months == 0) & (days == 0) & (micros == 0), "00:00:00").otherwise(text)


def timetz_text(micros: Column, west_seconds: Column) -> Column:
    """N5. The time and its offset ``±HH[:MM[:SS]]``; the zone is given in seconds west."""
    a = F.abs(west_seconds)
    h, m, s = F.floor(a / 3600), F.floor(a % 3600 / 60), a % 60
    tail = F.when((m != 0) | (s != 0), F.concat(F.lit(":"), _two(m), F.when(s != 0, F.concat(F.lit(":"), _two(s))).otherwise(""))).otherwise("")
    return F.concat(time_text(micros), F.when(west_seconds > 0, "-").otherwise("+"), _two(h), tail)


def uuid_text(hex32: Column) -> Column:
    """N6. 36 characters in lower case from 32 hex digits."""
    h = F.lower(hex32)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def from_source_date(days: Column) -> Column:
    """N7. Days since 2000-01-01 as a date, held within 32 bits."""
    return F.date_from_unix_date(F.least(days.cast("long") + EPOCH_DAYS, F.lit(2_147_483_647)).cast("int"))


def date_text(date: Column) -> Column:
    """N7. ``YYYY-MM-DD``; years past 9999 have more digits, without Spark's sign."""
    return F.regexp_replace(date.cast("string"), r"^\+", "")


def from_source_micros(micros: Column) -> Column:
    """N7. Microseconds since 2000-01-01 as Unix microseconds, held within 64 bits."""
    return F.when(micros > (1 << 63) - 1 - EPOCH_MICROS, F.lit((1 << 63) - 1)).otherwise(micros + EPOCH_MICROS)


def parse_bool(text: Column) -> Column:
    """N13."""
    return text.isin("t", "true", "yes", "on", "1")


def lsn_text(lsn: Column) -> Column:
    """N15. ``X/Y`` in upper-case hex."""
    return F.concat(F.hex(F.shiftright(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit((1 << 32) - 1))))


def parse_lsn(text: Column) -> Column:
    """N15."""
    part = lambda k: F.conv(F.split(text, "/").getItem(k), 16, 10).cast("long")
    return F.shiftleft(part(0), 32) + part(1)


def align_down(lsn: Column) -> Column:
    """N15. To the start of its segment."""
    return lsn - lsn % SEGMENT


def numeric_typmod(typmod: Column) -> tuple[Column, Column]:
    """N18. Precision and scale (11 bits, signed); NULL if there is no typmod."""
    own = typmod - 4
    scale = own.bitwiseAND(F.lit(0x7FF))
    return F.when(typmod >= 4, F.shiftright(own, 16).bitwiseAND(F.lit(0xFFFF))), F.when(typmod >= 4, F.when(scale >= 1024, scale - 2048).otherwise(scale))


def decimal_type(typmod: Column) -> Column:
    """N18. ``Decimal(p, s)`` for 1 <= p <= 76 and 0 <= s <= p, else ``String``."""
    p, s = numeric_typmod(typmod)
    return F.when((p >= 1) & (p <= 76) & (s >= 0) & (s <= p), F.concat(F.lit("Decimal("), p.cast("string"), F.lit(", "), s.cast("string"), F.lit(")"))).otherwise("String")


def truncate_text(text: Column, precision: int, scale: int) -> Column:
    """N2. A number's text with ``scale`` digits behind the point, further ones cut off, not rounded; NULL if it has over
    ``precision`` digits in all, or is no number (a sign, digits and at most one point).

    All of it is text, so any precision will do.
    """
    ok = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    whole = F.regexp_replace(F.regexp_extract(text, r"^[+-]?([0-9]*)", 1), "^0+", "")
    tail = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]*)$", 1), 1, scale), scale, "0") if scale else F.lit("")
    digits = F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("." if scale else ""), tail)
    sign = F.when(text.startswith("-") & digits.rlike("[1-9]"), "-").otherwise("")
    return F.when(ok & (F.length(whole) <= precision - scale), F.concat(sign, digits))


def truncate_decimal(text: Column, precision: int, scale: int) -> Column:
    """N2. As ``truncate_text``, as decimal(precision, scale) up to 38 digits; beyond that it stays text, as Spark has no such decimal."""
    cut = truncate_text(text, precision, scale)
    return cut.cast(f"decimal({precision},{scale})") if precision <= 38 else cut


def valid_text(data: Column) -> Column:
    """N12. UTF-8 as text, anything else NULL (to be kept as bytes)."""
    return F.try_validate_utf8(data.cast("string"))


def value_size(*columns: Column) -> Column:
    """N17. Bytes of a row's values, for budgets; NULL counts nothing."""
    out = F.lit(0)
    for c in columns:
        out = out + F.coalesce(F.octet_length(c.cast("string")), F.lit(0))
    return out


def quoted_name(name: Column) -> Column:
    """N16. An identifier in backticks."""
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def quoted_text(text: Column) -> Column:
    """N16, P12. A string literal."""
    return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def quoted_bytes(data: Column) -> Column:
    """N16. Bytes as a hex literal."""
    return F.concat(F.lit("X'"), F.hex(data), F.lit("'"))


def relation_path(path: Column) -> dict[str, Column]:
    """N19. ``db, node, fork, seg`` of a file's path ``base/<db>/<node>[_<fork>][.<seg>]``; NULL where it has none."""
    part = lambda k: F.nullif(F.regexp_extract(path, r"^base/(\d+)/(\d+)(?:_([a-z]+))?(?:\.(\d+))?$", k), F.lit(""))
    return {"db": part(1).cast("long"), "node": part(2).cast("long"), "fork": part(3), "seg": part(4).cast("int")}


def status_segment(path: Column) -> Column:
    """N19. The number of a transaction status segment ``pg_xact/<hex>``."""
    return F.conv(F.nullif(F.regexp_extract(path, r"^pg_xact/([0-9A-Fa-f]+)$", 1), F.lit("")), 16, 10).cast("long")
