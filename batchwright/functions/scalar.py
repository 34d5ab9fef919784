"""Column expressions (F1-F18). All are built-in functions, so they stay in codegen."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "literal",
    "remainder",
    "tagged",
    "tagged_padded",
    "plus_seconds",
    "plus_hours",
    "iso_text",
    "parse_iso",
    "month_start",
    "plus_days",
    "days_between",
    "round_exact",
    "round_cents",
    "json_payload",
    "hash_int",
    "hash_real",
    "capital_letter",
    "random_uuid",
    "now_ntz",
    "percent",
    "rate",
    "ratio",
]

ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"


def literal(value) -> Column:
    """Literal column; a datetime without a zone becomes a zone-less timestamp, whereas
    `lit` would read it in the time zone of the driver's machine."""
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def remainder(value: Column, n: int) -> Column:
    """Non-negative integer remainder (F1)."""
    return F.pmod(value, F.lit(n).cast("bigint"))


def tagged(prefix: str, value: Column) -> Column:
    """`prefix` followed by the value (F2)."""
    return F.concat(F.lit(prefix), value.cast("string"))


def tagged_padded(prefix: str, value: Column, width: int) -> Column:
    """As `tagged`, zero-padded; longer numbers are kept whole, which lpad does not do."""
    text = value.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, F.lit("0"))).otherwise(text))


def plus_seconds(start: Column, seconds: Column) -> Column:
    """(F4)"""
    return F.timestamp_add("SECOND", seconds, start)


def plus_hours(start: Column, hours: Column) -> Column:
    """(F5)"""
    return F.timestamp_add("HOUR", hours, start)


def iso_text(ts: Column) -> Column:
    """`2024-01-31T00:00:00+00:00`."""
    return F.date_format(ts, ISO_PATTERN)


def parse_iso(text: Column) -> Column:
    """Zone-less timestamp from ISO text; an offset is dropped, not applied (F8)."""
    return text.cast("timestamp_ntz")


def month_start(day: Column) -> Column:
    """First day of the month."""
    return F.trunc(day, "MM")


def plus_days(day: Column, n: Column) -> Column:
    """A date so many days later."""
    return F.date_add(day, n.cast("int"))


def days_between(start: Column, end: Column) -> Column:
    """Days from `start` to `end`."""
    return F.date_diff(end, start).cast("bigint")


def round_exact(x: Column, digits: int) -> Column:
    """Round a non-negative double to at most 8 digits as exact arithmetic on its binary
    value would, ties to even (F10).

    Neither `round` nor `bround` does that: both go through the shortest decimal text.
    Here x is split into two halves of 26 bits. Their products with a power of ten, whose
    own digits are 19 bits at most, are exact, and so are the whole and fractional parts of
    those. The fractions are never added as such: only signs of sums are taken, and a
    floating-point sum has the right sign. Holds as long as the result has 53 bits.
    """
    scale = float(10**digits)
    scaled = x * F.lit(134217729.0)
    high = scaled - (scaled - x)
    low = (x - high) * scale
    high = high * scale
    whole_high, whole_low = F.floor(high), F.floor(low)
    part_high, part_low = high - whole_high.cast("double"), low - whole_low.cast("double")
    carry = ((part_high - 1.0) + part_low >= 0).cast("int")
    floor = whole_high + whole_low + carry
    beyond = (part_high - 0.5 - carry.cast("double")) + part_low
    units = F.when(beyond > 0, floor + 1).when(beyond < 0, floor).otherwise(floor + F.pmod(floor, F.lit(2)))
    return units.cast("double") / scale


def round_cents(x: Column) -> Column:
    """`round_exact` to 2 digits."""
    return round_exact(x, 2)


def json_payload(value: Column) -> Column:
    """JSON text with one space after the colon, which to_json leaves out."""
    return F.concat(F.lit('{"test": "data_'), value.cast("string"), F.lit('"}'))


def hash_int(seed: int, key: Column, stream: str, low: int, high: int) -> Column:
    """Integer in [low, high], a function of (seed, key, stream) alone, so that a retried
    task draws the same value again (F12)."""
    return F.pmod(F.xxhash64(F.lit(seed), key, F.lit(stream)), F.lit(high - low + 1)) + F.lit(low)


def hash_real(seed: int, key: Column, stream: str, high: float, digits: int) -> Column:
    """Double in [0, high], rounded to `digits`."""
    unit = F.pmod(F.xxhash64(F.lit(seed), key, F.lit(stream)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return round_exact(unit * high, digits)


def capital_letter(seed: int, key: Column, stream: str) -> Column:
    """One of A to Z."""
    return F.char(hash_int(seed, key, stream, 65, 90))


def random_uuid() -> Column:
    """(F13)"""
    return F.uuid()


def now_ntz() -> Column:
    """(F13)"""
    return F.localtimestamp()


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, and 0 where the whole is 0."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def rate(amount: Column, duration: Column) -> Column:
    """amount / duration, and 0 where the duration is 0."""
    return F.when(duration > 0, amount / duration).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)
