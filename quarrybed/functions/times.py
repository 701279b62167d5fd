"""Epoch conversions: whole numbers of several epochs to microseconds since 1970, and back to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHROME_SHIFT = 11_644_473_600_000_000  # microseconds from 1601 to 1970
FILETIME_SHIFT = 116_444_736_000_000_000  # 100 ns from 1601 to 1970
SAFARI_SHIFT = 978_307_200  # seconds from 1970 to 2001


def nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0).cast("bigint"))


def chrome_micros(c: Column) -> Column:
    return F.try_subtract(c.cast("bigint"), F.lit(CHROME_SHIFT).cast("bigint"))


def is_unix_seconds(c: Column) -> Column:
    return (c != 0) & (F.abs(c) < 10_000_000_000)


def download_micros(c: Column) -> Column:
    """Older stores hold seconds since 1970, newer ones microseconds since 1601; 0 is no time."""
    c = nonzero(c)
    return F.when(is_unix_seconds(c), c * 1_000_000).otherwise(chrome_micros(c))


def download_duration(start: Column, end: Column) -> Column:
    """Microseconds between two stamps of one kind, null if kinds differ, one is 0 or the end is earlier."""
    s, e = nonzero(start), nonzero(end)
    d = F.try_subtract(e, s)
    return F.when((is_unix_seconds(s) == is_unix_seconds(e)) & (d >= 0), F.when(is_unix_seconds(s), d * 1_000_000).otherwise(d))


def filetime_micros(c: Column, floor: str = "epoch") -> Column:
    """100 ns since 1601 to microseconds, finer digits cut. ``floor`` says which stamps are none: those before 1970
    ('epoch'), those not above 0 ('positive'), or 0 only ('zero')."""
    c = c.cast("bigint")
    t = F.try_subtract(c, F.lit(FILETIME_SHIFT).cast("bigint"))
    micros = F.call_function("div", t - F.pmod(t, F.lit(10).cast("bigint")), F.lit(10).cast("bigint"))
    ok = {"epoch": c >= FILETIME_SHIFT, "positive": c > 0, "zero": c != 0}[floor]
    return F.when(ok, micros)


def safari_micros(c: Column) -> Column:
    """Seconds since 2001 (DOUBLE) to microseconds; not finite is none."""
    c = c.cast("double")
    fine = ~F.isnan(c) & (F.abs(c) < 1e12)
    return F.when(fine, F.round((c + F.lit(float(SAFARI_SHIFT))) * 1e6).cast("bigint"))


def timeline_micros(text: Column) -> Column:
    """Numbers in text: above 1e17 100 ns since 1601, above 1e10 milliseconds, else seconds; not above 0 is none, nor is
    what no instant in microseconds can hold."""
    n = F.trim(text).try_cast("bigint")
    return F.when(n <= 0, F.lit(None).cast("bigint")).when(n > 100_000_000_000_000_000, filetime_micros(n)).when(n > 10_000_000_000, F.try_multiply(n, F.lit(1_000))).otherwise(n * 1_000_000)


def sentinel_date(text: Column) -> Column:
    """Dates that mean none (empty, 1601, 1899, 1900) as null."""
    return F.when(~((text == "") | text.rlike("^(1601|1899|1900)")), text)


def rfc3339(micros: Column, suffix: str = "+00:00") -> Column:
    """Text of an instant: whole seconds without fraction, else milli- or microseconds."""
    ts = F.timestamp_micros(micros)
    fraction = F.pmod(micros, F.lit(1_000_000).cast("bigint"))
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    digits = F.when(fraction == 0, "").when(fraction % 1000 == 0, F.format_string(".%03d", F.call_function("div", fraction, F.lit(1000).cast("bigint")))).otherwise(F.format_string(".%06d", fraction))
    return F.concat(base, digits, F.lit(suffix))
