"""Timestamps in many spellings, units and zones to one UTC instant in microseconds.

Spellings are brought to one canonical list of fields by column expressions. A value that carries its offset gives
the instant at once. A local time is joined as-of to the intervals in which a zone kept one offset, in local time:
these overlap where the clock was set back and leave a hole where it was set forward. They are exploded to
(zone, local year), so the join is an equality with a few candidates, and the number of intervals that hold the local
time decides: two mean that it is ambiguous and the earlier instant is taken; none means that it was skipped and is moved
forward by the length of the skip; one gives its offset directly.
"""

from __future__ import annotations

import struct
import zoneinfo
from collections.abc import Iterator
from datetime import UTC, datetime
from importlib.resources import files
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrybed.functions.text import let

#: Bare numbers count only if they lie in these years, the second not included.
FROM_S, TO_S = 946684800, 2208988800
#: Seconds from 1601 to 1970.
SHIFT_S = 11644473600
#: Local years with intervals of their own; the first and the last stand for all years before and after.
YEARS = (1900, 2100)
_FAR = 1 << 42

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(?: ?([+-]\d{2}:?\d{2}|[A-Za-z][A-Za-z0-9_+/-]*))?"
_WEEKDAY = r"(?:[A-Za-z]{3,9}\.?,? )?"
#: pattern, canonical order year|month|day|hour|minute|second|fraction|half|zone
_FORMS = (
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[Tt ]{_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^{_WEEKDAY}(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?[ -](\d{{4}}|\d{{2}}) {_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^{_WEEKDAY}([A-Za-z]{{3,9}}) (\d{{1,2}}) {_TIME}{_ZONE} (\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
    (rf"^{_WEEKDAY}([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}}),? (?:at )?{_TIME}(?: ?([AaPp])\.?[Mm]\.?)?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),? {_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
)
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_LONG = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def number_micros(n: Column) -> Column:
    """A bare whole number as microseconds since 1970: seconds, milliseconds or microseconds since 1970, or
    microseconds or 100 ns since 1601, whichever lies from 2000 up to 2040; the ranges do not overlap."""
    n = n.cast("bigint")

    def within(unit: int, shift: int) -> Column:
        return (n >= (FROM_S + shift) * unit) & (n < (TO_S + shift) * unit)

    return (
        F.when(within(1, 0), n * 1_000_000)
        .when(within(1_000, 0), n * 1_000)
        .when(within(1_000_000, 0), n)
        .when(within(1_000_000, SHIFT_S), n - SHIFT_S * 1_000_000)
        .when(within(10_000_000, SHIFT_S), _div(n - SHIFT_S * 10_000_000, 10))
    )


def _div(a: Column, b: int) -> Column:
    """Whole division of a positive number, in whole numbers."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def _rule_file(name: str) -> bytes:
    """The compiled rules of a zone, or b'' where none are found."""
    for root in (*zoneinfo.TZPATH, None):
        try:
            if root:
                return Path(root, name).read_bytes()
            return files("tzdata.zoneinfo").joinpath(name).read_bytes()
        except (OSError, ModuleNotFoundError):
            continue
    return b""


def _change_candidates(data: bytes) -> tuple[list[int], bool] | None:
    """The instants at which a zone's rules may change, and whether they go on changing every year after the last one.

    Public layout of compiled zone rules: the second block holds 64-bit instants, a rule for later years ends the file.
    """
    if data[:4] != b"TZif" or data[4:5] < b"2":
        return None
    at = 0
    for width in (4, 8):
        utc, std, leap, times, kinds, chars = struct.unpack(">6l", data[at + 20 : at + 44])
        first = at + 44
        at = first + times * (width + 1) + kinds * 6 + chars + leap * (width + 4) + std + utc
    return list(struct.unpack(f">{times}q", data[first : first + 8 * times])), b"," in data[at:]


def zone_changes(name: str) -> tuple[int, list[tuple[int, int]]]:
    """(offset at the beginning of ``YEARS``, [(instant, new offset), ..] until their end), in seconds.

    The rules' own instants are looked at where they can be read; the years after them, and zones whose rules cannot be
    read, are stepped through.
    """
    zone = zoneinfo.ZoneInfo(name)

    def offset(t: int) -> int:
        return int(datetime.fromtimestamp(t, zone).utcoffset().total_seconds())

    lo, hi = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in YEARS)
    known = _change_candidates(_rule_file(name))
    times = [t for t in known[0] if lo < t < hi] if known else []
    # yearly rules change twice a year, so a month's step misses none; without any rules changes may lie days apart
    start, step = (max([lo, *times]), 30 * 86400) if known else (lo, 5 * 86400)
    found = [t for t in times if offset(t) != offset(t - 1)]
    if known is None or known[1]:
        t, now = start, offset(start)
        while t < hi:
            then = offset(t + step)
            if then != now:
                a, b = t, t + step
                while b - a > 1:
                    mid = (a + b) // 2
                    a, b = (mid, b) if offset(mid) == now else (a, mid)
                found.append(b)
                now, t = offset(b), b
            else:
                t += step
    return offset(lo), [(t, offset(t)) for t in found]


def zone_intervals(name: str) -> list[tuple[int, int, int]]:
    """(from, to, offset): the stretches in which the zone kept one offset, from and to in seconds of its local time.

    Consecutive stretches overlap where the clock was set back and leave a hole where it was set forward. The first and
    the last one reach beyond all years.
    """
    first, changes = zone_changes(name)
    out, at, now = [], -_FAR, first
    for t, then in changes:
        out.append((at, t + now, now))
        at, now = t + then, then
    return [*out, (at, _FAR, now)]


def by_year(intervals: list[tuple[int, int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Each local year of ``YEARS`` with the intervals that reach into it or end or begin within two days of it, so that
    the one before a skip is there too."""
    margin, i = 2 * 86400, 0
    for y in range(YEARS[0], YEARS[1] + 1):
        lo = -_FAR if y == YEARS[0] else int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) - margin
        hi = _FAR if y == YEARS[1] else int(datetime(y + 1, 1, 1, tzinfo=UTC).timestamp()) + margin
        while intervals[i][1] < lo:
            i += 1
        k = i
        while k < len(intervals) and intervals[k][0] <= hi:
            k += 1
        yield y, intervals[i:k]


_TABLE = "seg_zone string, seg_year int, seg_intervals array<struct<lo: bigint, hi: bigint, off: bigint>>"


def _explode_zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("off", pa.int64())]))
    for batch in batches:
        for name in batch.column(0).to_pylist():
            years, lists = zip(*by_year(zone_intervals(name)))
            values = [[dict(zip(("lo", "hi", "off"), x)) for x in xs] for xs in lists]
            yield pa.RecordBatch.from_arrays([pa.array([name.lower()] * len(years)), pa.array(years, pa.int32()), pa.array(values, kind)], ["seg_zone", "seg_year", "seg_intervals"])


def zone_names() -> list[str]:
    return sorted(zoneinfo.available_timezones())


def zone_table(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The offset intervals of every zone of the IANA list by (zone in lower case, local year): about 600 zones x 201 years x
    one to four intervals, under 20 MB whatever the data."""
    names = zone_names() if names is None else names
    return spark.createDataFrame([(z,) for z in names], "zone string").repartition(min(16, max(1, len(names)))).mapInArrow(_explode_zones, _TABLE)


def _iana(name: str) -> Column:
    """The zone of the name in a column, in any case, in lower case; null if the IANA list has none of that name. Said in
    SQL, so that the list is one hashed set."""
    listed = ", ".join(f"'{z.lower()}'" for z in zone_names())
    return F.expr(f"CASE WHEN lower({name}) IN ({listed}) THEN lower({name}) END")


def parse(text: Column, abbreviations: dict[str, int]) -> Column:
    """Text to STRUCT<micros, local_micros, zone>: a stated instant, or a local time with the zone it names ('' for
    none), or all null. ``abbreviations`` maps upper-case letters to minutes."""
    # a month written in letters is its usual three letters or its whole name
    names = F.create_map(*[F.lit(x) for i, (a, b) in enumerate(zip(_MONTHS, _LONG)) for x in ((a, i + 1, b, i + 1) if a != b else (a, i + 1))], F.lit("sept"), F.lit(9))
    none = F.lit(None).cast("bigint")

    def canonical(s: Column) -> Column:
        canon = F.lit(None).cast("string")
        for pattern, order in reversed(_FORMS):
            canon = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, order)).otherwise(canon)
        return F.split(canon, r"\|")

    def local(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i))
        year = F.when(F.length(part(0)) == 2, part(0).try_cast("int") + 2000).otherwise(part(0).try_cast("int"))
        month = F.coalesce(part(1).try_cast("int"), F.try_element_at(names, F.lower(part(1))))
        day = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")).try_cast("date")
        clock = part(3).try_cast("int")
        half = F.pmod(clock, F.lit(12)) + F.when(F.lower(part(7)) == "p", 12).otherwise(0)
        hour = F.when(part(7) == "", clock).when((clock >= 1) & (clock <= 12), half)
        minute = part(4).try_cast("int")
        second = F.when(part(5) == "", 0).otherwise(part(5).try_cast("int"))
        micro = F.when(part(6) == "", 0).otherwise(F.rpad(F.substring(part(6), 1, 6), 6, "0").try_cast("bigint"))
        exists = (part(0) != "0000") & month.isNotNull() & (hour < 24) & (minute < 60) & (second < 60)
        return F.when(exists, (F.unix_date(day).cast("bigint") * 86400 + hour * 3600 + minute * 60 + second) * 1_000_000 + micro)

    def minutes(zone: Column) -> Column:
        digits = F.regexp_replace(zone, ":", "")
        h, m = F.substring(digits, 2, 2).try_cast("int"), F.substring(digits, 4, 2).try_cast("int")
        out = F.when(zone.rlike(r"^[+-]") & (h < 24) & (m < 60), F.when(zone.startswith("-"), -1).otherwise(1) * (h * 60 + m))
        if abbreviations:
            letters = F.create_map(*[F.lit(x) for kv in sorted(abbreviations.items()) for x in kv])
            out = F.coalesce(out, F.try_element_at(letters, F.upper(zone)))
        return out.cast("bigint")

    def written(p: Column) -> Column:
        zone = F.get(p, F.lit(8))

        def done(x: Column) -> Column:
            named = F.when(x.m.isNull(), zone)
            return F.struct((x.t - x.m * 60_000_000).alias("micros"), F.when(named.isNotNull(), x.t).alias("local_micros"), named.alias("zone"))

        return let(F.struct(local(p).alias("t"), minutes(zone).alias("m")), done)

    def bare(s: Column) -> Column:
        pattern = r"^(\d{1,19})(?:\.(\d+))?$"

        def count(x: Column) -> Column:
            seconds = F.when((x.n >= FROM_S) & (x.n < TO_S), x.n * 1_000_000 + F.rpad(F.substring(x.f, 1, 6), 6, "0").try_cast("bigint"))
            return F.struct(F.when(x.f == "", number_micros(x.n)).otherwise(seconds).alias("micros"), none.alias("local_micros"), F.lit(None).cast("string").alias("zone"))

        return let(F.struct(F.regexp_extract(s, pattern, 1).try_cast("bigint").alias("n"), F.regexp_extract(s, pattern, 2).alias("f")), count)

    def read(s: Column) -> Column:
        return F.when(s.rlike(r"^\d+(?:\.\d+)?$"), bare(s)).otherwise(let(canonical(s), written))

    return let(F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", " "), r"[\s\u00a0\u202f\u2009]+", " ")), read)


def resolve(df: DataFrame, value: Column, out: str, hints: list[Column], abbreviations: dict[str, int], numeric: bool = False, how: str | None = None, zones: DataFrame | None = None) -> DataFrame:
    """``df`` with BIGINT column ``out``: the UTC instant in microseconds that ``value`` states, or null.

    ``hints`` are zone names tried in order for a local time that names none itself; names that are no IANA zones
    are passed over. ``numeric`` values are bare numbers. ``how`` names a further column that says what the instant rests
    on: ``stated`` (a number, or an offset in the value), ``direct``, ``ambiguous`` or ``nonexistent`` (a local time in a zone).
    ``zones`` is the ``zone_table`` to join, so that several columns can share one.

    Defined results: null, blank and unreadable values, dates and times that do not exist, and local times without
    any known zone give null; a local time that came twice gives the earlier instant, one that was skipped is moved
    forward by the skip; fractions are cut after microseconds; rows are neither dropped nor multiplied; columns of
    ``df`` keep their names, helper columns start with ``__qb_`` and are removed.
    """
    if numeric:
        df = df.withColumn(out, number_micros(value))
        return df.withColumn(how, F.when(F.col(out).isNotNull(), "stated")) if how else df
    df = df.withColumn("__qb_p", parse(value, abbreviations))
    df = df.withColumns({f"__qb_h{i}": h for i, h in enumerate(hints)})
    hint = F.coalesce(*[_iana(f"__qb_h{i}") for i in range(len(hints))]) if hints else F.lit(None).cast("string")
    zone = F.when(F.col("__qb_p.zone") == "", hint).otherwise(_iana("__qb_p.zone"))
    local = F.col("__qb_p.local_micros")
    seconds = _div(local - F.pmod(local, F.lit(1_000_000)), 1_000_000)
    year = F.greatest(F.lit(YEARS[0]), F.least(F.lit(YEARS[1]), F.year(F.timestamp_micros(local))))
    df = df.withColumns({"__qb_zone": F.when(local.isNotNull(), zone), "__qb_at": seconds, "__qb_year": year})
    table = (zones if zones is not None else zone_table(df.sparkSession)).select(*[F.col(c).alias(f"__qb_{c}") for c in ("seg_zone", "seg_year", "seg_intervals")])
    joined = df.join(F.broadcast(table), (F.col("__qb_zone") == F.col("__qb_seg_zone")) & (F.col("__qb_year") == F.col("__qb_seg_year")), "left")
    at = F.col("__qb_at")
    holding = F.transform(F.filter("__qb_seg_intervals", lambda i: (at >= i.lo) & (at < i.hi)), lambda i: i.off)
    before = F.array_max(F.transform(F.filter("__qb_seg_intervals", lambda i: i.hi <= at), lambda i: F.struct(i.hi.alias("hi"), i.off.alias("off"))))
    joined = joined.withColumn("__qb_offsets", holding).withColumn("__qb_n", F.size("__qb_offsets"))
    # the greater of two offsets gives the earlier instant; a skipped time keeps the offset before the skip
    offset = F.when(F.col("__qb_n") > 0, F.array_max("__qb_offsets")).when(F.col("__qb_n") == 0, before.off)
    joined = joined.withColumn(out, F.coalesce(F.col("__qb_p.micros"), local - offset * 1_000_000))
    if how:
        kind = F.when(F.col("__qb_p.micros").isNotNull(), "stated").when(F.col("__qb_n") == 2, "ambiguous").when(F.col("__qb_n") == 1, "direct").otherwise("nonexistent")
        joined = joined.withColumn(how, F.when(F.col(out).isNotNull(), kind))
    return joined.drop(*[c for c in joined.columns if c.startswith("__qb_")])
