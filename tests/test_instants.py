from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrybed.operators import instants
from quarrybed.operators.instants import by_year, resolve, zone_intervals

LETTERS = {"EST": -300, "CEST": 120, "UT": 0}


def micros(*a, tz=timezone.utc):
    return int(datetime(*a, tzinfo=tz).timestamp()) * 1_000_000


CASES = [
    ("1487639725", None, 1487639725000000),
    (" 1487898362 ", None, 1487898362000000),
    ("1487646091.25", None, 1487646091250000),
    ("1487639725000", None, 1487639725000000),
    ("131321134820000009", None, (131321134820000009 - 116444736000000000) // 10),
    ("13239273192864000", None, 13239273192864000 - 11644473600000000),
    ("0", None, None), ("-1", None, None), ("9223372036854775807", None, None), ("99999999999999999999", None, None), ("2208988800", None, None),
    ("2017-02-15T13:23:37.0009+05:45", None, micros(2017, 2, 15, 7, 38, 37) + 900),
    ("20170212T185300Z", None, None if "Z" in LETTERS else None),
    ("Sat, 01 Mar 2025 02:27:19 +0900", None, micros(2025, 2, 28, 17, 27, 19)),
    ("Sun, 11 Jun 2023 04:20:18 est", None, micros(2023, 6, 11, 9, 20, 18)),
    ("15 Dec 24 17:01 UT", None, micros(2024, 12, 15, 17, 1)),
    ("Wed, 23 Apr 2025 15:26:18 +0530 (IST)", None, micros(2025, 4, 23, 9, 56, 18)),
    ("28 Mar 2019 01:19 -0000", None, micros(2019, 3, 28, 1, 19)),
    ("06.05.2019 12:37", "UTC", micros(2019, 5, 6, 12, 37)),
    ("Mar 30, 2022, 3:05:22 PM", "UTC", micros(2022, 3, 30, 15, 5, 22)),
    ("Mar 30, 2022, 12:05:22 AM", "UTC", micros(2022, 3, 30, 0, 5, 22)),
    ("Fri Oct  9 08:08:04 2020", "Asia/Tokyo", micros(2020, 10, 8, 23, 8, 4)),
    ("2018-08-17 09:29:06 America/Chicago", "Asia/Tokyo", micros(2018, 8, 17, 14, 29, 6)),
    # twice: the earlier; skipped: moved forward
    ("2022-11-06 01:30:00", "America/New_York", micros(2022, 11, 6, 5, 30)),
    ("2022-03-13 02:59:10", "America/New_York", micros(2022, 3, 13, 7, 59, 10)),
    ("0000-00-00 00:00:00", "UTC", None), ("31 Feb 2020 10:00:00 +0000", None, None), ("2020-01-01T25:00:00Z", None, None), ("2020-01-01 10:00:60", "UTC", None),
    ("2020-01-01 10:00:00", None, None), ("2020-01-01 10:00:00", "No/Zone", None), ("1 Jan 2020 10:00 XYZ", "UTC", None), ("2020-01-01", "UTC", None),
    ("", "UTC", None), ("   ", "UTC", None), (None, "UTC", None), ("N/A", "UTC", None), ("(no date)", "UTC", None), ("x" * 50_000, "UTC", None),
]


def test_cases_with_clashing_columns(spark):
    rows = [(i, v, z, "keep", 7) for i, (v, z, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, v string, z string, seg_zone string, zone int")
    got = resolve(df, F.col("v"), "us", [F.col("z")], LETTERS)
    assert got.columns == ["i", "v", "z", "seg_zone", "zone", "us"]
    found = {r.i: r.us for r in got.collect()}
    assert len(found) == len(CASES)
    for i, (v, z, want) in enumerate(CASES):
        assert found[i] == want, (v, z, want, found[i])


def test_numbers_and_empty(spark):
    df = spark.createDataFrame([(1594567890123,), (None,), (-1,), (116444736000000001,)], "v bigint")
    assert [r.us for r in resolve(df, F.col("v"), "us", [], {}, numeric=True).collect()] == [1594567890123000, None, None, None]
    empty = spark.createDataFrame([], "v string")
    assert resolve(empty, F.col("v"), "us", [], {}).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["America/New_York", "Australia/Sydney", "Europe/Lisbon", "Asia/Kolkata", "Africa/Casablanca", "America/Sao_Paulo", "Pacific/Apia"]), st.integers(0, 4_000_000_000))
def test_intervals_agree_with_the_zone(name, second):
    when = datetime.fromtimestamp(second, timezone.utc).replace(tzinfo=None)
    zone, intervals = ZoneInfo(name), years(name)[when.year]
    hits = [off for lo, hi, off in intervals if lo <= second < hi]
    # an offset is possible if it leads to an instant whose local time is this one
    possible = {o for o in {when.replace(tzinfo=zone, fold=f).utcoffset().total_seconds() for f in (0, 1)} if datetime.fromtimestamp(second - o, zone).replace(tzinfo=None) == when}
    assert sorted(hits) == sorted(possible)
    before = max((hi, off) for lo, hi, off in intervals if hi <= second)[1] if not hits else max(hits)
    assert before == zone.utcoffset(when.replace(fold=0)).total_seconds()


_cache = {}


def years(name):
    return _cache.setdefault(name, dict(by_year(zone_intervals(name))))


def test_rules_that_cannot_be_read_are_stepped_through(monkeypatch):
    want = zone_intervals("America/New_York")
    monkeypatch.setattr(instants, "_rule_file", lambda name: b"")
    assert zone_intervals("America/New_York") == want


def test_number_of_intervals_decides(spark):
    rows = [(1, "2022-11-06 01:30:00"), (2, "2022-03-13 02:59:10"), (3, "2022-07-01 00:00:00"), (4, "2022-07-01 00:00:00 +0100"), (5, "1487639725"), (6, "never"), (7, None)]
    df = spark.createDataFrame(rows, "i int, v string")
    got = {r.i: r.how for r in resolve(df, F.col("v"), "us", [F.lit("america/NEW_YORK")], LETTERS, how="how").collect()}
    assert got == {1: "ambiguous", 2: "nonexistent", 3: "direct", 4: "stated", 5: "stated", 6: None, 7: None}
