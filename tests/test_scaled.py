"""Operators that work on pieces, compared with brute force on the whole."""

import random

import pytest
from pyspark.sql import functions as F

from quarrybed.functions import json
from quarrybed.operators import activities, carving, records, search


def test_segments_against_whole_parts(spark):
    rng = random.Random(11)
    parts, rows = {}, []
    for e in range(60):
        for p in ("a", None):
            pieces = ["".join(rng.choice("abX ") for _ in range(rng.choice([0, 1, 1, 2, 3, 9]))) for _ in range(rng.randrange(1, 40))]
            hole = rng.randrange(len(pieces)) if rng.random() < 0.4 else None
            for i, text in enumerate(pieces):
                if i != hole:
                    rows.append((e, "x", p, i, text))
            parts[e, p] = ["".join(pieces[:hole]), "".join(pieces[hole + 1 :])] if hole is not None else ["".join(pieces)]
    rows += rng.sample(rows, 50) + [(99, "x", "n", 0, None), (None, "x", "a", 0, "abx")]
    df = spark.createDataFrame(rows, "entry_id bigint, parser_name string, part_name string, segment_index int, content string")
    for query in ("ABx", "b", "x ab", "   "):
        q = query.lower()
        # a part's text goes on past an empty segment only if that has a number of its own
        want = {e for (e, _), texts in parts.items() if any(q in t.lower() for t in texts)}
        got = [r.entry_id for r in search.segment_hits(df, query).collect()]
        assert len(got) == len(set(got))
        found = set(got) - {None}
        empties = {r[0] for r in rows if r[4] == ""}
        assert found - empties == want - empties and found <= want


@pytest.mark.parametrize("size", [16, 37, 4096])
def test_carving_in_chunks(spark, size):
    rng = random.Random(size)
    bits = [b"\xff\xd8\xff", b"\xff\xd9", b"GIF8", b"\x00\x3b", b"\x89PNG\r\n\x1a\n", b"IEND", b"BM\x1e\x00\x00\x00", b"BM", b"%PDF-", b"%%EOF", b"PK\x03\x04", b"zz", b"\0", b"Rar!\x1a\x07", b"\x1f\x8b\x08"]
    streams = [(i, b"".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(40)] + [(100, None), (101, b"")]
    df = spark.createDataFrame(streams, "source_id bigint, bytes binary")
    got = sorted((r.source_id, r.offset, r.length, r.extension, r.label, r.basis, r.definitive) for r in carving.carve(df, size).collect())
    assert got == sorted((i, *hit) for i, data in streams for hit in carving.carve_bytes(data or b""))


def test_gaps_in_chunks(spark):
    ntfs = bytearray(512)
    ntfs[3:7], ntfs[510:512] = b"NTFS", b"\x55\xaa"
    data = bytes(1024) + bytes(ntfs) + bytes(512) + b"\0" * 1080 + b"\x53\xef" + bytes(1000)
    df = spark.createDataFrame([(1, data), (2, None)], "source_id bigint, bytes binary")
    want = [(1024, "ntfs"), (2048, "ext")]
    for size in (512, 1024, 1 << 20):
        assert sorted((r.offset, r.file_system) for r in carving.lost_file_systems(df, size=size).collect()) == want
    chunks = search.chunked(df, 512, carving.FS_REACH)
    assert [r.offset for r in carving.lost_in_chunks(chunks, accept=lambda s, at, name: name == "ext").collect()] == [2048]


def test_range_join_against_brute_force(spark):
    rng = random.Random(3)
    spans = [(i, rng.randrange(0, 1 << rng.choice([4, 12, 40])), rng.choice([0, -5, 1, 7, 300, 1 << 20, 1 << 41, None])) for i in range(60)]
    points = [(k, rng.randrange(1 << rng.choice([4, 12, 40]))) for k in range(300)] + [(900, None), (901, 5), (901, 5)]
    p, i = spark.createDataFrame(points, "k int, x bigint"), spark.createDataFrame(spans, "n int, lo bigint, size bigint")
    got = sorted((r.k, r.x if r.x is not None else -1, r.n if r.n is not None else -1) for r in records.interval_of(p, "x", i, "lo", "size", "n").collect())
    holds = lambda x: min((n for n, lo, size in spans if x is not None and size and lo <= x < lo + size), default=-1)
    assert got == sorted((k, x if x is not None else -1, holds(x)) for k, x in points)
    assert records.interval_of(p, "x", i.where("false"), "lo", "size", "n").where("n is null").count() == len(points)


def test_bounded_chains_and_null_groups(spark):
    rows = [(k, o, f"v{o}{j}") for k in (1, None) for o in range(50) for j in range(2)]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    for r in records.ordered_chain(df, ["k"], "v", "o", 3).collect():
        assert (r.chain, r.first_value, r.last_value, r.total, r.omitted) == (["v00", "v01", "v10"], "v00", "v491", 100, 97)
    assert records.ordered_chain(df, ["k"], "v", "o", 3).count() == 2 and records.bounded_listing(df, ["k"], ["o", "v"], 3).count() == 6
    page = records.offset_page(df.where("k = 1"), ["o", "v"], 10, 4).collect()
    assert [r.v for r in page] == ["v50", "v51", "v60", "v61"] and records.offset_page(df, ["o"], 198, None).count() == 2


def test_json_edges(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}', '{"b": [1]}', '["q"]'), (None, "broken", None), ("[1]", None, "{}")], "a string, b string, l string")
    a, b = F.col("a"), F.col("b")
    got = df.select(json.merged(a, b).alias("m"), json.with_value(a, "c", F.lit("v")).alias("w"), json.appended(F.col("l"), F.lit("z")).alias("p"), json.lenient_number(a, "a").alias("n"), json.first_of(a, "zz", "b").alias("f")).collect()
    assert [r.m for r in got] == ['{"a":"1","b":"[1]"}', "{}", "{}"] and [r.w for r in got] == ['{"a":"1","b":"x","c":"v"}', '{"c":"v"}', '{"c":"v"}']
    assert [r.p for r in got] == ['["q","z"]', '["z"]', '["z"]'] and [r.n for r in got] == [1, None, None] and [r.f for r in got] == ["x", None, None]


def test_activity_edges(spark):
    rows = [(1, 6, "[]", "1", None, None, "9" * 30, ' {"displayText": 7, "activationUrl": "u", "activeDurationSeconds": 12}'), (2, None, None, None, None, None, None, "[1]"), (3, 99, "plain", "x", "", "0", "-1", None)]
    df = spark.createDataFrame(rows, "entry_id bigint, activity_type bigint, app_id string, start_time string, end_time string, last_modified_time string, expiration_time string, payload string")
    got = {r.entry_id: r for r in activities.activity_records(df).collect()}
    assert (got[1].display_text, got[1].activation_uri, got[1].active_seconds, got[1].start_micros, got[1].expires_micros) == (None, "u", 12, 1_000_000, None)
    assert (got[2].readable, got[2].type_name, got[3].type_name, got[3].application) == (False, None, "Type 99", "plain")
    assert {r.activity_type: r.records for r in activities.type_counts(df).collect()} == {6: 1, -1: 1, 99: 1}
