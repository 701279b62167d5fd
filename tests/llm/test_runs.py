import random

from pyspark.sql import functions as F

from quarrybed.llm.runs import collapse_runs, collapse_similar

SCHEMA = "e bigint, f bigint, o bigint, s bigint, t bigint, k0 string, n string"


def brute(rows, gap):
    out, by = [], {}
    for e, f, o, s, t, *_ in rows:
        if None not in (e, f, o):
            by.setdefault((e, f), {})[o] = (s, t)
    for key, events in by.items():
        cur = None
        for o in sorted(events):
            s, t = events[o]
            near = cur and not (t is not None and cur["t"] is not None and abs(t - cur["t"]) > gap)
            if cur and s is not None and cur["s"] == s and near:
                cur.update(last=o, n=cur["n"] + 1, t=t, known=[*cur["known"], *([t] if t is not None else [])])
            else:
                cur = {"s": s, "first": o, "last": o, "n": 1, "t": t, "known": [t] if t is not None else []}
                out.append((key, cur))
    return sorted((*k, c["first"], c["last"], c["n"], c["known"][0] if c["known"] else None, c["known"][-1] if c["known"] else None) for k, c in out if c["n"] > 1)


def run(spark, rows, gap=10):
    df = spark.createDataFrame(rows, SCHEMA)
    r = collapse_runs(df, [F.col("e"), F.col("f")], F.col("o"), F.col("s"), F.col("t"), gap)
    key = lambda x: tuple((v is None, v) for v in x)
    return sorted([tuple(x) for x in r.select("k0", "k1", "first_order", "last_order", "event_count", "first_ticks", "last_ticks").collect()], key=key)


def test_against_brute_force_with_one_hot_entity(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(5), 1 if rng.random() < 0.4 else rng.randrange(3), o, rng.choice([1, 1, 1, 2, None]), rng.choice([None, o * 4 + rng.randrange(9), o * 4, o * 90]), "x", None) for o in range(3000)]
    rows += rng.sample(rows, 200)  # repeated deliveries
    key = lambda x: tuple((v is None, v) for v in x)
    assert run(spark, rows) == sorted(brute(rows, 10), key=key)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, 1, 1, 1, "", ""), (1, None, 1, 1, 1, "", ""), (1, 1, None, 1, 1, "", ""), (1, 1, 1, None, 1, "", ""), (1, 1, 2, None, 1, "", "")]) == []
    assert run(spark, [(1, 1, 1, 5, None, "", ""), (1, 1, 2, 5, 100, "", ""), (1, 1, 3, 5, None, "", ""), (1, 1, 4, 5, 900, "", "")]) == [(1, 1, 1, 4, 4, 100, 900)]


def brute_similar(rows, gap, bits, least=2):
    out, by = [], {}
    for e, f, o, s, t, *_ in rows:
        if None not in (e, f, o):
            by.setdefault((e, f), {})[o] = (s, t)
    for key, events in by.items():
        cur = None
        for o in sorted(events):
            s, t = events[o]
            near = cur and not (t is not None and cur["t"] is not None and abs(t - cur["t"]) > gap)
            if near and s is not None and cur["s"] is not None and (s ^ cur["s"]).bit_count() <= bits:
                cur.update(last=o, n=cur["n"] + 1, t=t)
            else:
                cur = {"s": s, "first": o, "last": o, "n": 1, "t": t}
                out.append((key, cur))
    return {(*k, c["s"], c["first"], c["last"], c["n"]) for k, c in out if c["n"] >= least}


def similar(spark, rows, gap, bits, least=2):
    r = collapse_similar(spark.createDataFrame(rows, SCHEMA), [F.col("e"), F.col("f")], F.col("o"), F.col("s"), F.col("t"), gap, bits, least)
    return [tuple(x) for x in r.select("k0", "k1", "state", "first_order", "last_order", "event_count").collect()]


def test_near_identical_events(spark):
    # 5 = 101, 4 = 100, 7 = 111 are one bit from 5; 6 = 110 is one bit from 4 and 7 but two from the anchor
    assert sorted(similar(spark, [(1, 1, i, s, None, "", "") for i, s in enumerate([5, 4, 7, 6, 7, 5])], 10, 1)) == [(1, 1, 5, 0, 2, 3), (1, 1, 6, 3, 4, 2)]
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.7 else rng.randrange(3), 1, o, rng.choice([1, 1, 3, 2, 7, 5, None] if rng.random() < 0.5 else [1, 3, 5]), rng.choice([None, o * 4, o * 4 + rng.randrange(9), o * 90]), "x", None) for o in range(3000)]
    rows += rng.sample(rows, 100)
    for bits, least in ((1, 2), (2, 2), (0, 2), (1, 1)):
        got = similar(spark, rows, 10, bits, least)
        assert len(got) == len(set(got)) and set(got) == brute_similar(rows, 10, bits, least)
    assert similar(spark, [], 10, 1) == []


def test_single_events_are_kept_if_asked_for(spark):
    rows = [(1, 1, o, o % 7 // 5, None, "", "") for o in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    r = collapse_runs(df, [F.col("e")], F.col("o"), F.col("s"), F.col("t"), 10, 1)
    assert sum(x.event_count for x in r.collect()) == 500
    singles = collapse_runs(df, [F.col("e")], F.col("o"), F.col("o"), F.col("t"), 10, 1)
    assert singles.count() == 500
