import random

from pyspark.sql import functions as F

from quarrybed.operators.periods import gaps_between, merge_spans

SCHEMA = "k bigint, s bigint, e bigint, lo string, level int"


def brute(rows):
    by = {}
    for k, s, e, *_ in rows:
        if None not in (k, s, e) and s < e:
            by.setdefault(k, []).append((s, e))
    periods, gaps = [], []
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        periods += [(k, *m) for m in merged]
        gaps += [(k, a[1], b[0]) for a, b in zip(merged, merged[1:]) if b[0] - a[1] <= 5_000_000]
    return sorted(periods), sorted(gaps)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    p = merge_spans(df, [F.col("k")], F.col("s"), F.col("e"))
    return sorted(tuple(r) for r in p.collect()), sorted(tuple(r) for r in gaps_between(p, ["u0"], 5_000_000).collect())


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(1500):
        k = 1 if rng.random() < 0.5 else rng.randrange(4)
        s = rng.randrange(1_500_000_000_000_000, 1_500_000_400_000_000)
        rows.append((k, s, s + rng.choice([1, 7, 1000, 300_000, 40_000_000]) * rng.randrange(1, 3), "x", 1))
    # long ones over many cells, touching and nested ones, one before 1970
    rows += [(9, 0, 1 << 40, "", 0), (9, 1 << 40, (1 << 40) + 5, "", 0), (9, (1 << 40) + 6, (1 << 41) + 3, "", 0), (9, 5, 6, "", 0), (8, -(1 << 38) - 3, -1, "", 0), (8, -1, 4, "", 0)]
    assert run(spark, rows + rows[:50]) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == ([], [])
    assert run(spark, [(None, 1, 2, "", 0), (1, None, 2, "", 0), (1, 1, None, "", 0), (1, 2, 2, "", 0), (1, 3, 2, "", 0)]) == ([], [])
    assert run(spark, [(1, 1, 2, "", 0), (1, 2, 3, "", 0), (1, 4, 5, "", 0)]) == ([(1, 1, 3), (1, 4, 5)], [(1, 3, 4)])
