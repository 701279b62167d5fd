import random

from quarrybed.operators.hierarchy import build_trees, descendants

SCHEMA = "t bigint, v string, p string, name string, path string, chain int"


def brute(rows):
    last = {(t, v): (None if p == v else p, n or "") for t, v, p, n, *_ in rows if t is not None and v is not None}
    out, pairs = [], []
    for t, v in last:
        names, seen, x, above = [], set(), v, []
        while True:
            if (t, x) not in last or last[t, x][0] is None:
                out.append((t, v, x, len(names), "/".join(reversed(names))))
                pairs += [(t, a, v, i + 1) for i, a in enumerate(above) if (t, a) in last]
                break
            if x in seen:
                out.append((t, v, "", -1, ""))
                break
            seen.add(x)
            names.append(last[t, x][1])
            x = last[t, x][0]
            above.append(x)
    return sorted(out), sorted(pairs)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    trees = build_trees(df)
    return sorted(tuple(r) for r in trees.select("t", "v", "root", "depth", "path").collect()), sorted(tuple(r) for r in descendants(trees, df).collect())


def test_forest_with_chains_cycles_and_a_hot_parent(spark):
    rng = random.Random(3)
    rows = [(1, f"n{i}", f"n{rng.randrange(max(1, i // 2), i)}" if i > 1 else "root", f"f{i}", "x", 0) for i in range(1, 120)]
    rows += [(1, f"h{i}", "n5", f"h{i}", "x", 0) for i in range(60)]  # a third below one node
    rows += [(2, f"c{i}", f"c{(i + 1) % 4}", "c", "", 0) for i in range(4)] + [(2, "below", "c0", "b", "", 0), (2, "self", "self", "s", "", 0), (2, "kid", "self", None, "", 0), (2, "n5", None, "r", "", 0)]
    rows += [(3, f"d{i}", f"d{i - 1}" if i else "gone", f"x{i}", "", 0) for i in range(37)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == ([], [])
    rows = [(None, "a", "b", "x", "", 0), (1, None, "b", "x", "", 0), (1, "a", "a", "x", "", 0)]
    assert run(spark, rows) == ([(1, "a", "a", 0, "")], [])


def test_subtree_sizes(spark):
    df = spark.createDataFrame([(1, "a", None, "a", "", 0), (1, "b", "a", "b", "", 0), (1, "c", "b", "c", "", 0), (1, "d", "a", "d", "", 0)], SCHEMA)
    assert {r.v: (r.subtree, r.chain, r.chain_pos) for r in build_trees(df).collect()} == {"a": (4, "a", 0), "b": (2, "a", 1), "c": (1, "a", 2), "d": (1, "d", 0)}
