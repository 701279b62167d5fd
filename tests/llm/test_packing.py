import random
from collections import defaultdict

import numpy as np
import pytest

from quarrybed.llm.packing import fill_report, pack, sum_of_squares


def test_online_choice_is_the_least_sum_of_squares():
    rng = random.Random(6)
    for cap in (10, 37):
        sizes = [rng.randrange(1, cap + 1) for _ in range(200)]
        bins = sum_of_squares(np.array(sizes), cap)
        fill, count = defaultdict(int), defaultdict(int)
        for s, b in zip(sizes, bins.tolist()):
            def after(level, count=count, s=s):
                c = dict(count)
                if level:
                    c[level] -= 1
                if level + s < cap:
                    c[level + s] = c.get(level + s, 0) + 1
                return sum(v * v for v in c.values())
            options = [lv for lv, n in count.items() if n > 0 and lv + s <= cap] + [0]
            assert after(fill[b]) == min(map(after, options))
            if fill[b]:
                count[fill[b]] -= 1
            fill[b] += s
            if fill[b] < cap:
                count[fill[b]] += 1
        assert max(fill.values()) <= cap and sum(fill.values()) == sum(sizes)


@pytest.mark.parametrize("n", [0, 1, 700])
def test_whole_texts_and_capacity(spark, n):
    rng = random.Random(7)
    sizes = {i: rng.choice([0, 1, 5, 40, 99, 100, 101, 730]) for i in range(n)}
    df = spark.createDataFrame([(i, s, "x", 3) for i, s in sizes.items()] + ([(n, None, "x", 3), (None, 7, "x", 3)] if n > 1 else []), "doc_id bigint, n_tokens bigint, container_kind string, shard int")
    specs = [("a", 100, 0), ("b", 100, 3), ("c", None, 0), ("d", 0, 1)]
    rows = pack(df, specs).collect()
    want = {**sizes, **({n: 0, None: 7} if n > 1 else {})}
    for kind, sep in (("a", 0), ("b", 3)):
        mine = [r for r in rows if r.container_kind == kind]
        by_doc, by_bin = defaultdict(list), defaultdict(list)
        for r in mine:
            by_doc[r.doc_id].append(r)
            by_bin[r.container_id].append(r)
        assert set(by_doc) == set(want)
        for d, parts in by_doc.items():
            parts.sort(key=lambda r: r.part_no)
            assert sum(r.n_tokens for r in parts) == want[d] and [r.first_token for r in parts] == [100 * i for i in range(len(parts))]
            assert len(parts) == 1 if want[d] <= 100 else len(parts) == -(-want[d] // 100)
        for items in by_bin.values():
            assert sum(r.n_tokens for r in items) + sep * (len(items) - 1) <= 100
            assert sorted(r.slot for r in items) == list(range(len(items)))
    assert {r.container_kind for r in rows} <= {"a", "b"}
    if n > 1:
        assert all(r.fill_share > 0.9 for r in fill_report(pack(df, specs[:2]), specs[:2]).collect())
