import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrybed.llm.mixing import exact_total, mix, plan_mix, share_report, water_fill


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.floats(0.01, 1), st.integers(0, 5)), min_size=1, max_size=6), st.floats(1, 20_000))
def test_water_filling_is_feasible_and_fair(specs, total):
    tokens, caps = {str(i): t for i, (t, _, _) in enumerate(specs)}, {str(i): c for i, (_, _, c) in enumerate(specs)}
    weight = sum(w for _, w, _ in specs)
    targets = {str(i): w / weight for i, (_, w, _) in enumerate(specs)}
    given_ = water_fill(tokens, targets, caps, total)
    most = {s: tokens[s] * caps[s] for s in targets}
    assert all(-1e-6 <= given_[s] <= most[s] + 1e-6 for s in targets)
    assert abs(sum(given_.values()) - min(total, sum(most.values()))) < 1e-3
    free = [s for s in targets if given_[s] < most[s] - 1e-6]
    # sources that are not clamped keep the proportions of their targets, and none of them gets less than its target
    assert len({round(given_[s] / targets[s], 3) for s in free}) <= 1
    assert all(given_[s] >= targets[s] * min(total, sum(most.values())) - 1e-3 for s in free)


def sizes_of(spark):
    rng = random.Random(8)
    rows = [(i, "big" if i % 3 else "small", rng.randrange(1, 50), "x", 1) for i in range(3000)] + [(9001, None, 5, "x", 1), (9002, "other", 5, "x", 1), (9003, "small", 0, "x", 1), (9004, "small", None, "x", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, b string, h int")


def test_shares_caps_and_seed(spark):
    sizes = sizes_of(spark)
    specs = [("big", 0.5, 2), ("small", 0.5, 3), ("absent", 0.0, 1)]
    plan = plan_mix(sizes, specs)
    got = mix(sizes, plan).collect()
    assert len(got) == 3002 and max(r.repeats for r in got if r.source == "small") <= 3
    rows = {r.source: r for r in share_report(mix(sizes, plan), plan).collect()}
    assert abs(rows["big"].share - 0.5) < 0.002 and rows["small"].most_repeats == 3
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(sizes, plan).collect()))
    assert sorted(map(tuple, got)) != sorted(map(tuple, mix(sizes, plan, seed=1).collect()))
    assert {r.repeats for r in got if r.doc_id in (9003, 9004)} == {3}


def test_clamped_total_and_empty(spark):
    sizes = sizes_of(spark)
    specs = [("big", 0.1, 1), ("small", 0.9, 2)]
    plan = plan_mix(sizes, specs, total=1e9)
    assert all(r.repeats == (1 if r.source == "big" else 2) for r in mix(sizes, plan).collect())
    none = sizes.where("false")
    assert mix(none, plan_mix(none, specs)).count() == 0 and mix(sizes, plan_mix(sizes, [])).count() == 0
    assert exact_total({}, {}, {}) == 0.0
    # sources that can give nothing have no say in the size of the mixture
    assert exact_total({"a": 10}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}) == 20.0 and exact_total({"a": 10, "b": 3}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 0}) == 20.0
