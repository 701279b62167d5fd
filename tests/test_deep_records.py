import json
import random

import pytest

from quarrybed.operators.nested import LIST_KEYS, flatten_records, read_deep, read_record, visit

DEPTH = 30_000


def test_deeper_than_the_parser(spark):
    keyed = '{"a":' * DEPTH + '[{"x":1}]' + "}" * DEPTH
    listed = "[" * DEPTH + '{"x":[1,{"y":2}]}' + "]" * DEPTH
    plain = '{"m":[' + '{"p":' * DEPTH + '"é"' + "}" * DEPTH + "]}"
    rows = [(1, keyed), (2, listed), (3, plain), (4, keyed[:-1]), (5, json.dumps(listed))]
    got = {(r.record_id, r.item_path): r for r in flatten_records(spark.createDataFrame(rows, "id bigint, j string"), "id", "j").collect()}
    at = "[0]" * DEPTH
    assert set(got) == {(1, ".".join("a" * DEPTH) + "[0]"), (2, at), (2, at + ".x[1]"), (3, "m[0]"), (5, at), (5, at + ".x[1]")}
    assert got[2, at + ".x[1]"].parent_path == at and got[3, "m[0]"].payload == '{"p": ' * DEPTH + '"é"' + "}" * DEPTH


def test_same_as_the_parser():
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind > 5:
            return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 6 else {rng.choice('aé"\\ '): value(depth - 1) for _ in range(rng.randrange(4))}
        return (None, True, False, rng.randrange(-9, 10**20), rng.uniform(-1e9, 1e9), 'q"\\\n😀')[kind]

    for _ in range(400):
        v = value(5)
        text = json.dumps(v, indent=rng.choice((None, 1)), ensure_ascii=rng.random() < 0.5)
        assert read_deep(text) == v
        cut = text[: rng.randrange(len(text) + 1)] + rng.choice(("", ",", "]", "}", "1", '"'))
        try:
            want = json.loads(cut)
        except ValueError:
            with pytest.raises(ValueError):
                read_deep(cut)
        else:
            assert read_deep(cut) == want
    for bad in ("", "NaN", "-Infinity", "[1,]", '{"a":1,}', "01", "1.", "[1 2]", '{"a" 1}', "{1:2}", "tru", "-", '"\n"', "[}"):
        with pytest.raises(ValueError):
            read_deep(bad)
    assert read_deep('{"a":1,"a":2}') == {"a": 2} and list(visit(read_record("[[]]"), frozenset(LIST_KEYS))) == []
