import json

from quarrybed.operators.nested import flatten_distinct, flatten_records, read_table, write_tables

CASES = [
    '{"a": {"b": [{"x": 1}, null, {"c": [3, {"d": "é"}]}]}}',
    json.dumps('{"items": {"k": 1, "members": {"n": 2, "plain": {"q": [1, 2]}}}}'),
    '[{"z": 1}, [{"y": 2}]]',
    '{"cut": [{"a": 1}', "", None, "null", "17", '"text"', '{"n": NaN}', '{"deep": []}',
    '\n {"volumes": [], "streams": {"extents": {"s": 1}}} ',
]


def test_items(spark):
    df = spark.createDataFrame([(i, c, "x") for i, c in enumerate(CASES)] + [(0, CASES[0], "again")], "id bigint, j string, payload string")
    got = sorted((r.record_id, r.item_path, r.parent_path, r.table_tag) for r in flatten_distinct(df, "id", "j").collect())
    assert got == [
        (0, "a.b[0]", "", "a.b"), (0, "a.b[2]", "", "a.b"), (0, "a.b[2].c[1]", "a.b[2]", "a.b.c"),
        (1, "items[0]", "", "items"), (1, "items[0].members[0]", "items[0]", "items.members"),
        (2, "[0]", "", ""), (2, "[1][0]", "", ""),
        (11, "streams[0]", "", "streams"), (11, "streams[0].extents[0]", "streams[0]", "streams.extents"),
    ]
    assert flatten_records(df.where("false"), "id", "j").count() == 0


def test_very_deep_and_very_long(spark):
    deep = '{"a":' * 300 + '[{"x":1}]' + "}" * 300
    long_ = json.dumps({"a": [{"t": "y" * 200_000}] * 20})
    df = spark.createDataFrame([(1, deep), (2, long_), (None, '{"a": [{}]}')], "id bigint, j string")
    got = flatten_records(df, "id", "j").groupBy("record_id").count().collect()
    assert {r[0]: r[1] for r in got} == {1: 1, 2: 20, None: 1}


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"m": [{"name": "a", "size": 3, "m": [{"name": "b"}]}]}')], "id bigint, j string")
    write_tables(flatten_records(df, "id", "j"), str(tmp_path / "t"))
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "t"), "m", "name string, size bigint").collect()] == [(1, "m[0]", "", "a", 3)]
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "t"), "m.m", "name string, size bigint").collect()] == [(1, "m[0].m[0]", "m[0]", "b", None)]
