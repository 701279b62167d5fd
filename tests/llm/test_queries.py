import glob
import os

import duckdb
import pytest

from quarrybed.llm import queries
from quarrybed.llm.tokens import DEFAULT_VOCABULARY, count_tokens, token_sizes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.exists(DEFAULT_VOCABULARY), reason="no test tables")
FOUND = {"p1_found": "entry_id bigint,field_name string,pii_type string,pii_value string", "p2_found": "evidence_id bigint,first_usn bigint,last_usn bigint,event_count bigint", "p4_found": "entry_id bigint,line_no bigint", "p10_found": "doc_id bigint,text_class string"}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_over_whole_tables(spark, name):
    df = queries.queries()[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in FOUND:
        assert ",".join(f"{c} {t}" for c, t in df.dtypes) == FOUND[name]
        assert len(rows) == len(set(rows)) and not any(v is None for r in rows for v in r)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    res = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr)


def test_tokens(spark):
    assert count_tokens([None, "", "hello world", "<|endoftext|>"])[:3] == [0, 0, 2]
    df = spark.createDataFrame([(1, "hello world", "s", 5), (2, None, None, 5)], "doc_id bigint, text string, source string, n_tokens int")
    assert sorted(map(tuple, token_sizes(df, "doc_id", "text", ["source"]).collect())) == [(1, "s", 2), (2, None, 0)]
