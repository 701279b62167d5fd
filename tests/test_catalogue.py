"""Every query with SQL agrees with it on small data; every query runs and has a stable schema."""

import glob
import os

import duckdb
import pytest

from quarrybed.plans import catalogue, problems

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def same(v):
    return round(v, 6) if isinstance(v, float) else v


ALL = {**problems.queries(), **catalogue.queries()}
SQL = {**problems.oracle_sql(), **catalogue.oracle_sql()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, db, name):
    df = ALL[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = db.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(same(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_every_catalogue_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_others_give_rows(spark, name):
    assert ALL[name](spark, DATA).count() > 0


def test_found_columns(spark):
    want = {
        "p3_found": "source_table string,entry_id bigint,epoch_micros bigint",
        "p5_found": "evidence_id bigint,node_ref string,root_ref string,depth bigint,full_path string",
        "p6_found": "entry_id bigint,parent_path string,item_path string",
        "p7_found": "evidence_id bigint,app_id string,period_kind string,start_micros bigint,end_micros bigint",
    }
    for name, cols in want.items():
        df = problems.queries()[name](spark, DATA)
        assert ",".join(f"{c} {t}" for c, t in df.dtypes) == cols
        rows = df.collect()
        assert rows and len(rows) == len(set(rows)) and not any(v is None for r in rows for v in r)
