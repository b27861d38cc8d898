"""Every query that has SQL, against it, on the smallest tables; the others must run."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    if isinstance(x, (int, float, Decimal)) or hasattr(x, "item"):
        return round(float(x), 9) + 0.0
    return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    rows = [dict(zip(names, r)) for r in cur.fetchall()]
    assert got == sorted(([plain(r[c]) for c in cols] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
