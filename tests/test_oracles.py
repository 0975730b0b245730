"""Every query outside llm against its oracle SQL, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from quarrylane.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 9)
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return datetime.datetime(v.year, v.month, v.day)
    return v


def rows(columns, wanted, found):
    k = [columns.index(c) for c in wanted]
    return sorted(repr(tuple(plain(r[i]) for i in k)) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    assert rows(df.columns, columns, df.collect()) == rows(want.columns, columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert len(QUERIES[name](spark, SF).collect()) > 0  # count() would let Spark leave columns out
