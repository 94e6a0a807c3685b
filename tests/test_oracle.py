"""Every registered query against its DuckDB statement on sf0.001, and the
driver entry point."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from orderlens.plans import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(dicts, cols):
    return sorted((tuple(_norm(d[c]) for c in cols) for d in dicts),
                  key=lambda t: tuple("" if x is None else x for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in ["supplier", "part", "lineitem", "events"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "performance_score" in df.columns


def test_every_query_has_oracle_or_is_rows_only():
    assert set(QUERIES) == (set(E.oracle_sql()) & set(QUERIES)) | E.ROWS_ONLY
    assert set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [r.asDict() for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(srows) > 0
        return
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    drows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    cols = sorted(df.columns)
    assert _rows(srows, cols) == _rows(drows, cols)
