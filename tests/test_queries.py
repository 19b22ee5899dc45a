"""Every query with SQL against DuckDB on the smallest tables; every other core query runs."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from eventloom.plans import records, reference

QUERIES = {**records.QUERIES, **reference.QUERIES}
SQL = {**records.SQL, **reference.SQL}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(df):
    def text(v):
        if v is None or v != v:
            return ""
        return repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, data, name):
    got, expected = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got).equals(canonical(expected))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_filters_reach_the_scan(spark, data):
    plan = reference.read_chunk(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value)" in plan or "GreaterThanOrEqual(t,990)" in plan
