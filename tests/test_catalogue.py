"""Every registered query with an SQL twin against DuckDB, at the smallest scale."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from folioscope.plans import reference, sources

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = sorted(reference.ORACLE_SQL | sources.ORACLE_SQL)


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def views(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, small, views, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    want = views.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, small):
    assert entry.entry(spark).columns == ["value", "n", "pct"]
