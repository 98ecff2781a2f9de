"""Every query against its SQL in DuckDB on the smallest tables, and the entry points."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as e
from gridspark.plans.everything import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in os.listdir(SF)] if os.path.isdir(SF) else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def rows(columns, found):
    at = [list(columns).index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_registered():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


@pytest.mark.skipif(not TABLES, reason="no test tables")
def test_entry(spark):
    assert e.entry(spark).count() > 0
