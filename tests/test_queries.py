"""Every registered query of the engine against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from feedspark.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, SF)
    want = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, got.collect()) == table(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 14
    assert set(queries()) <= set(entry.queries()) and set(oracle_sql()) <= set(entry.oracle_sql()) <= set(entry.queries())
