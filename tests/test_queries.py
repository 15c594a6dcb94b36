"""Every registered query that has SQL must return what DuckDB returns for it on the same tables."""

from __future__ import annotations

import os
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = {k: f for plan in entry.PLANS for k, f in plan.QUERIES.items()}, {k: s for plan in entry.PLANS for k, s in plan.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return "nan" if x != x else f"{float(x) + 0.0:.9g}"
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return datetime(x.year, x.month, x.day).isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return str(x) if isinstance(x, bool) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    own = [tuple(r) for r in found.collect()]
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(found.columns) == sorted(names)
    theirs = result.fetchall()
    assert len(own) == len(theirs)
    assert rows_of(found.columns, own) == rows_of(names, theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    assert found.columns and found.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
