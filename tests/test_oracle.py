"""Every query that has SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from scriptorium.plans.catalogue import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)) and not hasattr(value, "as_tuple"):
        return str(value)
    return round(float(value), 6)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, tables, name):
    ours = QUERIES[name](spark, str(DATA))
    theirs = tables.sql(ORACLE_SQL[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in names]
    expected = sorted(repr([normal(row[i]) for i in at]) for row in theirs.fetchall())
    assert sorted(repr([normal(v) for v in row]) for row in ours.select(*names).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
