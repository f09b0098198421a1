"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def cell(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else f"{x:.9g}"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    ran = duck.execute(SQL[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    want = sorted(tuple(cell(dict(zip(names, r, strict=True))[c]) for c in cols) for r in ran.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 5
