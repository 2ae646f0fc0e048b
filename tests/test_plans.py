"""Every registered query with SQL against DuckDB, on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

from marlspan.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def canonical(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if isinstance(value, list | tuple):
        return tuple(canonical(v) for v in value)
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(canonical(r[k]) for k in order) for r in records), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
