"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lithoflow.plans import queries as core


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(core.all_queries()))
def test_query(spark, sf, duck, name):
    df = core.all_queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    sql = core.all_sql().get(name)
    if sql:
        r = duck.execute(sql)
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(r.fetchall(), columns)


def test_contract(spark):
    assert entry.entry(spark).columns and set(core.all_sql()) <= set(core.all_queries())
    assert set(core.all_queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
