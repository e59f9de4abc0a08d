"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tablemill.plans import base, registry

DATA = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(rows):
    return sorted(repr([round(x, 5) if isinstance(x, float) else x for x in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain([[r[c] for c in columns] for r in got.collect()]) == plain([[r[want.columns.index(c)] for c in columns] for r in want.fetchall()])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert all(base.OPERATORS[name] for name in registry.QUERIES)
