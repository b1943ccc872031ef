"""Every query that has SQL is held against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from pathloom.plans.oracle_sql import ORACLE_SQL
from pathloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def same(df, sql, sf=SF):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    want = c.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{x}"' for x in cols)
    rows = sorted(repr(r) for r in want.project(quoted).fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_entry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
