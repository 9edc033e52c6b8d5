"""Registered search queries against their SQL, on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__
from quarryvec import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    c = sorted(frame.columns)
    return sorted(map(str, map(tuple, frame[c].astype(object).values.tolist())))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(queries.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
