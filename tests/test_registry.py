"""Registered queries against their DuckDB forms on the smallest driver tables, and the contract's shape."""

import numbers
import os

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def cell(v):
    if pd.isna(v):
        return None
    if isinstance(v, bool) or not isinstance(v, numbers.Number):
        return str(v)
    return round(float(v), 6)


def plain(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(cell, r)) for r in frame[cols].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def names():
    from tallyhawk.plans import registry

    return sorted(registry.QUERIES)


def test_every_query_has_an_oracle():
    from tallyhawk.plans import registry

    assert set(registry.ORACLES) == set(registry.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    from tallyhawk.plans import registry

    assert plain(registry.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(registry.ORACLES[name]).fetchdf())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
