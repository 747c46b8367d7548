"""Every registered query against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pandas as pd
import pytest

from marlstone.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def cell(v):
    if pd.isna(v):
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float, decimal.Decimal)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
        return repr(round(float(v), 5) + 0.0)
    return str(v)[:10] if hasattr(v, "year") else str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, con, name):
    mine = registry.QUERIES[name](spark, DATA).toPandas()
    other = con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
