"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera import queries

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def canon(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        number = pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c])
        df[c] = df[c].map(lambda x: "<null>" if x is None or x is pd.NA or x != x else f"{float(x):.9g}" if number else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    assert (canon(got).values == canon(want).values).all()


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
