"""The text queries that have SQL, against DuckDB on the smallest tables."""

import glob
import os

import pytest

from tessera.llm import queries
from tests.test_queries import SF, canon

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    assert (canon(got).values == canon(want).values).all()
