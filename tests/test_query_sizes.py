"""Queries against their SQL where tables do not grow alike."""

import os

import pytest

import __spark_entry__ as entry
from tests.test_queries import SF, canon

duckdb = pytest.importorskip("duckdb")


def tables(folder, **instead):
    """The smallest tables in a new folder, some of them by other SQL."""
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        name = f.removesuffix(".parquet")
        con.execute(f"copy ({instead.get(name, 'select * from t').replace('from t', f'''from '{SF}/{f}' t''')}) to '{folder}/{f}' (format parquet)")
        con.execute(f"create view {name} as select * from '{folder}/{f}'")
    return con


def same(spark, con, folder, name):
    got, want = entry.queries()[name](spark, str(folder)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    assert (canon(got).values == canon(want).values).all()


def test_queries_whose_benchmark_item_is_missing_or_blank(spark, tmp_path):
    con = tables(tmp_path, benchmark="select item_id, case when item_id = 1 then '-' else text end as text from t where item_id < 3")
    same(spark, con, tmp_path, "hybrid_search_full")
