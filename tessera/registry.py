"""Where queries and their SQL are registered, and the tables they read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def of(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return of


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing stands at yet."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
