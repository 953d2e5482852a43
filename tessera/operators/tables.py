"""Inserts that keep what is there, work lists, and joins on names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(new: DataFrame, keys: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """The first row of each key, unless the key is in `existing`; null keys are keys."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("__row")).select("__row.*")
    return first if existing is None else insert_absent(first, existing, keys)


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `new` whose keys are not in `existing`; nulls equal nulls."""
    there = existing.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return new.join(there, reduce(Column.__and__, [new[k].eqNullSafe(there[f"__{k}"]) for k in keys]), "left_anti")


def unprocessed(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that no row of `done` belongs to: the work list of a stage."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def get_or_create(names: DataFrame, existing: DataFrame, name_col: str = "name", id_col: str = "id") -> DataFrame:
    """`existing` with new names numbered on from its largest id, in their order.

    The new names of a dimension are few; they are numbered in one window.
    """
    new = names.select(name_col).filter(F.col(name_col).isNotNull()).distinct().join(existing, name_col, "left_anti")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    numbered = new.withColumn("__n", F.row_number().over(W.orderBy(name_col))).crossJoin(F.broadcast(top))
    return existing.select(id_col, name_col).unionByName(numbered.select((F.col("__n") + F.col("__top")).cast("long").alias(id_col), name_col))


def suffix_matches(keys: DataFrame, descriptions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """`key, description`: descriptions whose key is a key's whole name or its last dotted part.

    Two equi joins and a union; an OR of both would be a nested loop.
    """
    d = descriptions.select(F.trim("key").alias("__k"), F.trim("description").alias("description")).filter("__k <> '' and description <> ''").distinct()
    k = keys.select("key").filter("key is not null").distinct()
    whole = k.join(d, k["key"] == d["__k"]).select("key", "description")
    last = k.withColumn("__last", F.substring_index("key", ".", -1)).join(d, F.col("__last") == d["__k"]).select("key", "description")
    found = whole.union(last).distinct()
    return found if existing is None else insert_absent(found, existing, ["key", "description"])


def latest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__row")).select("__row.*")


def with_replay(log: DataFrame, edits: DataFrame, id_col: str = "id", parent_col: str = "modified_query_id") -> DataFrame:
    """Edited queries with their parents' data; a missing parent is an error."""
    if not edits.join(log, edits[parent_col] == log[id_col], "left_anti").isEmpty():
        raise ValueError("an edited query has no parent in the log")
    parents = log.select(F.col(id_col).alias(parent_col), F.col("structured_data").alias("parent_data"))
    return edits.join(parents, parent_col)
