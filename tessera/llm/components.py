"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import dropped, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, root` for every linked node but the roots; root is the least node it reaches.

    Alternating large-star and small-star steps: the number of rounds grows
    with the logarithm of the longest path. Minima per node are reduced before
    the shuffle and written, so the join back reads two plain shuffles and
    Spark can split a node with very many links. Each round is a table in the
    shared folder. Loops, repeated links and nulls are left out.
    """
    edges = written(_oriented(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    mark = _mark(edges)
    while True:
        half, least = _large_star(edges)
        half = written(half, "links")
        now, again = _small_star(half)
        now = written(now, "links")
        for table in (edges, least, half, again):
            dropped(table)
        edges, before, mark = now, mark, _mark(now)
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _oriented(e: DataFrame) -> DataFrame:
    """Each link once, from its larger end to its smaller."""
    return e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), least


def _small_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    least = written(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), least
