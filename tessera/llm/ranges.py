"""Running totals over sorted ranges, so that no key has to fit into one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import written


def in_ranges(df: DataFrame, *order: Column | str, name: str = "ranges") -> DataFrame:
    """`df` written in ranges of `order`, each with its number in `part`; a key with many rows fills several."""
    return written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def running(
    table: DataFrame, key: str, order: list[Column | str], values: dict[str, Column], total: Callable = F.sum, combine: Callable[[Column, Column], Column] = lambda a, b: a + b, inclusive: bool = True
) -> DataFrame:
    """`table` with a running total of each value over the rows of its key, in `order`.

    `table` comes from `in_ranges`, sorted by the key and then `order`; the key
    has no nulls. Windows run inside ranges; what earlier ranges hold of a
    key that they end with is carried over, one or two rows for each range.
    A total over no rows is null.
    """
    rows = table.select("*", *[v.alias(f"__{c}") for c, v in values.items()])
    ends = rows.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    edge = rows.join(F.broadcast(ends), "part").filter((F.col(key) == F.col("lo")) | (F.col(key) == F.col("hi")))
    edge = edge.groupBy("part", key).agg(*[total(f"__{c}").alias(f"__{c}") for c in values])
    before = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = edge.select("part", key, *[total(f"__{c}").over(before).alias(f"__before_{c}") for c in values])
    inside = W.partitionBy("part", key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    found = rows.select("*", *[total(f"__{c}").over(inside).alias(f"__own_{c}") for c in values]).join(F.broadcast(carry), ["part", key], "left")

    def both(c: str) -> Column:
        own, earlier = F.col(f"__own_{c}"), F.col(f"__before_{c}")
        return F.when(own.isNull(), earlier).when(earlier.isNull(), own).otherwise(combine(own, earlier))

    return found.select(*[F.col(c) for c in table.columns], *[both(c).alias(c) for c in values])


def bit_xor(c) -> Column:
    return F.bit_xor(c)


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)
