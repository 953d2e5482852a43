"""Contiguous shards of near-equal bytes, cut at global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.text import columns_of, whole_row
from tessera.session import dropped, written

#: Bytes that a row counts besides its text.
ROW_OVERHEAD = 16
ORDER = ["__id", "text_crc32", "size", "__tie"]


def shard_of(offset: Column, size: Column, all_bytes: Column, n_shards: int) -> Column:
    """The part of `n_shards` equal ones that the middle of a row lies in, 0 to n_shards - 1.

    Whole numbers throughout: a quotient with a fraction would be rounded.
    """
    middle = (2 * offset + size).cast("decimal(20,0)") * F.lit(n_shards).cast("decimal(10,0)")
    return F.call_function("div", middle, (2 * all_bytes).cast("decimal(20,0)")).cast("int")


def _placed(docs: DataFrame, n_shards: int, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    """`__id, size, text_crc32, shard, slot`, and `__row` if one is asked for."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [] if row is None else [row.alias("__row")]
    more = [] if row is None else ["__row"]
    # the tie-break is written with the rows: it only parts rows that are equal in all else, so that many of them fill several ranges
    rows = written(docs.select(F.col(id_col).alias("__id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("__tie"), *own), "sizes")
    dealt = written(rows.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()), "ranges")
    dropped(rows)
    # one row for each range, however many rows there are
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(W.partitionBy()).alias("all_bytes"))
    inside = W.partitionBy("part").orderBy(*ORDER)
    offset = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.join(F.broadcast(totals), "part").select("__id", "text_crc32", "size", *more, shard_of(offset, F.col("size"), F.col("all_bytes"), n_shards).alias("shard"), (F.col("rows_before") + F.row_number().over(inside) - 1).alias("row"))
    placed = written(placed, "placed")
    dropped(dealt)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows at most
    return placed.join(F.broadcast(first), "shard").select("__id", "size", "text_crc32", *more, "shard", (F.col("row") - F.col("first")).alias("slot"))


def balanced_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, size, text_crc32, shard, slot` for every row.

    Rows stand in the order of id (null first), checksum and size. They are
    dealt out by ranges of that order; the bytes of each range are summed, the
    sums are added up over the ranges, and a running sum inside each range
    gives every row its global offset. Shard k takes the rows whose middle lies
    in the k-th of `n_shards` equal parts, so shards are contiguous and differ
    from an equal share by less than a row. `slot` numbers a shard's rows from 0.

    A null text has no bytes and checksum 0. Rows that are equal in all three
    are interchangeable. An empty table gives no rows; with fewer rows than
    shards some shards are empty. Other columns are not looked at.
    """
    return _placed(docs, n_shards, id_col, text_col).select(F.col("__id").alias(id_col), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every row of `docs` under `path`, a folder for each shard, in the order of its slots.

    Each row goes with its columns to the place that `balanced_shards` gives
    it. Folders are named after a column `shard`, with as many underscores
    before it as no column of `docs` has.
    """
    folder = "shard"
    while folder in docs.columns:
        folder = f"_{folder}"
    placed = _placed(docs, n_shards, id_col, text_col, whole_row(docs))
    out = placed.select(F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), "__row").repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    out.select(*columns_of("__row", docs), F.col("__shard").alias(folder)).write.partitionBy(folder).parquet(path)
