import zlib

from pyspark.sql import functions as F

from tessera.llm.sharding import balanced_shards, shard_of, write_shards
from tests.llm.helpers import corpus, docs_of


def plain(rows, n):
    order = sorted(((r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 16) for r in rows))
    total, at, slots, out = sum(x[3] for x in order), 0, {}, []
    for known, i, crc, size in order:
        shard = (2 * at + size) * n // (2 * total)
        at += size
        out.append((str(i) if known else "None", size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
    return sorted(out)


def test_shards_are_contiguous_and_balanced(spark):
    rows = corpus()
    docs = docs_of(spark, rows)
    for n in (1, 7, 40):
        got = sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in balanced_shards(docs, n).collect())
        assert got == plain(rows, n)
        assert got == sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in balanced_shards(docs.repartition(9), n).collect())


def test_odd_tables(spark):
    assert balanced_shards(docs_of(spark, [])).count() == 0
    one = balanced_shards(docs_of(spark, [(5, None, None, None)])).collect()
    assert [(r.size, r.text_crc32, r.slot) for r in one] == [(16, 0, 0)]


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None and r[0] < 60][:60]
    write_shards(docs_of(spark, rows), f"file://{tmp_path}/out", 5)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((r.doc_id, r.text or "") for r in back.collect()) == sorted((r[0], r[1] or "") for r in rows)
    assert back.select("shard").distinct().count() == 5


def test_numbers_hold_at_any_size(spark):
    cases = []
    for total in (10**9, 9 * 10**14, 10**17):
        for n in (1, 3, 40, 5000):
            for offset, size in ((0, 16), (total - 16, 16), (total - 10**6, 10**6), (total // 2 - 8, 16), (total * 39 // 40 - 8, 16), (total * 39 // 40 - 9, 16)):
                cases.append((offset, size, total, n))
    for n in (1, 3, 40, 5000):
        df = spark.createDataFrame([c for c in cases if c[3] == n], "o long, s long, t long, n int")
        for r in df.withColumn("shard", shard_of(F.col("o"), F.col("s"), F.col("t"), n)).collect():
            assert r.shard == (2 * r.o + r.s) * n // (2 * r.t) and 0 <= r.shard < n


def test_a_null_text_after_many_bytes_stays_in_the_last_shard(spark):
    docs = spark.range(1, 41).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, F.repeat(F.lit("x"), 1_000_003)).alias("text"))
    got = {r.doc_id: r.shard for r in balanced_shards(docs).collect()}
    assert max(got.values()) == 39 and got[40] == 39


def test_written_rows_keep_their_columns_and_places(spark, tmp_path):
    rows = [(1, "a b", 7), (1, "a b", 8), (1, "a b", 9), (None, None, 1), (None, "", 2), (2, "c" * 300, 3), (3, "d" * 200, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    write_shards(docs, f"file://{tmp_path}/out", 3)
    back = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((str(r.doc_id), str(r.text), r.shard) for r in back) == sorted((str(a), str(b), c) for a, b, c in rows)
    placed = balanced_shards(docs, 3).groupBy("shard").count().collect()
    assert sorted((r["shard"], r["count"]) for r in placed) == sorted((k, sum(r["_shard"] == k for r in back)) for k in {r["_shard"] for r in back})
