"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", F.element_at("source_sizes", 1).alias("source_size"), F.element_at("targets", 1).alias("target"), "taken")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import BASE, quality_rules

    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.tokens import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import digest, expand

    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest(expand(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring import duplicate_spans, removed_words

    found = duplicate_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", removed_words().alias("n_removed"), "kept_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import identify, learn

    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = identify(docs, learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secret_scan import KINDS, find_secrets

    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    found = find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.size(own(k)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(text(own(*KINDS)), 256).alias("base_sha256"), text("spans").alias("spans"))


def op10_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import balanced_shards

    placed = balanced_shards(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.packing import pack

    packed = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.runs import periodic_runs, repeat_tail, strongest
    from tessera.llm.text import WORD

    docs = _table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    docs = docs.select("doc_id", "text", h.alias("h"), F.call_function("div", h, F.lit(10)).alias("g"), F.when(h % 10 == 0, n).alias("n"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.call_function("div", F.col("n") - F.col("a"), 3 + F.col("g") % 8)).cast("int"))
    docs = docs.select("doc_id", F.when(F.col("p").isNotNull(), repeat_tail(F.col("text"), F.col("a"), F.col("p"))).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(docs)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.call_function("div", 1000 * F.col("best.length"), F.col("best.period"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.trie import numbered_turns, prefix_trie
    from tessera.session import written

    turns = written(numbered_turns(_table(spark, sf_dir, "conversations")), "numbered")
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    convs = turns.select("conv").distinct()
    # the first turns of every twentieth conversation stand at the head of the nineteen after it
    lead = turns.filter((F.col("k") < 3) & (F.col("conv") % 20 == 0)).withColumnRenamed("conv", "base")
    given = convs.select("conv", (F.col("conv") - F.col("conv") % 20).alias("base"), heads.alias("h")).join(lead, "base").filter(F.col("k") < F.col("h"))
    rebuilt = turns.filter(F.col("k") >= heads).unionByName(given.select("conv", "k", "role", "text"))
    return prefix_trie(rebuilt, convs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_simhash_dedup, op2_mix_sources, op3_decontaminate, op4_quality_rules, op5_token_counts, op6_chat_examples, op7_substring_dedup, op8_language_id, op9_secret_scan, op10_shard_by_bytes, op11_bm25_packing, op12_periodic_runs, op13_prefix_trie)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from tessera.llm.oracles import ORACLES

    return dict(ORACLES)
