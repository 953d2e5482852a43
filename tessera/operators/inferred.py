"""Inferred attributes: packing of evidence, candidates, key resolution and the vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import norm_key, norm_text
from tessera.operators.tables import insert_absent
from tessera.operators.vectors import similar

#: Candidates of one reply that are looked at.
MAX_CANDIDATES = 12


def pack_rows(df: DataFrame, by: str = "doc_id", key: str = "key", value: str = "value", limit: int = 10) -> DataFrame:
    """`by, key, value, cluster`: a document's rows in clusters of `limit` at most.

    A key's rows stay together, in the order of keys, as long as they fit; a
    key with more rows than `limit` gets clusters of its own. Equal rows are
    kept once, blank values left out. Keys are counted first: which clusters a
    key begins at follows from the counts of the keys before it, folded over
    one short list for each document; the rows then only add their place.
    """
    rows = df.select(by, key, value).filter(F.trim(F.coalesce(value, F.lit(""))) != "").filter(F.col(key).isNotNull()).distinct()
    counts = rows.groupBy(by, key).agg(F.count("*").cast("int").alias("n"))
    keys = counts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "n"))).alias("keys"))
    # next: the cluster that is being filled, room: what it still takes; `done` tells where each key begins
    full = F.lit(limit)
    start = F.struct(F.lit(-1).alias("next"), F.lit(0).alias("room"), F.array().cast("array<struct<k:string,first:int>>").alias("done"))

    def add(acc, x):
        own = x["n"] > full
        opens = own | (x["n"] > acc["room"])
        first = F.when(opens, acc["next"] + 1).otherwise(acc["next"])
        last = F.when(own, acc["next"] + F.ceil(x["n"] / full).cast("int")).otherwise(first)
        room = F.when(own, F.lit(0)).when(opens, full - x["n"]).otherwise(acc["room"] - x["n"])
        return F.struct(last.alias("next"), room.alias("room"), F.concat(acc["done"], F.array(F.struct(x["k"].cast("string").alias("k"), first.alias("first")))).alias("done"))

    placed = keys.select(by, F.explode(F.aggregate("keys", start, add)["done"]).alias("p")).select(by, "p.k", "p.first")
    at = F.row_number().over(W.partitionBy(by, key).orderBy(value)) - 1
    numbered = rows.withColumn("__at", at).join(placed.withColumnsRenamed({by: "__by", "k": "__k"}), F.col(by).eqNullSafe(F.col("__by")) & (F.col(key).cast("string") == F.col("__k")))
    return numbered.select(by, key, value, (F.col("first") + F.floor(F.col("__at") / limit)).cast("int").alias("cluster"))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def parse_candidates(df: DataFrame, json_col: str = "json") -> DataFrame:
    """`df` without its JSON, a row for each usable candidate: `name, description, value, unit, evidence_indices`.

    A candidate needs a name, a description and a value that is no list or
    object; the first twelve usable ones of a reply count. All evidence
    indices stay: whole numbers from 0, each once, in order, as decimals, for a
    reply may name any (over 38 digits none). A reply that does not parse has
    no candidates.
    """
    every = F.try_variant_get(F.try_parse_json(F.col(json_col)), "$.filters", "array<variant>")
    text = lambda v, at: F.try_variant_get(v, at, "string")
    kind = lambda v: F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.value", "variant")), F.lit("VOID"))

    def one(v):
        value = F.when(kind(v) == "BOOLEAN", F.initcap(text(v, "$.value"))).otherwise(F.trim(text(v, "$.value")))
        unit = _spaced(text(v, "$.unit"))
        numbers = F.coalesce(F.try_variant_get(v, "$.evidence_indices", "array<string>"), F.array().cast("array<string>"))
        numbers = F.array_distinct(F.transform(F.filter(numbers, lambda x: x.rlike(r"^0*\d{1,38}$")), lambda x: x.cast("decimal(38,0)")))
        return F.struct(_spaced(text(v, "$.name")).alias("name"), _spaced(text(v, "$.description")).alias("description"), value.alias("value"), F.when(unit != "", unit).alias("unit"), numbers.alias("evidence_indices"), kind(v).rlike("^(OBJECT|ARRAY|VOID)").alias("nested"))

    objects = F.filter(every, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    usable = F.filter(F.transform(objects, one), lambda c: (c["name"] != "") & (c["description"] != "") & ~c["nested"] & (F.coalesce(c["value"], F.lit("")) != ""))
    each = df.withColumn("c", F.explode(F.slice(usable, 1, MAX_CANDIDATES))).select(*[c for c in df.columns if c != json_col], "c.*")
    return each.drop("nested")


def resolve_keys(proposed: DataFrame, keys: DataFrame, descriptions: DataFrame | None = None, threshold: float = 0.20, gap: float = 0.04, name_col: str = "name", vector_col: str = "vector") -> DataFrame:
    """`name_col, key, is_new` for every proposed name.

    In turn: the one key of equal normal form; the one key with a description
    of equal normal form; the nearest key by name or description if it is near
    enough and the second lies `gap` behind; else a new key. Several exact hits
    settle nothing and fall through.
    """
    asked = proposed.dropDuplicates([name_col])
    norm = asked.select(name_col, norm_key(F.col(name_col)).alias("n"), norm_text(F.col(name_col)).alias("t"))
    one = lambda df, by: df.groupBy(by).agg(F.count_distinct("key").alias("k"), F.min("key").alias("hit")).filter("k = 1").drop("k")
    exact = one(keys.select("key", norm_key(F.col("key")).alias("n")), "n").withColumnRenamed("hit", "by_name")
    met = norm.join(exact, "n", "left")
    # the two nearest keys of all are among the two nearest of each block
    near = similar(asked, keys.select("key", vector_col), -1.0, name_col, vector_col, vector_col, nearest=2)
    if descriptions is not None:
        said = one(descriptions.select("key", norm_text(F.col("description")).alias("t")), "t").withColumnRenamed("hit", "by_text")
        met = met.join(said, "t", "left")
        near = near.unionByName(similar(asked, descriptions.select("key", vector_col), -1.0, name_col, vector_col, vector_col, nearest=2))
    else:
        met = met.withColumn("by_text", F.lit(None).cast("string"))
    close = _nearest(near, threshold, gap, name_col)
    all_ = met.join(close, name_col, "left")
    hit = F.coalesce("by_name", "by_text", "by_meaning")
    return all_.select(name_col, F.coalesce(hit, F.col("n")).alias("key"), hit.isNull().alias("is_new"))


def _nearest(near: DataFrame, threshold: float, gap: float, name_col: str) -> DataFrame:
    """`name_col, by_meaning`: the nearest key, where it is near enough and the next lies `gap` behind."""
    least = near.groupBy(name_col, "key").agg(F.min("distance").alias("d"))
    # the two nearest of each name: the least, and the least of the others
    best = least.groupBy(name_col).agg(F.min(F.struct("d", "key")).alias("a"))
    second = least.join(best, name_col).filter(F.col("key") != F.col("a.key")).groupBy(name_col).agg(F.min("d").alias("b"))
    ahead = F.col("b").isNull() | (F.round(F.col("b") - F.col("a.d"), 9) >= gap)
    return best.join(second, name_col, "left").filter((F.col("a.d") <= threshold) & ahead).select(name_col, F.col("a.key").alias("by_meaning"))


def nearest_or_new(names: DataFrame, near: DataFrame, threshold: float = 0.20, gap: float = 0.04, name_col: str = "name") -> DataFrame:
    """`name_col, key, is_new` by distances alone: `near` is (name_col, key, distance)."""
    met = names.select(name_col).distinct().join(_nearest(near, threshold, gap, name_col), name_col, "left")
    return met.select(name_col, F.coalesce("by_meaning", norm_key(F.col(name_col))).alias("key"), F.col("by_meaning").isNull().alias("is_new"))


def vote(candidates: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """`doc_col, key, value, unit, evidence, clusters`: the candidates that win their key.

    A value is supported by its distinct evidence rows (`ekey`, `evalue`), then
    by its clusters. A key's best value stays if no other is as good.
    """
    support = candidates.groupBy(doc_col, "key", "value", "unit").agg(F.count_distinct(F.struct("ekey", "evalue")).alias("evidence"), F.count_distinct("cluster").alias("clusters"))
    rank = F.struct("evidence", "clusters")
    best = support.groupBy(doc_col, "key").agg(F.max(rank).alias("top"))
    first = support.join(best, [doc_col, "key"]).filter(rank == F.col("top"))
    alone = first.groupBy(doc_col, "key").agg(F.count("*").alias("n"), F.first(F.struct("value", "unit", "evidence", "clusters")).alias("w")).filter("n = 1")
    return alone.select(doc_col, "key", "w.*")


def replace_inferred(attributes: DataFrame, inferred: DataFrame, done: DataFrame) -> DataFrame:
    """`attributes` with the inferred rows of the documents in `done` replaced by those of `inferred`.

    Rows that stand there by another origin are not inferred again.
    """
    gone = attributes.filter("type = 'INFERRED'").join(done.select("doc_id").distinct(), "doc_id", "left_semi")
    rest = insert_absent(attributes, gone, ["doc_id", "key", "value", "unit", "type"])
    own = rest.filter("type <> 'INFERRED'")
    new = insert_absent(inferred.select("doc_id", "key", "value", "unit").distinct(), own, ["doc_id", "key", "value", "unit"])
    return rest.select("doc_id", "key", "value", "unit", "type").unionByName(new.withColumn("type", F.lit("INFERRED")))
