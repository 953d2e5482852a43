"""Benchmark decontamination in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import columns_of, lower_ascii, whole_row

#: A word: ASCII letters and digits and whatever is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct benchmark windows up to which their hashes are broadcast (some 300 bytes each).
BROADCAST_WINDOWS = 200_000


def terms(text: Column) -> Column:
    """The words of a text, A-Z in lower case; a null has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def _windows(words: str, length: Column) -> Column:
    """The starts of all windows of `length` words, from 1; none if there are fewer words."""
    n = F.size(words)
    return F.when((n >= length) & (length > 0), F.sequence(F.lit(1), n - length + 1))


def _places(words: str, length: int) -> Column:
    """(at, len) of all windows of `length` words."""
    starts = F.coalesce(_windows(words, F.lit(length)), F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.struct(at.alias("at"), F.lit(length).alias("len")))


#: Names a null item within a list, as no item can be called so.
_NONE = "\0"


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """`h, len, gram, items`: each distinct window with the items that it stands in.

    An item of fewer than `n` words, but not none, is one window.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit(_NONE)).alias("item"), terms(F.col(text_col)).alias("w")).withColumn("len", F.least(F.size("w"), F.lit(n)))
    grams = items.select("item", "w", "len", F.explode(_windows("w", F.col("len"))).alias("at")).select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("gram"))
    return grams.groupBy(F.xxhash64("gram").alias("h"), "len", "gram").agg(F.collect_set("item").alias("items"))


def _scan(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, n: int, every: bool) -> DataFrame:
    """`__id, text_hash, rows, n_words, spans, items`, a row for each id and text: of all documents, or of those hit.

    One pass over the texts: a document's windows and one entry for the
    document itself are looked up together. The windows' hashes are broadcast
    while they are `BROADCAST_WINDOWS` at most, beyond they are shuffled;
    either way equal hashes are verified word by word.
    """
    grams = benchmark_windows(benchmark, item_col, "text", n)
    lengths = grams.groupBy("len").count().collect()  # n rows at most
    if sum(r["count"] for r in lengths) <= BROADCAST_WINDOWS:
        grams = F.broadcast(grams)
    own = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"))) if every else F.array().cast("array<struct<at:int,len:int>>")
    places = [_places("w", r["len"]) for r in sorted(lengths)]
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("text_hash"), terms(F.col(text_col)).alias("w"))
    rows = rows.select("__id", "text_hash", "w", F.explode(F.concat(own, *places)).alias("p")).select("__id", "text_hash", "p.*", F.when(F.col("p.at") == 0, F.size("w")).alias("n"), F.slice("w", F.greatest(F.col("p.at"), F.lit(1)), F.col("p.len")).alias("own"))
    # a document's entry has a hash of its own, so that none is common
    rows = rows.withColumn("h", F.when(F.col("at") > 0, F.xxhash64("own")).otherwise(F.xxhash64("__id", "text_hash")))
    met = rows.join(grams.withColumnRenamed("len", "__len"), "h", "left" if every else "inner")
    # verified by order, so that the join's key is the hash alone
    same = F.coalesce((F.col("at") > 0) & (F.col("own") >= F.col("gram")) & (F.col("own") <= F.col("gram")), F.lit(False))
    kept = met.filter(same | (F.col("at") == 0))
    span = F.struct((F.col("at") - 1).alias("from"), (F.col("at") - 1 + F.col("len")).alias("to"))
    by_doc = kept.groupBy("__id", "text_hash").agg(
        F.sum((F.col("at") == 0).cast("int")).alias("rows"), F.max("n").alias("n_words"), F.array_sort(F.collect_set(F.when(F.col("at") > 0, span))).alias("all"), F.array_distinct(F.flatten(F.collect_set(F.when(F.col("at") > 0, F.col("items"))))).alias("items")
    )
    # touching spans are joined: the list stays sorted, only its last element can grow
    kind = "array<struct<from:int,to:int>>"
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(
        "all",
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["to"] >= x["from"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["from"].alias("from"), F.greatest(last(acc)["to"], x["to"]).alias("to")))),
        ).otherwise(F.concat(acc, F.array(x))).cast(kind),
    )
    items = F.transform("items", lambda i: F.when(i == _NONE, F.lit("null")).otherwise(i))
    return by_doc.select("__id", "text_hash", "rows", "n_words", joined.alias("spans"), items.alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 10) -> DataFrame:
    """`id_col, text_hash, spans, items` for the rows in which a window occurs.

    spans: sorted (from, to) word positions from 0, to exclusive, that overlap
    no more; items: the items whose windows occur, a null item as "null". Rows
    with equal id and text give one row.
    """
    return _scan(docs, benchmark, id_col, text_col, item_col, n, False).select(F.col("__id").alias(id_col), "text_hash", "spans", "items")


def _hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 10) -> DataFrame:
    """`id_col, n_words, n_hit, n_items, items` for every row.

    A null text has no words; rows with null or repeated ids are told apart by
    their texts; repeated rows come back each; an empty benchmark hits nothing;
    a null item is listed as "null", beside one that is called so. Other
    columns are not looked at.
    """
    found = _scan(docs, benchmark, id_col, text_col, item_col, n, True)
    each = found.select(F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("__n"), "*")
    return each.select(F.col("__id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), _hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 10, max_hit_share: float = 0.0) -> DataFrame:
    """`docs` without the rows of which more than `max_hit_share` of the words are hit.

    Rows are told apart by id and text, so ids may be null or repeated.
    """
    found = hits(docs, benchmark, id_col, text_col, item_col, n).select(F.col(id_col).alias("__bad"), F.col("text_hash").alias("__hash"), _hit_words().alias("__hit")).filter("__hit > 0")
    same = docs[id_col].eqNullSafe(found["__bad"]) & (F.xxhash64(docs[text_col]) == found["__hash"])
    if max_hit_share > 0:
        same &= found["__hit"] > max_hit_share * F.regexp_count(lower_ascii(F.coalesce(docs[text_col], F.lit(""))), F.lit(TERM))
    return docs.join(found, same, "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 10) -> DataFrame:
    """`docs` with the hit words cut out of their texts, all else as it was; columns may have any names.

    The text falls into words and what stands between them; a hit word goes
    together with what follows it.
    """
    found = hits(docs, benchmark, id_col, text_col, item_col, n).select(F.col(id_col).alias("i"), F.col("text_hash").alias("h"), F.col("spans").alias("s"))
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("own"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("t"))
    both = rows.join(found, F.col("own").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left")
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    cased = TERM.replace(r"\x3A-\x60\x7B", r"\x3A-\x40\x5B-\x60\x7B")
    pieces = F.regexp_extract_all("t", F.lit(f"{cased}{gap}*"), F.lit(0))
    head = F.regexp_extract("t", f"^{gap}*", 0)
    kept = F.filter(F.transform(pieces, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: ~F.exists("s", lambda x: (x["from"] <= p["i"]) & (p["i"] < x["to"])))
    cut = F.concat(head, F.array_join(F.transform(kept, lambda p: p["w"]), ""))
    return both.select(*[F.when(F.col("s").isNotNull(), cut).otherwise(F.col("t")).alias(c) if c == text_col else own for c, own in zip(docs.columns, columns_of("row", docs))])
