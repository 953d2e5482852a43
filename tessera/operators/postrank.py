"""After the ranking: normalised scores, the knee cut, buckets, details and payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import is_close, safe_div, split_detail

COMPONENTS = ("document", "chunk", "conditions_full", "conditions_partial", "keywords")
DEFAULT_K = {"document": 6, "chunk": 6, "conditions_full": 6, "conditions_partial": 6, "keywords": 10}
#: Which flag of a query switches a component on.
GATES = {"document": "has_intention", "chunk": "has_intention", "conditions_full": "has_conditions", "conditions_partial": "has_conditions", "keywords": "has_keywords"}
MATCHED = 0.95


def normalise_scores(results: DataFrame, k: dict[str, int] | None = None) -> DataFrame:
    """`results` with each score over its largest possible value, the overall one over the sum of the active ones.

    Needs the flags `has_intention`, `has_conditions`, `has_keywords`; scores of
    inactive components become 0.
    """
    k = DEFAULT_K | (k or {})
    top = {c: F.when(F.col(GATES[c]), 1.0 / (1 + k[c])).otherwise(0.0) for c in COMPONENTS}
    scores = {f"{c}_score": safe_div(F.when(F.col(GATES[c]), F.coalesce(f"{c}_score", F.lit(0.0))).otherwise(0.0), top[c]) for c in COMPONENTS}
    return results.withColumns(scores | {"overall_score": safe_div(F.coalesce("overall_score", F.lit(0.0)), reduce(Column.__add__, top.values()))})


def knee_cut(results: DataFrame, by: str = "query_id", score: str = "overall_score", order: tuple[str, ...] = ("doc_id",), min_top: float = 0.25, min_results: int = 3, eps: float = 0.02) -> DataFrame:
    """`results` with `position` (from 0), `kept`, `knee_index`, `knee_score`, `max_distance`, `keep_count`.

    Rows are sorted by score, then `order`. None is kept under a top score of
    `min_top`; all are with fewer than `min_results` rows or where no row lies
    `eps` off the line from the first to the last; else those before the first
    farthest row, or through the end of the scores equal to its own.
    Each query is one window: results of a search, not of a corpus.
    """
    w = W.partitionBy(by).orderBy(F.desc(score), *order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s, i, n = F.col(score), F.col("position"), F.col("__n")
    rows = results.withColumns({"position": F.row_number().over(w) - 1, "__n": F.count("*").over(W.partitionBy(by)), "__first": F.first(score).over(whole), "__last": F.last(score).over(whole)})
    dx, dy = n - 1, F.col("__last") - F.col("__first")
    length = F.sqrt(dx * dx + dy * dy)
    off = F.abs(dy * i - dx * s + dx * F.col("__first")) / F.when(length == 0, 1.0).otherwise(length)
    rows = rows.withColumn("__off", off)
    group = W.partitionBy(by)
    rows = rows.withColumns({"knee_index": F.max_by(i, F.struct(F.col("__off"), -i)).over(group), "knee_score": F.max_by(s, F.struct(F.col("__off"), -i)).over(group), "max_distance": F.max("__off").over(group)})
    flat = is_close(s, F.col("knee_score"))
    rows = rows.withColumns({"__flat": F.sum(flat.cast("int")).over(group), "__end": F.max(F.when(flat, i)).over(group)})
    upto = F.when(F.col("__first") < min_top, F.lit(0)).when((n < min_results) | (F.col("max_distance") < eps), n).when(F.col("__flat") > 1, F.col("__end") + 1).otherwise(F.col("knee_index"))
    return rows.withColumn("keep_count", upto.cast("int")).withColumn("kept", i < F.col("keep_count")).drop("__n", "__first", "__last", "__off", "__flat", "__end")


def buckets(results: DataFrame, score: str = "overall_score") -> DataFrame:
    """`results` with `bucket`: matched, relevant or suggested."""
    return results.withColumn("bucket", F.when(F.col("kept") & (F.col(score) >= MATCHED), "matched").when(F.col("kept"), "relevant").otherwise("suggested"))


def without_knee(results: DataFrame, structured: Column) -> DataFrame:
    """`results` with `kept` and `bucket` for queries whose cut is not to be had: all are kept, none for `structured` queries."""
    return buckets(results.withColumn("kept", ~structured))


#: Where each facility keeps a detail, the keys in order of priority.
DETAIL_KEYS = {
    "publication_year": {"ILL": ["publicationYear"], "ESS": ["publicationYear"], "PSI": ["publicationYear"], "MAX IV": ["publicationYear"], "ESRF": ["publicationYear"], "DESY": ["publicationYear"]},
    "instrument_name": {"ILL": ["instruments.name"], "ESS": ["creationLocation"], "PSI": ["beamline"], "MAX IV": ["creationLocation"], "ESRF": ["beamline", "instruments.name"], "DESY": ["instrument.name"]},
    "authors": {"ILL": ["authors.name"], "ESS": ["creator", "authors"], "PSI": ["creator"], "MAX IV": ["creator"], "ESRF": ["creators.name", "contributors.name"], "DESY": ["creator", "contributors.name"]},
}


def document_details(docs: DataFrame, attributes: DataFrame, mapping: dict[str, dict[str, list[str]]] | None = None, doc_col: str = "doc_id", facility_col: str = "facility") -> DataFrame:
    """`doc_col, facility_col` and a column for each field of `mapping`: {field: {facility: [keys by priority]}}.

    Values come in the order of their keys and `attr_id`, are parted at commas
    (authors only where every part has a blank), de-duplicated without regard
    to case and joined by ` - `. A field that is not mapped or empty is null.
    The mapping is a literal of fixed size and is broadcast.
    """
    mapping = mapping or DETAIL_KEYS
    rows = [(field, facility, key, i) for field, per in mapping.items() for facility, keys in per.items() for i, key in enumerate(keys)]
    where = F.broadcast(docs.sparkSession.createDataFrame(rows, "field string, __facility string, key string, priority int"))
    keys = sorted({r[2] for r in rows})
    met = docs.select(doc_col, facility_col).join(attributes.filter(F.col("key").isin(keys)).select(doc_col, "attr_id", "key", "value"), doc_col)
    met = met.join(where, (met[facility_col] == where["__facility"]) & (met["key"] == where["key"])).select(doc_col, "field", "priority", "attr_id", F.posexplode(split_detail(F.col("value"), F.col("field") == "authors")).alias("at", "part"))
    first = met.groupBy(doc_col, "field", F.lower("part").alias("low")).agg(F.min(F.struct("priority", "attr_id", "at", "part")).alias("p"))
    joined = first.groupBy(doc_col, "field").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["part"]), " - ").alias("text"))
    wide = joined.groupBy(doc_col).pivot("field", sorted(mapping)).agg(F.first("text"))
    return docs.select(doc_col, facility_col).join(wide, doc_col, "left")


def payload(results: DataFrame) -> DataFrame:
    """`results` with `scores`, a struct of what the query asked for; the rest is null."""
    on = lambda flag, c: F.when(F.col(flag), F.col(c)).alias(c)
    return results.withColumn(
        "scores",
        F.struct(
            on("has_intention", "document_score"), on("has_intention", "chunk_score"), on("has_keywords", "keywords_score"), on("has_conditions", "conditions_full_score"), on("has_conditions", "conditions_partial_score"),
            F.when(F.col("has_conditions"), F.col("conditions_full_score") > 0).alias("full_match"),
        ),
    )
