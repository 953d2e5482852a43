"""Hybrid search: the rankings of a table of queries, fused into top results."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import rrf_score
from tessera.operators.postrank import COMPONENTS, DEFAULT_K, buckets, knee_cut, normalise_scores

SCORES = ["overall_score", *(f"{c}_score" for c in COMPONENTS)]


@dataclass
class SearchConfig:
    """The constants of the fusion, the cut and the size of the result."""

    k: dict[str, int] = field(default_factory=lambda: dict(DEFAULT_K))
    limit: int = 20
    min_top: float = 0.25
    min_results: int = 3
    eps: float = 0.02


def branches(documents: DataFrame | None = None, chunks: DataFrame | None = None, conditions: DataFrame | None = None, keywords: DataFrame | None = None, query_col: str = "query_id", doc_col: str = "doc_id") -> DataFrame:
    """`query_col, doc_col` and a rank for each component: the union of the branches that are given.

    `conditions` has full_match and partial_rank, the others have rank. Ranks
    do not depend on any constant of the fusion, so many configurations can
    share them. A branch that is left out costs nothing.
    """
    def of(df: DataFrame, **ranks: Column) -> DataFrame:
        none = F.lit(None).cast("int")
        return df.filter(F.col(doc_col).isNotNull()).select(query_col, doc_col, *[ranks.get(c, none).cast("int").alias(c) for c in COMPONENTS])

    parts = []
    if documents is not None:
        parts.append(of(documents, document=F.col("rank")))
    if chunks is not None:
        parts.append(of(chunks, chunk=F.col("rank")))
    if conditions is not None:
        parts.append(of(conditions, conditions_full=F.col("full_match"), conditions_partial=F.col("partial_rank")))
    if keywords is not None:
        parts.append(of(keywords, keywords=F.col("rank")))
    if not parts:
        raise ValueError("a search needs one branch at least")
    return reduce(DataFrame.unionByName, parts)


def condition_branch(conditions: DataFrame, queries: DataFrame, others: DataFrame | None, limit: int = 20, query_col: str = "query_id", doc_col: str = "doc_id") -> DataFrame:
    """`query_col, doc_col, full_match, partial_rank`: what of the trees' rankings can reach a query's top `limit`.

    `conditions` is (tree_id, doc_col, full_match, partial_rank), `queries`
    (query_col, tree_id). A query needs the ranks of the documents that its
    other branches found, and of documents that meet its conditions alone the
    first `limit` of either kind, with and without a full match: among those
    the order is that of the partial rank and the id whatever the constants of
    the fusion are. So no tree is multiplied with all its queries.
    """
    cols = [query_col, doc_col, "full_match", "partial_rank"]
    found = queries.join(first_of(conditions, ["tree_id", "full_match"], "partial_rank", limit, doc_col), "tree_id").select(*cols)
    if others is not None:
        met = others.select(query_col, doc_col).distinct().join(queries.select(query_col, "tree_id"), query_col)
        found = found.unionByName(met.join(conditions, ["tree_id", doc_col]).select(*cols)).distinct()
    return found


def _reciprocals(k: dict[str, int] | None, given: bool = False) -> dict[str, Column]:
    """The score of each component's rank."""
    k = DEFAULT_K | (k or {})
    return {c: F.coalesce(rrf_score(F.col(c), F.col(f"k_{c}") if given else k[c]), F.lit(0.0)) for c in COMPONENTS}


def _overall() -> Column:
    return reduce(Column.__add__, [F.col(f"{c}_score") for c in COMPONENTS])


def best_of_both(conditions: DataFrame, keywords: DataFrame, both: DataFrame, config: SearchConfig, doc_col: str = "doc_id") -> DataFrame:
    """`both, doc_col`: the top `config.limit` of the documents that a tree and a list of words both find, for each pair of these.

    `conditions` is (tree_id, doc_col, full_match, partial_rank), `keywords`
    (words_id, doc_col, rank), `both` (both, tree_id, words_id).
    """
    none = F.lit(None).cast("int")
    met = conditions.join(both, "tree_id").join(keywords.hint("merge"), ["words_id", doc_col])
    ranks = met.select("both", doc_col, none.alias("document"), none.alias("chunk"), F.col("full_match").alias("conditions_full"), F.col("partial_rank").alias("conditions_partial"), F.col("rank").alias("keywords"))
    scored = ranks.withColumns({f"{c}_score": v for c, v in _reciprocals(config.k).items()}).withColumn("overall_score", _overall())
    return top_results(scored, config.limit, "both", doc_col).select("both", doc_col)


def first_of(ranked: DataFrame, by: list[str], rank: str, limit: int, doc_col: str = "doc_id") -> DataFrame:
    """The `limit` rows of each group that come first by rank and id."""
    return ranked.withColumn("__at", F.row_number().over(W.partitionBy(*by).orderBy(rank, doc_col))).filter(F.col("__at") <= limit).drop("__at")


def fuse(ranks: DataFrame, k: dict[str, int] | None = None, query_col: str = "query_id", doc_col: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """`query_col, doc_col, overall_score` and the five scores: sums of reciprocal ranks.

    With `by` the constants are columns `k_<component>` of `ranks` and those
    columns group too: that is how a table of configurations is swept.
    """
    one = _reciprocals(k, bool(by))
    sums = ranks.groupBy(*by, query_col, doc_col).agg(*[F.sum(v).alias(f"{c}_score") for c, v in one.items()])
    return sums.withColumn("overall_score", _overall())


def top_results(fused: DataFrame, limit: int = 20, query_col: str = "query_id", doc_col: str = "doc_id", by: tuple[str, ...] = (), decimals: int = 9) -> DataFrame:
    """The `limit` best rows of each query with their `position` from 1.

    Order: all six scores downwards (at `decimals` places, so that sums of the
    same ranks tie), then the document's id, so results are repeatable.
    """
    w = W.partitionBy(*by, query_col).orderBy(*[F.desc(F.round(c, decimals)) for c in SCORES], doc_col)
    return fused.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def search(ranks: DataFrame, active: DataFrame, config: SearchConfig | None = None, details: DataFrame | None = None, query_col: str = "query_id", doc_col: str = "doc_id") -> DataFrame:
    """The whole run from ranks: fusion, top results, details, normalised scores, knee cut and buckets.

    `active` is (query_col, has_intention, has_conditions, has_keywords), one
    row a query. Results without details are dropped.
    """
    config = config or SearchConfig()
    top = top_results(fuse(ranks, config.k, query_col, doc_col), config.limit, query_col, doc_col).drop("position")
    if details is not None:
        top = top.join(details, doc_col)
    scored = normalise_scores(top.join(active, query_col), config.k)
    return buckets(knee_cut(scored, query_col, "overall_score", (doc_col,), config.min_top, config.min_results, config.eps))


def active_flags(queries: DataFrame, with_conditions: Column, query_col: str = "query_id", intention_col: str = "intention", terms_col: str = "terms") -> DataFrame:
    """`query_col, has_intention, has_conditions, has_keywords` by what a query holds."""
    return queries.select(query_col, (F.trim(F.coalesce(intention_col, F.lit(""))) != "").alias("has_intention"), with_conditions.alias("has_conditions"), (F.coalesce(F.size(terms_col), F.lit(0)) > 0).alias("has_keywords"))


def parse_fallback(queries: DataFrame, query_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """`query_col, intention, keywords, filters` of raw query texts.

    A JSON object gives its own fields, missing ones empty; any other text is
    the intention, its words the keywords; blank text gives an empty query.
    """
    got = F.from_json(F.when(F.trim(text_col).startswith("{"), F.col(text_col)), "intention string, keywords array<string>, filters string", {"mode": "PERMISSIVE"})
    plain = F.trim(F.coalesce(text_col, F.lit("")))
    none = F.array().cast("array<string>")
    words = F.when(plain == "", none).otherwise(F.split(plain, r"\s+"))
    asked = F.trim(text_col).startswith("{") & F.try_parse_json(F.col(text_col)).isNotNull()
    asked = F.coalesce(asked, F.lit(False))
    return queries.select(
        query_col,
        F.when(asked, F.coalesce(got["intention"], F.lit(""))).otherwise(plain).alias("intention"),
        F.when(asked, F.coalesce(got["keywords"], none)).otherwise(words).alias("keywords"),
        F.when(asked, got["filters"]).alias("filters"),
    )
