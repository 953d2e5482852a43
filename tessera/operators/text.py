"""Full text: postings and the keyword ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.embed import STOP_WORDS
from tessera.functions.english import stemmed, tokens
from tessera.operators.vectors import _dense_rank

DEFAULT_WEIGHT = 0.1
#: Terms of all queries up to which they are sent to every task.
BROADCAST_TERMS = 200_000


def _whole(*columns: str | None) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns if c])


def _numbered(text: Column, stem: bool) -> Column:
    """The words of a text and their places, without stop words; with `stem` also whether a word has a stem."""
    if stem:
        found = F.transform(tokens(text), lambda t, i: F.struct(t["token"].alias("word"), t["word"].alias("plain"), (i + 1).alias("at")))
    else:
        found = F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w, i: F.struct(w.alias("word"), (i + 1).alias("at")))
    return F.filter(found, lambda x: ~x["word"].isin(STOP_WORDS))


def _rooted(each: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Rows of (word, plain) with their `term`, of those alone that `wanted` has if it is given."""
    roots = each.select("word", "plain").distinct().withColumn("term", F.when(F.col("plain"), stemmed("word")).otherwise(F.col("word")))
    return each.join(roots if wanted is None else roots.join(wanted, "term"), ["word", "plain"])


def postings(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, stem: bool = True) -> DataFrame:
    """`doc_col, term, tf, positions`: where each term stands in title and text, from 1.

    With `stem` terms are those of an English dictionary: tokens by their
    types, words by their stems, of which the stemmer sees each once; without,
    they are runs of letters and digits. Stop words count as places but are no
    terms. All positions are kept. Null texts have no terms.
    """
    each = docs.select(doc_col, F.explode(_numbered(_whole(title_col, text_col), stem)).alias("w")).select(doc_col, "w.*")
    each = _rooted(each).select(doc_col, "term", "at") if stem else each.withColumnRenamed("word", "term")
    return each.groupBy(doc_col, "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("positions"))


def term_counts(docs: DataFrame, asked: DataFrame, doc_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, stem: bool = True) -> DataFrame:
    """`doc_col, term, tf` of the terms in `asked` (query, term) alone, for rankings that need no places.

    Words that no query asks for go before the shuffle: the asked terms are a
    query table's and are broadcast up to `BROADCAST_TERMS` of them.
    """
    text = _whole(title_col, text_col)
    wanted = asked.select("term").distinct()
    if wanted.count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    if not stem:
        each = docs.select(doc_col, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("term"))
        counts = each.join(wanted, "term").groupBy(doc_col, "term").agg(F.count("*").alias("tf"))
        return counts.filter(~F.col("term").isin(STOP_WORDS))
    each = docs.select(doc_col, F.explode(_numbered(text, True)).alias("w")).groupBy(doc_col, "w.word", "w.plain").agg(F.count("*").alias("tf"))
    return _rooted(each, wanted).groupBy(doc_col, "term").agg(F.sum("tf").alias("tf"))


def asked_terms(queries: DataFrame, query_col: str = "query_id", terms_col: str = "terms", stem: bool = True) -> DataFrame:
    """`query_col, term`: a query's terms as the index has them; stop words go."""
    asked = queries.select(query_col, F.explode(terms_col).alias("word")).select(query_col, F.lower("word").alias("word")).distinct()
    asked = asked.filter(~F.col("word").isin(STOP_WORDS))
    return asked.select(query_col, F.when(F.col("word").rlike(r"^[\p{L}\p{M}]+$"), stemmed("word")).otherwise(F.col("word")).alias("term")).distinct() if stem else asked.withColumnRenamed("word", "term")


def rank_keywords(queries: DataFrame, index: DataFrame, query_col: str = "query_id", terms_col: str = "terms", doc_col: str = "doc_id", stem: bool = True) -> DataFrame:
    """`query_col, doc_col, score, rank`: documents with any of a query's terms.

    The score is that of cover density for terms joined by OR: a tenth for each
    place where a term stands. Queries without terms have no rows.
    """
    asked = asked_terms(queries, query_col, terms_col, stem)
    met = index.join(asked, "term").groupBy(query_col, doc_col).agg(F.sum("tf").alias("places"))
    ranked = _dense_rank(met, query_col, (F.col("places"), True))
    return ranked.select(query_col, doc_col, (F.col("places") * DEFAULT_WEIGHT).alias("score"), "rank")
