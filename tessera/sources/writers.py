"""Writers of results, scores and the search log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(summary: DataFrame, path: str) -> None:
    """Scores per configuration and data set as CSV, four and two places."""
    summary.filter("dataset_name is not null").select("test_name", "dataset_name", F.round("avg_score", 4).alias("avg_score"), F.round("avg_score_percent", 2).alias("avg_score_percent")).write.mode("overwrite").csv(path, header=True)


def raw_score_json(scores: DataFrame) -> DataFrame:
    """`config, json`: the scores of each configuration as a JSON list, in the order of the queries."""
    return scores.groupBy("config").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("query_index", "score"))), lambda x: x["score"])).alias("json"))


def export_results(results: DataFrame, path: str) -> None:
    """DOI, title, facility, label and score as CSV with doubled quotes."""
    rows = results.select(F.col("doi").alias("DOI"), F.col("title").alias("Title"), F.col("facility").alias("Facility"), F.col("bucket").alias("Relevance"), F.col("overall_score").alias("Overall Score"))
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def log_rows(results: DataFrame, queries: DataFrame, query_col: str = "query_id") -> DataFrame:
    """A row of the search log for each query: relevant and weakly relevant results, the knee, the parent.

    The id is a hash of the query's natural key, so a rerun appends the same id.
    """
    one = F.struct("position", "doc_id", "overall_score")
    lists = results.groupBy(query_col).agg(
        F.sort_array(F.collect_list(F.when(F.col("kept"), one))).alias("relevant"), F.sort_array(F.collect_list(F.when(~F.col("kept"), one))).alias("weakly_relevant"), F.max("knee_score").alias("knee_point")
    )
    joined = queries.join(lists, query_col, "left")
    return joined.select(F.sha2(F.concat_ws("|", F.col(query_col).cast("string"), "search_query"), 256).alias("id"), "search_query", "structured_data", F.struct("relevant", "weakly_relevant", "knee_point").alias("results"), "modified_query_id", "created_at")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
