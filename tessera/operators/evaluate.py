"""Evaluation of result lists: target ranks, metrics, sweeps and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.metrics import crp, cap, extended_presence, min_position, pointwise
from tessera.operators.postrank import COMPONENTS
from tessera.plans.hybrid import fuse, top_results
from tessera.session import written

EQUAL = 1e-12
SET_PREFIX = {"comprehensive": "c", "synthetic": "s", "expert": "e"}


def target_ranks(results: DataFrame, targets: DataFrame, by: tuple[str, ...] = ("query_id",), doc_col: str = "doc_id", position_col: str = "position") -> DataFrame:
    """`targets` with `rank`: the target's position in its results, 0 if it is not there."""
    found = results.select(*by, F.col(doc_col).alias("target_id"), F.col(position_col).alias("rank"))
    return targets.join(found, [*by, "target_id"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)).cast("int"))


def test_metrics(tests: DataFrame) -> DataFrame:
    """`run_id, test_id, metric, value` for tests of (run_id, test_id, type, rank, ranks, k, expected_rank, actual_group, expected_group).

    Positive tests have the pointwise metrics, negative ones NP, extended
    presence EP, comparative ones CRP and CAP.
    """
    one = pointwise(F.col("rank"), F.col("k"), F.col("expected_rank"))
    cells = lambda names: F.array(*[F.struct(F.lit(n).alias("metric"), names[n].cast("double").alias("value")) for n in names])
    chosen = (
        F.when(F.col("type") == "positive", cells(one))
        .when(F.col("type") == "negative", cells({"NP": one["NP"]}))
        .when(F.col("type") == "extended presence", cells({"EP": extended_presence(F.col("actual_group"), F.col("expected_group"))}))
        .when(F.col("type") == "comparative", cells({"CRP": crp(F.col("ranks"), F.col("k")), "CAP": cap(F.col("ranks"), F.col("k"))}))
    )
    return tests.select("run_id", "test_id", F.explode(chosen).alias("m")).select("run_id", "test_id", "m.*")


def run_metrics(values: DataFrame, tests: DataFrame, pairs: DataFrame) -> DataFrame:
    """`run_id, metric, value`: means over all tests (`c...`) and over the positive ones of each source (`s...`, `e...`).

    One pass with grouping sets; means leave nulls out.
    """
    all_ = values.join(tests.select("run_id", "test_id", "tpid"), ["run_id", "test_id"]).join(pairs.select("tpid", "source", "type"), "tpid")
    all_ = all_.select("run_id", "metric", "value", F.when(F.col("type") == "positive", F.col("source")).alias("source"))
    sums = all_.groupingSets([["run_id", "metric"], ["run_id", "metric", "source"]], "run_id", "metric", "source").agg(F.grouping("source").alias("g"), F.avg("value").alias("value"))
    prefix = F.when(F.col("g") == 1, "c").when(F.col("source") == "synthetic", "s").when(F.col("source") == "expert", "e")
    return sums.filter(prefix.isNotNull()).select("run_id", F.concat(prefix, "metric").alias("metric"), "value")


def config_sweep(ranks: DataFrame, configs: DataFrame, targets: DataFrame, limit: int = 20) -> DataFrame:
    """`test_name, query_id, rank, score` for every enabled configuration and target.

    Ranks are found once: each row meets the configurations (a table of fixed
    size), whose constants default to 60. The score is that of the least position.
    """
    c = configs.filter(~F.coalesce("disabled", F.lit(False))).select("test_name", *[F.coalesce(f"rrf_k_{x}", F.lit(60)).alias(f"k_{x}") for x in COMPONENTS])
    keys = ("test_name", *[f"k_{x}" for x in COMPONENTS])
    fused = fuse(ranks.crossJoin(F.broadcast(c)), by=keys)
    top = top_results(fused, limit, by=("test_name",))
    asked = targets.crossJoin(F.broadcast(c.select("test_name")))
    found = target_ranks(top, asked, ("test_name", "query_id"))
    return found.withColumn("score", min_position(F.col("rank"), F.col("min_position"), limit))


def sweep_summary(scores: DataFrame) -> DataFrame:
    """`test_name, dataset_name, avg_score, avg_score_percent, queries`: per data set, and over all queries (null data set)."""
    up = scores.rollup("test_name", "dataset_name").agg(F.avg("score").alias("s"), F.count("*").alias("queries")).filter("test_name is not null")
    return up.select("test_name", "dataset_name", F.round("s", 4).alias("avg_score"), F.round(F.col("s") * 100, 2).alias("avg_score_percent"), "queries")


def macro_means(results: DataFrame, run_col: str = "timestamp") -> DataFrame:
    """`run_col, test_name, score`: the mean over data sets, and over the configurations (null name)."""
    per = results.groupBy(run_col, "test_name").agg(F.avg("avg_score").alias("score"))
    return per.unionByName(per.groupBy(run_col).agg(F.avg("score").alias("score")).withColumn("test_name", F.lit(None).cast("string")))


def score_pivot(scores: DataFrame, rows: str = "dataset_name", columns: str = "test_name", names: list[str] | None = None) -> DataFrame:
    """A row for each data set, a column for each configuration."""
    return scores.groupBy(rows).pivot(columns, names).agg(F.first("avg_score"))


def compare_runs(old: DataFrame, new: DataFrame, eps: float = EQUAL) -> DataFrame:
    """`query_index` with the deltas over the configurations that both runs have.

    `average_delta, worst_delta, best_delta, direction, changed`: differences
    under `eps` are none; changed tells whether the parsed query differs in the
    two runs (false unless both have one).
    """
    delta = F.col("new_score") - F.col("old_score")
    query = lambda c: F.to_json(F.try_parse_json(c))
    both = old.select("config", "query_index", F.col("score").alias("old_score"), F.col("query").alias("old_query")).join(new.select("config", "query_index", F.col("score").alias("new_score"), F.col("query").alias("new_query")), ["config", "query_index"])
    each = both.withColumn("delta", F.when(F.abs(delta) < eps, 0.0).otherwise(delta)).withColumn("changed", F.coalesce(query("old_query") != query("new_query"), F.lit(False)))
    sums = each.groupBy("query_index").agg(F.avg("delta").alias("average_delta"), F.min("delta").alias("worst_delta"), F.max("delta").alias("best_delta"), F.max("changed").alias("changed"))
    up, down = F.col("best_delta") > 0, F.col("worst_delta") < 0
    return sums.withColumn("direction", F.when(up & down, "mixed").when(up, "better").when(down, "worse").otherwise("unchanged"))


def direction_counts(compared: DataFrame) -> DataFrame:
    """`direction, queries`: how many queries went which way."""
    return compared.groupBy("direction").agg(F.count("*").alias("queries"))


def regressions(compared: DataFrame, limit: int | None = None) -> DataFrame:
    """The queries that lost under some configuration, the largest mean loss first."""
    rows = compared.filter(F.col("worst_delta") < 0).orderBy("average_delta", "query_index")
    return rows if limit is None else rows.limit(limit)


def unequal_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """`config, old_rows, new_rows` for configurations whose numbers of scores differ in the two runs."""
    n = lambda df, name: df.groupBy("config").agg(F.count("*").alias(name))
    both = n(old, "old_rows").join(n(new, "new_rows"), "config", "full").fillna(0)
    return both.filter("old_rows <> new_rows")


def quantiles(df: DataFrame, by: str, value: str, probabilities: list[float]) -> DataFrame:
    """`by, q, n`: exact quantiles of each group, linear between neighbours, as an array; nulls are left out.

    Equal values are counted first. The distinct ones are dealt out in ranges
    whose totals are added up, so a group of any size has its places found by
    many tasks; no task holds the values of a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("__by"), F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("c"))
    dealt = written(counts.repartitionByRange("__by", "__v").withColumn("part", F.spark_partition_id()), "values")
    totals = dealt.groupBy("__by", "part").agg(F.sum("c").alias("t"))  # a row for each range and group in it
    before = W.partitionBy("__by").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("__by", "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("before"), F.sum("t").over(W.partitionBy("__by")).alias("n"))
    inside = W.partitionBy("part", "__by").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn("upto", F.sum("c").over(inside)).join(totals.withColumnsRenamed({"__by": "__g", "part": "__p"}), (F.col("part") == F.col("__p")) & F.col("__by").eqNullSafe(F.col("__g")))
    low, high = F.col("before") + F.col("upto") - F.col("c"), F.col("before") + F.col("upto")
    at = lambda k: F.max(F.when((low <= k) & (k < high), F.col("__v")))
    cells = []
    for i, p in enumerate(probabilities):
        k = F.lit(p) * (F.col("n") - 1)
        cells += [at(F.floor(k)).alias(f"a{i}"), at(F.ceil(k)).alias(f"b{i}"), F.max(k - F.floor(k)).alias(f"f{i}")]
    found = placed.groupBy("__by").agg(F.max("n").alias("n"), *cells)
    return found.select(F.col("__by").alias(by), F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}") for i in range(len(probabilities))]).alias("q"), "n")


def score_distribution(scores: DataFrame, by: str = "test_name", score: str = "score") -> DataFrame:
    """`by, q1, median, q3, low, high, n`: quartiles, and the extremes within 1.5 spreads of them."""
    q = written(quantiles(scores, by, score, [0.25, 0.5, 0.75]), "quartiles")
    spread = 1.5 * (F.get("q", F.lit(2)) - F.get("q", F.lit(0)))
    within = scores.join(q, by).filter(F.col(score).between(F.get("q", F.lit(0)) - spread, F.get("q", F.lit(2)) + spread))
    ends = within.groupBy(by).agg(F.min(score).alias("low"), F.max(score).alias("high"))
    return q.join(ends, by).select(by, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "low", "high", "n")


def knee_statistics(cut: DataFrame, query_col: str = "query_id", bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """Mean and median of the knee scores with the share of rows kept, and a histogram of the knee scores."""
    per = written(cut.groupBy(query_col).agg(F.max("knee_score").alias("knee"), F.max("keep_count").alias("kept"), F.count("*").alias("n")), "knees")
    median = quantiles(per.withColumn("one", F.lit(1)), "one", "knee", [0.5])
    sums = per.agg(F.avg("knee").alias("mean_knee"), (100.0 * F.sum("kept") / F.sum("n")).alias("percent_kept"), F.count("*").alias("queries")).withColumn("one", F.lit(1))
    summary = sums.join(median.drop("n"), "one", "left").select("mean_knee", F.get("q", F.lit(0)).alias("median_knee"), "percent_kept", "queries")
    histogram = per.groupBy(F.least(F.width_bucket("knee", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("queries"))
    return summary, histogram


def component_breakdown(results: DataFrame, targets: DataFrame, by: str = "query_id") -> DataFrame:
    """`targets` with the overall and component scores of the target in its results, 0 where it is not there."""
    scores = ["overall_score", *[f"{c}_score" for c in COMPONENTS]]
    found = results.select(by, F.col("doc_id").alias("target_id"), *scores)
    return targets.join(found, [by, "target_id"], "left").fillna(0.0, scores)
