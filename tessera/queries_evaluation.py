"""Queries over evaluated runs: metrics by kind of test, comparisons and statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate
from tessera.queries import METRIC_SQL
from tessera.registry import register, table

TESTS = """t as (select l_orderkey % 7 as run_id, l_orderkey % 3 as s, l_linenumber % 4 as kind, cast(l_quantity as int) % 26 as r, 20 as k, case when l_linenumber - 2 <= 0 then 1 else l_linenumber - 2 end as e,
  case l_returnflag when 'A' then 'HR' when 'N' then 'LR' else 'NP' end as a, case l_orderkey % 3 when 0 then 'HR' when 1 then 'LR' else 'NP' end as x, cast(l_quantity as int) % 23 as p, l_partkey % 23 as q, l_suppkey % 23 as w from lineitem),
 ok as (select *, case when p between 1 and 20 and q between 1 and 20 and p < q then 1 else 0 end as g, case when q between 1 and 20 and w between 1 and 20 and q < w then 1 else 0 end as h from t)"""
_CELL = "case when r > 0 and r <= k then {} else 0.0 end"
VALUES = (
    f"{TESTS}, v as ("
    + " union all ".join(f"select run_id, s, kind, '{n}' as metric, {_CELL.format(f)} as value from ok where kind = 0" for n, f in METRIC_SQL.items())
    + f""" union all select run_id, s, kind, 'NP', 1.0 - {_CELL.format("1.0")} from ok where kind in (0, 1)
 union all select run_id, s, kind, 'EP', case when a = x then 1.0 when a <> 'NP' and x <> 'NP' then 0.6 else 0.0 end from ok where kind = 2
 union all select run_id, s, kind, 'CRP', (g + h) / 2.0 from ok where kind = 3 union all select run_id, s, kind, 'CAP', case when g + h = 2 then 1.0 else 0.0 end from ok where kind = 3)"""
)


def tests(spark: SparkSession, d: str) -> DataFrame:
    """A test for each line of an order: positive, negative, extended presence and comparative ones."""
    n, key, flag = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_returnflag")
    group = lambda c, *v: F.when(c == v[0], "HR").when(c == v[1], "LR").otherwise("NP")
    kinds = F.when(n % 4 == 0, "positive").when(n % 4 == 1, "negative").when(n % 4 == 2, "extended presence").otherwise("comparative")
    rank = lambda c: (F.col(c).cast("int") % 23).cast("int")
    return table(spark, d, "lineitem").select(
        (key % 7).alias("run_id"), F.monotonically_increasing_id().alias("test_id"), kinds.alias("type"), (F.col("l_quantity").cast("int") % 26).alias("rank"), F.array(rank("l_quantity"), rank("l_partkey"), rank("l_suppkey")).alias("ranks"), F.lit(20).alias("k"),
        (n - 2).cast("int").alias("expected_rank"), group(flag, "A", "N").alias("actual_group"), group(key % 3, 0, 1).alias("expected_group"), F.when(key % 3 == 0, "synthetic").when(key % 3 == 1, "expert").otherwise("other").alias("source"),
    )


@register(f"with {VALUES} select run_id, metric, count(*) as n, round(avg(value), 6) + 0.0 as value from v group by all")
def metrics_by_type(spark, d):
    found = evaluate.test_metrics(tests(spark, d)).groupBy("run_id", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    return found.withColumn("value", F.round("value", 6) + 0.0)


@register(f"with {VALUES} select run_id, 'c' || metric as metric, round(avg(value), 6) + 0.0 as value from v group by all union all select run_id, case s when 0 then 's' else 'e' end || metric, round(avg(value), 6) + 0.0 from v where kind = 0 and s < 2 group by run_id, s, metric")
def run_metrics_of_all_kinds(spark, d):
    from tessera.session import written

    t = written(tests(spark, d), "tests")  # numbered once, for both sides of the joins
    pairs = t.select(F.col("test_id").alias("tpid"), "source", "type")
    found = evaluate.run_metrics(evaluate.test_metrics(t), t.withColumn("tpid", F.col("test_id")), pairs)
    return found.withColumn("value", F.round("value", 6) + 0.0)


SCORES = "s as (select cast(year(o_orderdate) as varchar) as timestamp, o_orderstatus as test_name, o_orderpriority as dataset_name, round(avg(o_totalprice) / 1000000, 4) as avg_score from orders group by all)"


@register(f"with {SCORES}, m as (select timestamp, test_name, avg(avg_score) as score from s group by all) select timestamp, test_name, round(score, 8) as score from m union all select timestamp, null, round(avg(score), 8) from m group by timestamp")
def macro_means(spark, d):
    s = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("string").alias("timestamp"), F.col("o_orderstatus").alias("test_name"), F.col("o_orderpriority").alias("dataset_name")).agg(F.round(F.avg("o_totalprice") / 1000000, 4).alias("avg_score"))
    return evaluate.macro_means(s).withColumn("score", F.round("score", 8))


#: Odd configurations stand in both runs; the parsed query of every fifth differs, that of the others in blanks alone.
COMPARED = """b as (select l_orderkey % 3 as config, l_orderkey // 3 as query_index, max(l_discount) as o, max(l_tax) as n from lineitem group by all),
 e as (select query_index, case when abs(n - o) < 1e-12 then 0.0 else n - o end as delta, query_index % 5 = 0 as changed from b where config > 0),
 s as (select query_index, avg(delta) as average_delta, min(delta) as worst_delta, max(delta) as best_delta, bool_or(changed) as changed from e group by query_index),
 c as (select *, case when best_delta > 0 and worst_delta < 0 then 'mixed' when best_delta > 0 then 'better' when worst_delta < 0 then 'worse' else 'unchanged' end as direction from s)"""


def compared(spark: SparkSession, d: str) -> DataFrame:
    index = F.floor(F.col("l_orderkey") / 3).cast("long")
    runs = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 3).alias("config"), index.alias("query_index")).agg(F.max("l_discount").alias("o"), F.max("l_tax").alias("n"))
    text = lambda n: F.concat(F.lit('{"a":'), n.cast("string"), F.lit("}"))
    q = F.col("query_index")
    old = runs.filter("config > 0").select("config", "query_index", F.col("o").alias("score"), text(q).alias("query"))
    new = runs.select("config", "query_index", F.col("n").alias("score"), F.when(q % 5 == 0, text(q + 1)).otherwise(F.replace(text(q), F.lit(":"), F.lit(" :  "))).alias("query"))
    return evaluate.compare_runs(old, new)


@register(f"with {COMPARED} select query_index, round(average_delta, 6) + 0.0 as average_delta, changed, direction from c")
def run_compare_changed(spark, d):
    return compared(spark, d).select("query_index", (F.round("average_delta", 6) + 0.0).alias("average_delta"), "changed", "direction")


@register(f"with {COMPARED} select direction, count(*) as queries from c group by direction")
def direction_counts(spark, d):
    return evaluate.direction_counts(compared(spark, d))


@register(f"with {COMPARED} select query_index, round(worst_delta, 6) as worst_delta from c where worst_delta < 0 order by average_delta, query_index limit 20")
def worst_regressions(spark, d):
    return evaluate.regressions(compared(spark, d), 20).select("query_index", F.round("worst_delta", 6).alias("worst_delta"))


@register("with b as (select l_orderkey % 5 as config, l_returnflag as f from lineitem) select config, count(*) filter (f <> 'A') as old_rows, count(*) filter (config <> 2) as new_rows from b group by config having count(*) filter (f <> 'A') <> count(*) filter (config <> 2)")
def runs_of_unequal_length(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 5).alias("config"), "l_returnflag")
    return evaluate.unequal_runs(rows.filter("l_returnflag <> 'A'"), rows.filter("config <> 2"))


KNEES = "k as (select l_orderkey as query_id, max(l_discount) * 9.7 as knee, max(l_linenumber) as kept, count(*) as n from lineitem group by all)"


def knees(spark: SparkSession, d: str):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_discount") * 9.7).alias("knee_score"), F.col("l_linenumber").alias("keep_count"))
    return evaluate.knee_statistics(lines)


@register(f"with {KNEES} select round(avg(knee), 8) as mean_knee, round(quantile_cont(knee, 0.5), 8) as median_knee, round(100.0 * sum(kept) / sum(n), 6) as percent_kept, count(*) as queries from k")
def knee_summary(spark, d):
    return knees(spark, d)[0].withColumns({"mean_knee": F.round("mean_knee", 8), "median_knee": F.round("median_knee", 8), "percent_kept": F.round("percent_kept", 6)})


@register(f"with {KNEES} select least(cast(floor(knee * 20) as bigint) + 1, 20) as bin, count(*) as queries from k group by 1")
def knee_histogram(spark, d):
    return knees(spark, d)[1]
