import json

from pyspark.sql import functions as F

from tessera.operators import evaluate, text
from tessera.sources import readers, writers
from tessera.streaming.incremental import current_feedback, ingest, ingested, upsert_feedback, valid_feedback


def test_readers(spark, tmp_path):
    (tmp_path / "esrf.json").write_text(json.dumps([{"document": {"doi": " 10.1/a ", "title": "T", "summary": "S"}}, {"document": {"doi": ""}}, {"datacite": [{"attributes": {"doi": "10.2/b", "titles": [{"title": "P"}], "descriptions": [{"description": "no", "descriptionType": "Other"}, {"description": "yes", "descriptionType": "Abstract"}]}}]}]))
    raw = readers.records(spark, f"file://{tmp_path}/esrf.json")
    assert raw.count() == 3 and raw.first().facility == "esrf"
    docs = readers.standard_documents(raw)
    assert [(r.doi, r.title, r.text) for r in docs.collect()] == [("10.1/a", "T", "S")]
    assert [(r.doi, r.title, r.text) for r in readers.publication_documents(raw).collect()] == [("10.2/B", "P", "yes")]
    assert json.loads(readers.raw_record(docs, "10.1/a").first().raw)["document"]["title"] == "T"
    (tmp_path / "d.csv").write_text("key,description\n a , what it is \nb,\n")
    assert [tuple(r) for r in readers.key_descriptions(spark, f"file://{tmp_path}/d.csv").collect()] == [("a", "what it is")]
    (tmp_path / "set.json").write_text(json.dumps([{"doi": "x", "queries": [{"query": "q1", "min_position": 2}, {"query": "q2"}]}, {"doi": "y", "queries": [{"query": "q3"}]}]))
    got = [(r.doc_index, r.query_index, r.doi, r.query, r.min_position) for r in readers.query_sets(spark, f"file://{tmp_path}/set.json").collect()]
    assert got == [(0, 0, "x", "q1", 2), (0, 1, "x", "q2", 0), (1, 0, "y", "q3", 0)]
    (tmp_path / "pairs.json").write_text(json.dumps([{"query": '{"query": "in"}', "doi": "a, b", "type": "comparative", "id": "1"}, {"query": "{}", "doi": "a"}, {"query": " ", "doi": "a"}, {"query": "plain", "doi": "c"}]))
    got = [(r.query, r.targets, r.type) for r in readers.test_pairs(spark, f"file://{tmp_path}/pairs.json").collect()]
    assert got == [("in", ["a", "b"], "comparative"), ("plain", ["c"], "positive")]


def test_scores_go_out_and_come_back(spark, tmp_path):
    scores = spark.createDataFrame([("c", 1, 0.5), ("c", 0, 1.0), ("d", 0, 0.25)], "config string, query_index int, score double")
    rows = {r.config: json.loads(r.json) for r in writers.raw_score_json(scores).collect()}
    assert rows == {"c": [1.0, 0.5], "d": [0.25]}
    (tmp_path / "raw.json").write_text(json.dumps(rows))
    assert sorted(map(tuple, readers.raw_scores(spark, f"file://{tmp_path}/raw.json").collect())) == sorted(map(tuple, scores.collect()))
    summary = evaluate.sweep_summary(spark.createDataFrame([("c", "d1", 0.5), ("c", "d1", 0.25), ("c", "d2", 1.0)], "test_name string, dataset_name string, score double"))
    writers.write_results(summary, f"file://{tmp_path}/results_20260101_000000.csv")
    got = {r.dataset_name: (r.avg_score, r.avg_score_percent) for r in readers.results_over_runs(spark, f"file://{tmp_path}/results_20260101_000000.csv").collect()}
    assert got == {"d1": (0.375, 37.5), "d2": (1.0, 100.0)}


def test_ingest_is_incremental_and_first_wins(spark, tmp_path):
    kind = "doi string, n int"
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("src", "out", "mark"))
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], kind).coalesce(1).write.parquet(src)
    ingest(spark, src, kind, out, mark, order=["n"]).awaitTermination()
    spark.createDataFrame([("a", 0), ("c", 4)], kind).coalesce(1).write.mode("append").parquet(src)
    ingest(spark, src, kind, out, mark, order=["n"]).awaitTermination()
    ingest(spark, src, kind, out, mark, order=["n"]).awaitTermination()  # nothing new
    assert sorted(map(tuple, ingested(spark, out, kind).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_feedback(spark, tmp_path):
    kind = "statistic_id string, doc_id long, feedback_type string, created_at int"
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("src", "out", "mark"))
    spark.createDataFrame([("s", 1, "Match", 1), ("s", 1, "Relevant", 2)], kind).coalesce(1).write.parquet(src)
    upsert_feedback(spark, src, kind, out, mark).awaitTermination()
    spark.createDataFrame([("s", 1, "Suggested", 3), ("s", 2, "Match", 1)], kind).coalesce(1).write.mode("append").parquet(src)
    upsert_feedback(spark, src, kind, out, mark).awaitTermination()
    assert sorted((r.doc_id, r.feedback_type) for r in current_feedback(spark, out, kind).collect()) == [(1, "Suggested"), (2, "Match")]
    spark.createDataFrame([("s", 2, "Relevant", 9), ("t", 7, "Match", 1), ("s", 1, "Match", 0)], kind).coalesce(1).write.mode("append").parquet(src)
    upsert_feedback(spark, src, kind, out, mark).awaitTermination()
    assert sorted((r.statistic_id, r.doc_id, r.feedback_type) for r in current_feedback(spark, out, kind).collect()) == [("s", 1, "Suggested"), ("s", 2, "Relevant"), ("t", 7, "Match")]
    log = spark.range(1).selectExpr("'s' as id", "named_struct('relevant', array(named_struct('doc_id', 1L)), 'weakly_relevant', array(named_struct('doc_id', 3L)), 'knee_point', 0.5D) as results")
    rows = spark.createDataFrame([("s", 1, "Match", 1), ("s", 2, "Match", 1), ("s", 3, "nonsense", 1), ("t", 1, "Match", 1)], kind)
    assert [r.doc_id for r in valid_feedback(rows, log).collect()] == [1]


def test_keywords_with_stems(spark):
    docs = spark.createDataFrame([(1, "Relations and relational data"), (2, "the data"), (3, None)], "doc_id long, text string")
    index = text.postings(docs)
    q = spark.createDataFrame([(1, ["relation", "the"]), (2, ["data"]), (3, [])], "query_id int, terms array<string>")
    got = sorted((r.query_id, r.doc_id, r.rank) for r in text.rank_keywords(q, index).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 2, 1)]


def test_run_comparison(spark):
    kind = "config string, query_index int, score double, query string"
    old = spark.createDataFrame([("a", 0, 0.5, '{"x": 1}'), ("b", 0, 0.5, None), ("a", 1, 0.5, None), ("old", 0, 1.0, None)], kind)
    new = spark.createDataFrame([("a", 0, 0.6, '{"x":1}'), ("b", 0, 0.4, None), ("a", 1, 0.5 + 1e-13, '{"y": 1}')], kind)
    got = {r.query_index: (r.direction, r.changed) for r in evaluate.compare_runs(old, new).collect()}
    assert got == {0: ("mixed", False), 1: ("unchanged", False)}
    compared = evaluate.compare_runs(old, new)
    assert {r.direction: r.queries for r in evaluate.direction_counts(compared).collect()} == {"mixed": 1, "unchanged": 1}
    assert [r.query_index for r in evaluate.regressions(compared, 5).collect()] == [0]
    assert [tuple(r) for r in evaluate.unequal_runs(old, new).collect()] == [("old", 1, 0)]
