from pyspark.sql import functions as F

from tessera.operators.postrank import COMPONENTS, buckets, document_details, knee_cut, normalise_scores, payload
from tessera.plans.hybrid import active_flags, branches, fuse, parse_fallback, top_results


def cut(spark, scores, **options):
    df = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)], "query_id int, doc_id long, overall_score double")
    return sorted((r.position, r.kept) for r in knee_cut(df, **options).collect())


def kept(spark, scores, **options):
    return sum(k for _, k in cut(spark, scores, **options))


def test_knee(spark):
    assert kept(spark, [0.2, 0.1, 0.05, 0.01]) == 0  # too low at the top
    assert kept(spark, [0.9, 0.1]) == 2  # too few
    assert kept(spark, [1.0, 0.8, 0.6, 0.4, 0.2]) == 5  # a line
    assert kept(spark, [0.9, 0.85, 0.2, 0.19, 0.18]) == 2  # before the knee
    assert kept(spark, [0.9, 0.2, 0.2, 0.2, 0.1]) == 4  # through the plateau
    assert kept(spark, [0.5] * 4) == 4 and kept(spark, []) == 0
    flags = [k for _, k in cut(spark, [0.95, 0.9, 0.3, 0.25, 0.2, 0.1])]
    assert flags == sorted(flags, reverse=True)  # a prefix


def test_normalised_scores(spark):
    top = {c: 1 / (1 + k) for c, k in zip(COMPONENTS, (6, 6, 6, 6, 10))}
    row = spark.createDataFrame([(1, True, True, True, sum(top.values()), *top.values()), (2, True, False, False, 2 / 7, *top.values())], "doc_id int, has_intention boolean, has_conditions boolean, has_keywords boolean, overall_score double, " + ", ".join(f"{c}_score double" for c in COMPONENTS))
    a, b = normalise_scores(row).orderBy("doc_id").collect()
    assert all(abs(a[f"{c}_score"] - 1) < 1e-12 for c in COMPONENTS) and abs(a.overall_score - 1) < 1e-12
    assert b.conditions_full_score == b.keywords_score == 0 and abs(b.overall_score - 1) < 1e-12
    p = payload(normalise_scores(row)).orderBy("doc_id").collect()
    assert p[1].scores.keywords_score is None and p[0].scores.full_match is True


def test_buckets(spark):
    df = spark.createDataFrame([(1, True, 0.95), (2, True, 0.5), (3, False, 0.99)], "i int, kept boolean, overall_score double")
    assert [r.bucket for r in buckets(df).orderBy("i").collect()] == ["matched", "relevant", "suggested"]


def test_branch_order_and_inactive_branches_change_nothing(spark):
    docs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, None, 3)], "query_id int, doc_id long, rank int")
    words = spark.createDataFrame([(1, 11, 1)], "query_id int, doc_id long, rank int")
    get = lambda r: sorted(map(tuple, fuse(r).collect()))
    both = branches(documents=docs, keywords=words)
    assert get(both) == get(both.orderBy(F.desc("doc_id"))) == get(branches(documents=docs, keywords=words, chunks=docs.limit(0)))
    top = top_results(fuse(both), 1).collect()
    assert [r.doc_id for r in top] == [11] and abs(top[0].overall_score - (1 / 8 + 1 / 11)) < 1e-12


def test_details(spark):
    docs = spark.createDataFrame([(1, "ESRF"), (2, "PSI"), (3, "nowhere"), (4, None)], "doc_id long, facility string")
    rows = [(1, "beamline", "ID16", 2), (1, "instruments.name", "id16, Other", 1), (1, "creators.name", "Ann Bee, Cee Dee", 3), (1, "contributors.name", "Last, First", 4), (2, "creator", "ann bee", 5), (2, "publicationYear", "2020", 6), (3, "beamline", "x", 7)]
    got = {r.doc_id: (r.authors, r.instrument_name, r.publication_year) for r in document_details(docs, spark.createDataFrame(rows, "doc_id long, key string, value string, attr_id long")).collect()}
    assert got == {1: ("Ann Bee - Cee Dee - Last, First", "ID16 - Other", None), 2: ("ann bee", None, "2020"), 3: (None, None, None), 4: (None, None, None)}


def test_fallback_queries(spark):
    q = spark.createDataFrame([(1, "neutron  spin"), (2, " "), (3, None), (4, '{"intention": "x", "keywords": ["a"]}'), (5, "{broken")], "query_id int, query string")
    got = {r.query_id: (r.intention, r["keywords"]) for r in parse_fallback(q).collect()}
    assert got == {1: ("neutron  spin", ["neutron", "spin"]), 2: ("", []), 3: ("", []), 4: ("x", ["a"]), 5: ("{broken", ["{broken"])}
    flags = active_flags(spark.createDataFrame([(1, "x", ["a"]), (2, "", []), (3, None, None)], "query_id int, intention string, terms array<string>"), F.lit(False)).collect()
    assert [(r.has_intention, r.has_keywords) for r in flags] == [(True, True), (False, False), (False, False)]
