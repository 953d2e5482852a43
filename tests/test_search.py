import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.embed import embedding, hashed_encoder
from tessera.operators.attributes import typed
from tessera.plans.hybrid import SearchConfig
from tessera.plans.search import Corpus, search
from tessera.session import written


def corpus(spark, inner=True):
    texts = [(1, "neutron scattering of crystals"), (2, "silver samples under x-rays"), (3, "cats on mats"), (4, "crystals of silver")]
    docs = spark.createDataFrame([(i, f"10.1/{i}", t) for i, t in texts], "document_id long, doc_id string, title string").withColumn("vector", embedding(hashed_encoder)("title"))
    chunks = docs.filter("document_id <> 3").select("document_id", "vector").unionByName(spark.createDataFrame([(99, None)], "document_id long, vector array<float>"))
    attributes = typed(spark.createDataFrame([(1, "energy", "5", "meV"), (2, "energy", "7", "keV"), (4, "name", "silver", None), (99, "name", "silver", None)], "document_id long, key string, value string, unit string"))
    keys = spark.createDataFrame([("energy",), ("name",)], "key string").withColumn("vector", embedding(hashed_encoder)("key"))
    return Corpus(docs, chunks, attributes, docs.select("doc_id", F.col("title").alias("text")), keys)


def ask(spark, *rows):
    return spark.createDataFrame([(i, t, k, json.dumps(f) if f else None) for i, (t, k, f) in enumerate(rows)], "query_id long, intention string, keywords array<string>, filters string")


def test_queries_of_all_kinds_in_one_call(spark):
    leaf = lambda n, o, v, **u: {"name": n, "operator": o, "value": v, **u}
    queries = ask(spark, ("neutron scattering of crystals", [], None), ("", ["silver"], None), (" ", [], leaf("energy", ">", 1, unit="eV")), ("", [], {"logic": "OR", "conditions": [leaf("name", "=", "silver"), leaf("energy", "<", 6, unit="meV")]}), ("", [], None), (None, [], leaf("energy", "IN", [])))
    found = search(queries, None, corpus(spark), name_threshold=0.1, least_names=1).collect()
    top = {}
    for r in sorted(found, key=lambda r: r.position):
        top.setdefault(r.query_id, []).append(r.doc_id)
    assert top[0][0] == "10.1/1" and set(top[1]) == {"10.1/2", "10.1/4"} and top[2] == ["10.1/2"] and set(top[3]) == {"10.1/1", "10.1/4"}
    assert set(top) == {0, 1, 2, 3}
    assert {r.title for r in found} <= {"neutron scattering of crystals", "silver samples under x-rays", "crystals of silver", "cats on mats"}
    assert all(0 < r.overall_score <= 1 for r in found)


def test_a_search_needs_a_branch(spark):
    docs = spark.createDataFrame([("a", 1)], "doc_id string, n int")
    with pytest.raises(ValueError):
        search(ask(spark, ("x", [], None)), None, Corpus(docs))


def test_equal_words_and_trees_are_ranked_once_and_limits_lose_nothing(spark, monkeypatch):
    rng, words = random.Random(3), ["crystal", "silver", "neutron", "mat", "ray"]
    docs = spark.createDataFrame([(i, f"10.1/{i:02}", " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(40)], "document_id long, doc_id string, title string").withColumn("vector", embedding(hashed_encoder)("title"))
    attributes = spark.createDataFrame([(i, "energy", str(rng.randrange(4)), None) for i in range(45)] + [(i, "name", rng.choice(words), None) for i in range(0, 45, 2)], "document_id long, key string, value string, unit string")
    everything = Corpus(docs, None, attributes, docs.select("doc_id", F.col("title").alias("text")), typing=typed)
    tree = lambda n: {"logic": "OR", "conditions": [{"name": "energy", "operator": ">", "value": n}, {"name": "name", "operator": "LIKE", "value": "s"}]}
    rows = [("silver crystal", ["silver"], tree(1)), ("", ["mat", "ray"], tree(2)), ("", ["Ray", "mat", "mat"], None), ("", [], tree(1)), ("neutron", ["crystal"], None), ("mat ray", ["ray", "mat"], tree(2))]
    ranked = []
    for copies in (1, 4):
        counts = {}

        def counted(df, name, counts=counts):
            out = written(df, name)
            counts[name] = counts.get(name, 0) + out.count() * (name == "ranked" and "places" in out.columns)
            return out

        monkeypatch.setattr("tessera.operators.vectors.written", counted)
        found = search(ask(spark, *rows * copies), None, everything, SearchConfig(limit=3)).select("query_id", "doc_id", "overall_score").collect()
        ranked.append(counts["ranked"])
    assert ranked[0] == ranked[1] > 0
    whole = search(ask(spark, *rows * 4), None, everything, SearchConfig(limit=1000)).select("query_id", "doc_id", "overall_score").collect()
    for q in range(len(rows) * 4):
        of = lambda part, q=q: sorted(round(r.overall_score, 9) for r in part if r.query_id == q)
        assert len(of(found)) == 3 and of(found) == of(whole)[-3:]
