import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.embed import hashed_encoder
from tessera.operators import chunks as C
from tessera.operators.attributes import typed
from tessera.operators.conditions import Conditions


def test_chunks_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "One two. Three four! Five\nsix seven."), (2, " "), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_number, r.text) for r in C.semantic_chunks(docs).collect())
    assert {g[0] for g in got} == {1} and [g[1] for g in got] == list(range(len(got)))
    assert " ".join(g[2] for g in got).split() == "One two. Three four! Five six seven.".split()


def test_cuts_are_the_best_that_the_bound_allows():
    rng = random.Random(3)
    for _ in range(200):
        n, most = rng.randrange(1, 9), rng.randrange(4, 15)
        sizes, apart = [rng.randrange(1, 9) for _ in range(n)], np.round([rng.random() for _ in range(n - 1)], 2)
        ways = []
        for k in range(n):
            for cuts in itertools.combinations(range(1, n), k):
                ends = [0, *cuts, n]
                if all(b - a == 1 or sum(sizes[a:b]) <= most for a, b in zip(ends, ends[1:])):
                    ways.append((k, -sum(float(apart[c - 1]) for c in cuts), list(cuts)))
        best = min(ways, key=lambda w: (w[0], round(w[1], 9)))
        got = C.bounded_cuts(sizes, apart, most)
        assert len(got) == best[0] and abs(sum(float(apart[c - 1]) for c in got) + best[1]) < 1e-9


def test_topics_are_told_apart(spark):
    a = "The cat sat on the mat with the other cat."
    b = "Neutron beams scatter from crystal lattices at low temperature."
    docs = spark.createDataFrame([(1, " ".join([a] * 6 + [b] * 6))], "doc_id long, text string")
    got = [r.text for r in C.semantic_chunks(docs).orderBy("chunk_number").collect()]
    assert len(got) >= 2 and not any(a[:12] in c and c.count("Neutron") > 1 for c in got)
    bound = [r.text for r in C.semantic_chunks(docs, max_words=20).collect()]
    assert max(len(c.split()) for c in bound) <= 20 and sorted(" ".join(bound).split()) == sorted((" ".join([a] * 6 + [b] * 6)).split())


def plain_rank(sentences):
    words = [{w for w in C._WORD.findall(s.lower()) if w not in C.STOP} for s in sentences]
    n = len(words)
    tie = [[0.0 if i == j or not words[i] or not words[j] else len(words[i] & words[j]) / (np.log(1 + len(words[i])) + np.log(1 + len(words[j]))) for j in range(n)] for i in range(n)]
    w = [1 / n] * n
    for _ in range(500):
        w = [0.15 / n + 0.85 * sum(w[i] * (tie[i][j] / sum(tie[i]) if sum(tie[i]) else 1 / n) for i in range(n)) for j in range(n)]
    return w


def test_ranking_of_sentences():
    rng = random.Random(4)
    for _ in range(20):
        s = [" ".join(rng.choice(["beam", "cat", "lattice", "the", "cold", "ray"]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9))]
        assert np.allclose(C.ranked_sentences(s), plain_rank(s), atol=1e-6)


def test_summaries_and_their_vectors(spark):
    text = "Crystal beams are cold. The cat sleeps. Cold beams scatter in a crystal. Crystal lattices keep beams cold."
    docs = spark.createDataFrame([(1, "T", text), (2, "T", " "), (3, None, None), (4, "x", "One. " * 5000)], "doc_id long, title string, text string")
    got = {r.doc_id: r for r in C.summaries(docs, max_words=10, load=hashed_encoder).collect()}
    assert got[2].summary == "T" and got[3].summary is None and len(got[4].summary.split()) <= 10
    assert "cat sleeps" not in got[1].summary and len(got[1].summary.split()) <= 10
    want = hashed_encoder()([f"T {got[1].summary}"])[0]
    assert np.allclose(got[1].vector, want)


def test_a_second_run_encodes_what_is_new_alone(spark, tmp_path):
    path, log = f"file://{tmp_path}/vectors", tmp_path / "log"
    log.mkdir()

    def counting(where=str(log)):
        import os
        import uuid

        encode = hashed_encoder()

        def of(texts):
            with open(os.path.join(where, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(texts))
            return encode(texts)

        return of

    def seen():
        out = sorted(t for f in log.iterdir() for t in f.read_text().split("\n") if t)
        for f in log.iterdir():
            f.unlink()
        return out

    rows = lambda *t: spark.createDataFrame([(x,) for x in t], "t string")
    first = C.embed_stored(rows("a", "b", "b", None), "t", "v", path, counting).collect()
    assert seen() == ["a", "b"] and sum(r.v is not None for r in first) == 3
    second = {r.t: r.v for r in C.embed_stored(rows("b", "c", "a"), "t", "v", path, counting).collect()}
    assert seen() == ["c"] and all(np.allclose(second[t], hashed_encoder()([t])[0]) for t in "abc")
    C.embed_stored(rows("a", "c"), "t", "v", path, counting).collect()
    assert seen() == []


def test_conditions_on_stored_value_vectors(spark, tmp_path):
    data = [(1, "authors", "Ann Bee", None), (2, "authors", "Ann Bee, Cee Dee", None), (3, "authors", "Zed Why", None), (4, "title", "Ann Bee", None), (5, "authors", " ", None)]
    rows = typed(spark.createDataFrame(data, "doc_id long, key string, value string, unit string").withColumn("type", F.lit("EXPLICIT")))
    got = C.value_vectors(rows, f"file://{tmp_path}/v")
    assert sorted((r.doc_id, r.value, r.type, r.value_vector is not None) for r in got.collect()) == [(1, "Ann Bee", "EXPLICIT", True), (2, "Ann Bee", "DERIVED", True), (2, "Ann Bee, Cee Dee", "EXPLICIT", False), (2, "Cee Dee", "DERIVED", True), (3, "Zed Why", "EXPLICIT", True), (4, "Ann Bee", "EXPLICIT", False), (5, " ", "EXPLICIT", False)]
    leaf = {"name": "authors", "operator": "=", "value": "not written so"}
    vector = [float(x) for x in hashed_encoder()(["Ann Bee"])[0]]
    assert {r.doc_id for r in Conditions(leaf, {id(leaf): vector}).flags(got).collect()} == {1, 2}
