import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.embed import embedding, hashed_encoder
from tessera.functions.latent import fitted_encoder, weighted


def topics(seed=3, n=480):
    """Short texts of six topics; a text has few of its topic's many words, so two of a topic often share none."""
    rng = random.Random(seed)
    names = [["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(60)] for _ in range(6)]
    common = [f"filler{i}" for i in range(10)]
    return [(i, i % 6, " ".join(rng.sample(names[i % 6], 6) + rng.sample(common, 4))) for i in range(n)]


def told_apart(v, texts, labels):
    """Of texts that share no topic's word: how often two of one topic are nearer than two of different ones."""
    own = [{w for w in t.split() if not w.startswith("filler")} for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if not own[i] & own[j]]
    near = np.array([v[i] @ v[j] for i, j in pairs])
    same = np.array([labels[i] == labels[j] for i, j in pairs])
    place = np.argsort(np.argsort(near))
    return (place[same].mean() - (same.sum() - 1) / 2) / (~same).sum()


def test_neighbours_by_meaning_beat_those_by_spelling(spark):
    rows = topics()
    docs = spark.createDataFrame(rows, "doc_id int, topic int, text string")
    encode = fitted_encoder(docs, dimensions=8, rounds=8)()
    texts, labels = [r[2] for r in rows], [r[1] for r in rows]
    own, hashed = told_apart(np.asarray(encode(texts), float), texts, labels), told_apart(np.asarray(hashed_encoder()(texts), float), texts, labels)
    assert own > 0.9 and hashed < 0.65, (own, hashed)
    got = docs.select("doc_id", embedding(fitted_encoder(docs, dimensions=8, rounds=8))("text").alias("v")).orderBy("doc_id").collect()
    assert np.allclose(np.abs(np.array([r.v for r in got]) @ np.array([r.v for r in got]).T), np.abs(encode(texts) @ encode(texts).T), atol=1e-3)


def test_the_basis_is_that_of_plain_iterations(spark):
    rows = topics(n=60)
    docs = spark.createDataFrame(rows, "doc_id int, topic int, text string").repartition(5)
    encode = fitted_encoder(docs, dimensions=6, rounds=3, seed=9)()
    texts = [r[2] for r in rows]
    df = {w: sum(w in t.split() for t in texts) for w in {w for t in texts for w in t.split()}}
    words = sorted(df, key=lambda w: (-df[w], w))
    row, term, weight = weighted(texts, {w: i for i, w in enumerate(words)}, np.log(61 / (1 + np.array([df[w] for w in words]))) + 1)
    a = np.zeros((len(texts), len(words)))
    a[row, term] = weight
    assert np.allclose((a**2).sum(axis=1), 1)
    basis = np.linalg.qr(np.random.default_rng(9).normal(size=(len(words), 6)))[0]
    for _ in range(3):
        basis = np.linalg.qr(a.T @ (a @ basis))[0]
    want = a @ basis
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(np.asarray(encode(texts), float), want, atol=1e-4)


def test_odd_texts(spark):
    docs = spark.createDataFrame([("the a of",), (None,), ("",), ("word word other",)], "text string")
    encode = fitted_encoder(docs, dimensions=4)()
    assert not encode(["", "unknown words", "the"]).any() and abs(np.linalg.norm(encode(["word"])) - 1) < 1e-5
    none = fitted_encoder(docs.filter(F.lit(False)), dimensions=4)()
    assert none(["word"]).shape == (1, 4) and not none(["word"]).any()
