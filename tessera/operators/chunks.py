"""Texts cut into chunks by meaning, summaries ranked over a graph of sentences, and vectors that later runs find again."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.embed import STOP_WORDS, Encoder, embed_distinct, embedding, hashed_encoder
from tessera.functions.scalars import split_names
from tessera.operators.conditions import VECTOR_KEYS
from tessera.session import written
from tessera.streaming.keyed import KeyedTable

#: Sentences on either side that a sentence is read with, and the share of the distances under which no cut stands.
BESIDE, PERCENTILE = 1, 95.0
#: Share of a sentence's weight that its neighbours in the graph give, and when the ranking stands still.
DAMPING, STILL, ROUNDS = 0.85, 1e-9, 200
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[^\W_]+")


def sentences_of(text: str) -> list[str]:
    return [s for s in (p.strip() for p in _SENTENCE.split(text)) if s]


def distances(sentences: list[str], encode: Encoder) -> np.ndarray:
    """The cosine distance between each two neighbours, every sentence read with those beside it."""
    read = [" ".join(sentences[max(0, i - BESIDE) : i + BESIDE + 1]) for i in range(len(sentences))]
    v = np.asarray(encode(read), float)
    length = np.linalg.norm(v, axis=1)
    v = v / np.where(length > 0, length, 1)[:, None]
    return np.round(1 - (v[1:] * v[:-1]).sum(axis=1), 9)


def bounded_cuts(sizes: list[int], apart: np.ndarray, most: int) -> list[int]:
    """Where a stretch of sentences is cut so that no part has over `most` words: the fewest parts, then the largest distances cut through, then the earliest places.

    An exact dynamic program; a sentence over `most` words is a part of its own.
    """
    n = len(sizes)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    best: list[tuple] = [(0, 0.0, [])]
    for end in range(1, n + 1):
        found = None
        for start in range(end - 1, -1, -1):
            if start < end - 1 and upto[end] - upto[start] > most:
                break
            parts, through, cuts = best[start]
            here = (parts + 1, through - (float(apart[start - 1]) if start else 0.0), [*cuts, start] if start else cuts)
            if found is None or here < found:
                found = here
        best.append(found)
    return best[n][2]


def chunked(text: str, encode: Encoder, max_words: int, percentile: float = PERCENTILE) -> list[str]:
    """The chunks of a text: cut where neighbours lie farther apart than `percentile` of all, then where `max_words` asks for it."""
    sentences = sentences_of(text)
    if not sentences:
        return []
    apart = distances(sentences, encode) if len(sentences) > 1 else np.zeros(0)
    bound = np.percentile(apart, percentile) if len(apart) else 0.0
    starts = [0, *(np.flatnonzero(apart > bound) + 1).tolist(), len(sentences)]
    sizes, out = [len(s.split()) for s in sentences], []
    for a, b in zip(starts, starts[1:]):
        inner = [0, *bounded_cuts(sizes[a:b], apart[a : b - 1], max_words), b - a]
        out += [" ".join(sentences[a + x : a + y]) for x, y in zip(inner, inner[1:])]
    return out


def semantic_chunks(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, max_words: int = 200, load: Callable[[], Encoder] = hashed_encoder) -> DataFrame:
    """`doc_col, chunk_number, text`: title and text cut by meaning, numbered from 0.

    A cut stands where two neighbouring sentences, each read with the one on
    either side, lie farther apart than 95 of 100 in their document; what then
    has over `max_words` is cut further, at the largest distances that the
    bound allows. Blank and null texts have no chunks. A document is cut in one
    task.
    """
    text = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (title_col, text_col) if c])

    def of(batches):
        encode = load()
        for texts in batches:
            yield pd.Series([chunked(t, encode, max_words) for t in texts])

    cut = F.pandas_udf(_typed(of), "array<string>")
    return docs.select(doc_col, F.posexplode(cut(text)).alias("chunk_number", "text"))


def _typed(of):
    """`of` as Spark knows a function from series to series that is set up once a task."""
    from collections.abc import Iterator

    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return of


def ranked_sentences(sentences: list[str]) -> np.ndarray:
    """The weight of each sentence: power iteration over a graph in which two sentences are tied by the words they share, for their length."""
    words = [set(w for w in _WORD.findall(s.lower()) if w not in STOP) for s in sentences]
    number = {w: i for i, w in enumerate(sorted(set().union(*words)))} if words else {}
    n = len(words)
    held = np.zeros((n, max(len(number), 1)), np.float32)
    for row, own in zip(held, words):
        row[[number[w] for w in own]] = 1
    sizes = np.array([len(w) for w in words], float)
    scale = np.log1p(sizes)[:, None] + np.log1p(sizes)[None, :]
    ties = (held @ held.T).astype(float) / np.where(scale > 0, scale, 1)
    np.fill_diagonal(ties, 0)
    out = ties.sum(axis=1)
    step = np.divide(ties, out[:, None], out=np.full_like(ties, 1 / n), where=out[:, None] > 0)
    weight = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        now = (1 - DAMPING) / n + DAMPING * (weight @ step)
        if np.abs(now - weight).sum() < STILL:
            break
        weight = now
    return np.round(weight, 9)


STOP = frozenset(STOP_WORDS)
#: Sentences whose graph is held at once; a longer text is ranked in stretches of so many.
STRETCH = 2000


def summary_of(text: str, max_words: int) -> str:
    """The sentences of most weight, in their order, as long as they keep to `max_words`; the first of them in any case."""
    sentences = sentences_of(text)
    if not sentences:
        return ""
    weight = np.concatenate([ranked_sentences(sentences[i : i + STRETCH]) * len(sentences[i : i + STRETCH]) for i in range(0, len(sentences), STRETCH)])
    kept, left = [], max_words
    for i in np.lexsort((np.arange(len(sentences)), -weight)).tolist():
        size = len(sentences[i].split())
        if size > left and kept:
            break
        kept.append(i)
        left -= size
    return " ".join(sentences[i] for i in sorted(kept))


def summaries(docs: DataFrame, doc_col: str = "doc_id", title_col: str = "title", text_col: str = "text", max_words: int = 80, load: Callable[[], Encoder] | None = None) -> DataFrame:
    """`doc_col, summary`, and with an encoder `vector`, that of title and summary: the sentences of most weight up to `max_words`; the title for blank texts.

    Sentences are ranked by power iteration over the words that they share
    with each other, one document at a time. A document with neither title nor
    text has a null summary and the vector of an empty text.
    """
    of = F.pandas_udf(lambda texts: texts.map(lambda t: summary_of(t, max_words)), "string")
    blank = F.trim(F.coalesce(text_col, F.lit(""))) == ""
    found = docs.select(doc_col, F.col(title_col).alias("__title"), F.when(blank, F.col(title_col)).otherwise(of(F.coalesce(text_col, F.lit("")))).alias("summary"))
    if load is not None:
        found = found.withColumn("vector", embedding(load)(F.concat_ws(" ", "__title", "summary")))
    return found.drop("__title")


def embed_stored(df: DataFrame, text_col: str, out: str, path: str, load: Callable[[], Encoder] = hashed_encoder, buckets: int = 64) -> DataFrame:
    """`df` with the vectors of its texts, of which those that an earlier run has encoded are found under `path`, and new ones are put there.

    The store is a `KeyedTable` by the SHA-256 of a text, so a run encodes what
    is new alone, and opens only the parts that may hold one of its texts.
    Null texts have no vector. One writer at a time.
    """
    spark = df.sparkSession
    store = KeyedTable(spark, path, ["hash"], "hash string, vector array<float>", buckets)
    texts = written(df.select(F.sha2(text_col, 256).alias("hash"), F.col(text_col).alias("text")).filter("text is not null").dropDuplicates(["hash"]), "texts")
    now = store.manifest()
    new = texts.join(store.rows(store.possible(texts, now.parts)).select("hash"), "hash", "left_anti")
    if not new.isEmpty():
        store.insert(embed_distinct(new, "text", "vector", load).select("hash", "vector"), now.batch + 1, ["hash"])
    known = store.rows(store.possible(texts, store.manifest().parts)).select(F.col("hash").alias("__h"), F.col("vector").alias(out))
    return df.withColumn("__hash", F.sha2(text_col, 256)).join(known, F.col("__hash") == F.col("__h"), "left").drop("__hash", "__h")


def value_vectors(attributes: DataFrame, path: str, keys: list[str] | None = None, load: Callable[[], Encoder] = hashed_encoder) -> DataFrame:
    """`attributes` with `value_vector` for non-blank values of the keys that are compared by meaning, and a derived row for each name of a value that holds several.

    A value of one name has its vector in place; a row of several names has
    none itself, its derived rows have.
    """
    keys = keys or VECTOR_KEYS
    rows = attributes.withColumn("__names", F.when(F.col("key").isin(keys) & (F.trim(F.coalesce("value", F.lit(""))) != ""), split_names(F.col("value"))))
    own = rows.withColumn("__text", F.when(F.size("__names") == 1, F.trim("value"))).drop("__names")
    derived = rows.filter(F.size("__names") > 1).withColumn("value", F.explode("__names")).withColumn("__text", F.col("value")).drop("__names")
    if "type" in attributes.columns:
        derived = derived.withColumn("type", F.lit("DERIVED"))
    return embed_stored(own.unionByName(derived.distinct()), "__text", "value_vector", path, load).drop("__text")
