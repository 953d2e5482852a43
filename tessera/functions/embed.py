"""Text to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384
Encoder = Callable[[list[str]], np.ndarray]


def hashed_encoder(dimensions: int = DIMENSIONS) -> Encoder:
    """Signed hashing of words and letter runs into unit vectors: repeatable, without a model file."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts):
            for w in text.lower().split():
                for part in (w, *(w[i : i + 4] for i in range(len(w) - 3))):
                    h = xxhash.xxh64_intdigest(part)
                    row[h % dimensions] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def embedding(load: Callable[[], Encoder] = hashed_encoder):
    """A pandas UDF from text to vector; `load` runs once a task, so a model may be opened there."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series(list(encode([t or "" for t in texts])))

    return of


def embed_distinct(df: DataFrame, text_col: str, out: str, load: Callable[[], Encoder] = hashed_encoder) -> DataFrame:
    """`df` with the vectors of its texts; each distinct text is encoded once, null texts have none."""
    texts = df.select(F.col(text_col).alias("__t")).filter("__t is not null").distinct()
    coded = texts.select("__t", embedding(load)(F.col("__t")).alias(out))
    return df.join(coded, df[text_col] == coded["__t"], "left").drop("__t")


#: Common English words that carry no meaning of their own.
STOP_WORDS = "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
