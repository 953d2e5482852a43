"""An encoder fitted to a corpus: latent semantic directions by a randomised decomposition of its weighted term-document matrix."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.embed import STOP_WORDS, Encoder
from tessera.session import written

#: Rows of a sum that travel together, and texts that are worked on at once.
STRIPE, AT_ONCE = 2048, 128
WORD = re.compile(r"[^\W_]+")


def weighted(texts: list[str], number: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of the cells of some texts: logarithmic counts times inverse document frequency, rows of length 1."""
    row, term = [], []
    for i, t in enumerate(texts):
        own = [k for w in WORD.findall((t or "").lower()) if (k := number.get(w)) is not None]
        row += [i] * len(own)
        term += own
    if not row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    n = len(idf)
    cells, counts = np.unique(np.array(row, np.int64) * n + np.array(term, np.int64), return_counts=True)
    row, term = cells // n, cells % n
    weight = (1 + np.log(counts)) * idf[term]
    length = np.sqrt(np.bincount(row, weight**2))
    return row, term, weight / np.where(length[row] > 0, length[row], 1)


def projected(cells: tuple[np.ndarray, np.ndarray, np.ndarray], basis: np.ndarray, n: int) -> np.ndarray:
    """The rows of some cells, `n` of them, times a basis of the terms."""
    row, term, weight = cells
    out = np.zeros((n, basis.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(weight[:, None] * basis[term], starts, axis=0)
    return out


def fitted_encoder(docs: DataFrame, text_col: str = "text", dimensions: int = 64, terms: int = 20_000, rounds: int = 3, seed: int = 7) -> Callable[[], Encoder]:
    """A loader, as `embed.embedding` takes it, of an encoder fitted to all texts of `docs`.

    The `terms` words in most documents (stop words left out) and the weights
    of their cells make a matrix that is never held: in each round every task
    multiplies its texts with the basis at hand and back, the products are
    summed by stripes of terms, and the driver makes the sum, `terms` times
    `dimensions` numbers, the next basis. A text becomes its weighted words
    times the last basis, with length 1; without known words it is zero. The
    same corpus, seed and bounds give the same encoder but for the order of
    sums. Null texts count as empty; an empty corpus gives zero vectors.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("t"))
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"))).alias("w")).filter((F.col("w") != "") & ~F.col("w").isin(STOP_WORDS))
    found = words.groupBy("w").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "w").limit(terms).collect()
    n_docs = texts.count()
    number = {r["w"]: i for i, r in enumerate(found)}
    idf = np.log((1 + n_docs) / (1 + np.array([r["df"] for r in found], float))) + 1
    model = spark.sparkContext.broadcast((number, idf))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(number), dimensions)))[0] if number else np.zeros((0, dimensions))
    for _ in range(rounds if number else 0):
        at = spark.sparkContext.broadcast(basis)

        def multiplied(batches: Iterator[pd.DataFrame], at=at) -> Iterator[pd.DataFrame]:
            (known, weights), own = model.value, at.value
            total = np.zeros_like(own)
            for batch in batches:
                for i in range(0, len(batch), AT_ONCE):
                    part = batch["t"].iloc[i : i + AT_ONCE].tolist()
                    cells = weighted(part, known, weights)
                    there = projected(cells, own, len(part))
                    np.add.at(total, cells[1], cells[2][:, None] * there[cells[0]])
            for k in range(0, len(total), STRIPE):
                yield pd.DataFrame({"stripe": [k], "sums": [total[k : k + STRIPE].tobytes()]})

        def summed(rows: pd.DataFrame) -> pd.DataFrame:
            out = sum(np.frombuffer(x) for x in rows["sums"])
            return pd.DataFrame({"stripe": rows["stripe"].iloc[:1], "sums": [out.tobytes()]})

        sums = written(texts.mapInPandas(multiplied, "stripe int, sums binary").groupBy("stripe").applyInPandas(summed, "stripe int, sums binary"), "basis").orderBy("stripe").collect()
        basis = np.linalg.qr(np.concatenate([np.frombuffer(r["sums"]).reshape(-1, basis.shape[1]) for r in sums]))[0]
    last = spark.sparkContext.broadcast(basis.astype(np.float32))

    def load() -> Encoder:
        known, weights = model.value

        def encode(batch: list[str]) -> np.ndarray:
            out = projected(weighted(batch, known, weights), last.value, len(batch))
            length = np.linalg.norm(out, axis=1, keepdims=True)
            return (out / np.where(length > 0, length, 1)).astype(np.float32)

        return encode

    return load
