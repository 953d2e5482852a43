"""Language ID by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import slices


BUCKETS = 1 << 13
DIMENSIONS = 16
#: Odd multipliers by which bytes of a subword are hashed, for lengths 2 to 4.
MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
SHIFT = np.uint32(32 - 13)
_LETTER = regex.compile(r"\p{L}")
#: Bytes hashed at once.
AT_ONCE = 1 << 20
UNKNOWN = "und"


def subwords(text: str) -> np.ndarray:
    """How often each bucket of hashed runs of 2, 3 and 4 bytes occurs in a whole text."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), AT_ONCE):
        part = raw[at : at + AT_ONCE + 3].astype(np.uint32)
        h = part * MULTIPLIERS[0]
        for n in (2, 3, 4):
            if len(part) < n:
                break
            h = (h[:-1] ^ np.uint32(0x9E3779B9 * n & 0xFFFFFFFF)) * np.uint32(31) + part[n - 1 :] * MULTIPLIERS[n - 1]
            own = h[: min(AT_ONCE, len(h))]
            counts += np.bincount((own * MULTIPLIERS[1]) >> SHIFT, minlength=BUCKETS)
    return counts


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        mean = counts @ self.table / np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)
        return mean @ self.weights + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        z = self.logits(counts) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(counts: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.5, batch: int = 16, seed: int = 5) -> Model:
    """Stochastic gradient descent on the cross entropy; a fifth of the rows calibrates.

    The temperature is the one with the best likelihood on that fifth; the
    rejection bound leaves out the least certain hundredth of its right answers.
    """
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    model = Model(languages, rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages)))
    x = counts.astype(np.float32, copy=False)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)  # in place: the counts are the largest thing here
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in range(0, len(used), batch):
            rows = rng.permutation(used)[:batch] if i + batch > len(used) else used[i : i + batch]
            mean = x[rows] @ model.table
            z = mean @ model.weights + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = p @ model.weights.T
            model.weights -= step * mean.T @ p / len(rows) * 10
            model.bias -= step * p.mean(axis=0)
            model.table -= step * x[rows].T @ back / len(rows) * 1000
        used = rng.permutation(used)
    if len(held):
        z = model.logits(x[held])
        scored = []
        for t in np.geomspace(0.02, 5, 60):
            m = z / t - (z / t).max(axis=1, keepdims=True)
            scored.append((float((np.log(np.exp(m).sum(axis=1)) - m[np.arange(len(held)), y[held]]).mean()), t))
        model.temperature = min(scored)[1]
        p = model.probabilities(x[held])
        right = p.argmax(axis=1) == y[held]
        model.reject_below = float(np.quantile(p.max(axis=1)[right], 0.01)) if right.any() else 0.0
    return model


def learn(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 2_000, max_languages: int = 200) -> Model | None:
    """A model of the rows where `usable` holds and the language is not null.

    About `max_rows` rows at most are fitted, evenly many of each language,
    chosen by a hash of the id; their whole texts become counts on the
    executors. None if nothing can be learned.
    """
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = rows.groupBy(lang_col).count().orderBy(lang_col).limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    if not found:
        return None
    share = max_rows // len(found)
    u = F.pmod(F.xxhash64(F.lit("langid"), id_col), F.lit(1 << 30)) / float(1 << 30)
    want = F.coalesce(*[F.when(F.col(lang_col) == r[0], F.lit(min(1.0, share / r[1]))) for r in found])

    @F.pandas_udf("struct<at:binary,n:binary>")
    def sparse(texts: pd.Series) -> pd.DataFrame:
        every = [subwords(t) for t in texts]
        at = [np.flatnonzero(c) for c in every]
        return pd.DataFrame({"at": [a.astype("<i4").tobytes() for a in at], "n": [c[a].astype("<i4").tobytes() for c, a in zip(every, at)]})

    order = [F.xxhash64(F.lit("langid"), id_col).alias("o"), F.xxhash64(text_col).alias("t")]
    some = rows.filter(u < want).select(*order, F.col(lang_col).alias("lang"), sparse(F.col(text_col)).alias("c")).select("o", "t", "lang", "c.*")
    # where very many rows share an id the hash cannot part them; the order keeps the bound and makes reruns agree
    chosen = some.orderBy("o", "t", "lang").limit(2 * max_rows + 100).toPandas()
    counts = np.zeros((len(chosen), BUCKETS), np.float32)
    for i, (at, n) in enumerate(zip(chosen["at"], chosen["n"])):
        counts[i, np.frombuffer(at, "<i4")] = np.frombuffer(n, "<i4")
    return fit(counts, chosen["lang"].to_numpy(str)) if len(chosen) else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, lang_pred, score, accepted` for every row, from the whole text alone.

    Null texts and texts without a letter are `und` with score 0. score is the
    calibrated probability of lang_pred; accepted says that it reaches the
    rejection bound. Without a model all rows are `und`. Repeated rows come
    back each; an empty table gives no rows. Other columns are not looked at.
    """
    if model is None:
        return docs.select(F.col(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))

    @F.pandas_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def of(texts: pd.Series) -> pd.DataFrame:
        known = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)
        names, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
        if known.any():
            p = np.concatenate([model.probabilities(np.array([subwords(t) for t in part], np.float32)) for part in slices(texts[known])])
            names[known] = np.array(model.languages, object)[p.argmax(axis=1)]
            score[known] = np.clip(p.max(axis=1), 0, 1)
        return pd.DataFrame({"lang_pred": names, "score": score, "accepted": known & (score >= model.reject_below)})

    return docs.select(F.col(id_col), of(F.col(text_col)).alias("p")).select(id_col, "p.*")
