"""Quality rules: boosted trees over document statistics, after base rules."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.boosting import Forest, fit
from tessera.llm.text import columns_of, whole_row, words

#: Statistics that are shares or means, and how the verdict may go with them.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "bang_share": -1,
    "bar_share": -1,
    "digit_share": 0,
    "distinct_share": 0,
    "top_word_share": -1,
    "stop_share": 0,
    "words_a_line": 0,
    "high_byte_share": 0,
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def repeated_words(ids: np.ndarray, window: int = 3) -> int:
    """Words that stand in windows found twice or more; `ids` numbers the words."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = ids[:n]
    for i in range(1, window):
        key = np.unique(key, return_inverse=True)[1] * (int(ids.max()) + 1) + ids[i : i + n]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[back] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> list[float]:
    """The five base counts, then the features, of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    w = words(text)
    n = len(w)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(x, len(known)) for x in w], np.int64)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines, seen, dup, full = text.split("\n"), set(), 0, 0
    for line in lines:
        if _HAS_WORD.search(line):
            full += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    chars = int(len(text) - byte[32] - byte[9:14].sum())
    symbols = int(sum(byte[c] for c in SYMBOLS))
    repeats = repeated_words(ids)
    top = int(np.bincount(ids).max()) if n else 0
    d, m = max(chars, 1), max(n, 1)
    found = [
        np.log1p(n), chars / m, symbols / d, dup / max(full, 1), repeats / m, byte[65:91].sum() / d, byte[33] / d, byte[124] / d, byte[48:58].sum() / d,
        len(known) / m, top / m, (byte[46] + byte[44]) / m, n / max(full, 1), byte[128:].sum() / d,
    ]
    return [n, chars, symbols, dup, repeats, *map(float, found)]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """`id_col`, `more`, the base counts (long) and the features (double) for every row."""
    schema = f"n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, {', '.join(f'{f} double' for f in FEATURES)}"

    @F.pandas_udf(schema)
    def of(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([statistics(t) for t in texts], columns=[*BASE, *FEATURES])
        return found.astype(dict.fromkeys(BASE, "int64"))

    return docs.select(id_col, *more, of(F.col(text_col)).alias("s")).select(id_col, *more, "s.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> Forest | None:
    """Trees fitted on `max_labelled` labelled rows at most, chosen by a hash of the id.

    The ids go to all executors, whose rows become statistics there. None if
    fewer than ten rows of either kind are labelled.
    """
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("__y"))
    chosen = marked.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("__id"), text_col).join(F.broadcast(chosen), "__id")
    # where labelled ids repeat the order keeps the bound and makes reruns agree
    rows = with_statistics(rows, "__id", text_col, "__y").orderBy("__id", *FEATURES).limit(2 * max_labelled).toPandas()
    y = rows["__y"].to_numpy(float)
    if min((y > 0.5).sum(), (y <= 0.5).sum()) < 10:
        return None
    return fit(rows[[*FEATURES]].to_numpy(float), (y > 0.5).astype(float), np.array([*FEATURES.values()]))


def with_verdict(stats: DataFrame, forest: Forest | None, threshold: float = 0.5) -> DataFrame:
    """`stats` with `base_failed, score, kept`."""
    if forest is None:
        scored = stats.withColumn("score", F.lit(None).cast("double"))
    else:

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(forest.probability(np.column_stack([c.to_numpy(float) for c in columns])))

        scored = stats.withColumn("score", score(*FEATURES))
    failed = scored.withColumn("base_failed", base_failed())
    return failed.withColumn("kept", ~F.col("base_failed") & (F.coalesce("score", F.lit(1.0)) >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, max_labelled: int = 20_000) -> DataFrame:
    """`id_col`, the base counts, the features, `base_failed, score, kept` for every row.

    score is the trees' probability that the text is good; kept asks for the
    base rules and a score of `threshold`. Without enough labels of both kinds
    the score is null and the base rules decide alone. A null text has no
    words and so fails; rows with a null id are judged like any other, repeated
    rows come back each, an empty table gives no rows. Other columns are not
    looked at. After the fit one pass without a shuffle judges all rows.
    """
    forest = fit_rules(docs, labels, id_col, text_col, label_col, max_labelled)
    return with_verdict(with_statistics(docs, id_col, text_col), forest, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, max_labelled: int = 20_000) -> DataFrame:
    """The rows of `docs` that `quality_rules` keeps, with their own columns alone."""
    forest = fit_rules(docs, labels, id_col, text_col, label_col, max_labelled)
    packed = docs.select(whole_row(docs).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return with_verdict(with_statistics(packed, "__id", "__text", "__row"), forest, threshold).filter("kept").select(*columns_of("__row", docs))
