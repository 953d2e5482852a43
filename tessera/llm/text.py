"""What the text operators share: words, batches and runs of a key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 (`bytes.split` parts at just these six characters)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of `df` as one, whatever their names."""
    return F.struct(*[F.col(_quoted(c)).alias(c) for c in df.columns])


def columns_of(row: str, df: DataFrame) -> list[Column]:
    """The columns of `df` out of a column `row` that `whole_row` made."""
    return [F.col(f"{row}.{_quoted(c)}").alias(c) for c in df.columns]


def slices(texts: pd.Series, rows: int = 256) -> Iterator[pd.Series]:
    """A batch in parts of a few texts; Spark bounds the batch itself by bytes (64 MB unless set otherwise)."""
    for i in range(0, len(texts), rows):
        yield texts.iloc[i : i + rows]


def whole_runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that end where a key ends, from batches sorted by `keys`.

    At most a batch and the rows of one key are held.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(batch) - last[::-1].argmin() if not last.all() else 0
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = [batch.iloc[cut:]]
        elif held and (held[-1][keys].iloc[-1] == batch[keys].iloc[0]).all():
            held.append(batch)
        else:
            if held:
                yield pd.concat(held, ignore_index=True)
            held = [batch]
    if held:
        yield pd.concat(held, ignore_index=True)
