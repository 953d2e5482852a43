"""Periodic runs of words: Lyndon roots by suffix grouping, extended to whole runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import slices, words

#: A factor that makes a window of word numbers one number.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def lyndon_roots(s: list[int]) -> Iterator[tuple[int, int, int]]:
    """`start, length, times` of every stretch in which the longest Lyndon word of a place stands twice or more in a row.

    This is the first phase of Baier's suffix sorting. The text is a row of
    factors, at first its single symbols, in groups of equal ones. The greatest
    group is taken off each time: the factor before a stretch of its members
    takes them in, and of a group those that took in more of them become a
    greater group of their own. When a group is taken off, its factors are the
    longest Lyndon words that start where they start. Time is linear beside the
    sorting of the symbols.
    """
    n = len(s)
    symbols = sorted(set(s))
    of = {c: g for g, c in enumerate(symbols)}
    group = [of[c] for c in s]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    above, below = list(range(1, len(symbols))) + [-1], list(range(-1, len(symbols) - 1))
    left, size = list(range(-1, n - 1)), [1] * n
    top = len(symbols) - 1
    while top >= 0:
        took: dict[int, list[int]] = {}
        for i in members[top]:
            if group[i] != top or (left[i] >= 0 and group[left[i]] == top):
                continue  # moved on since, or not the first of its stretch
            length, times, end = size[i], 1, i + size[i]
            while end < n and group[end] == top:
                times += 1
                end += length
            before = left[i]
            if end < n:
                left[end] = before
            if before >= 0:
                size[before] += times * length
                took.setdefault(times, []).append(before)
            if times > 1:
                yield i, length, times
        members[top] = []
        for times in sorted(took, reverse=True):
            fresh: dict[int, int] = {}
            for p in took[times]:
                old = group[p]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(members)
                    members.append([])
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    below[up] = new
                group[p] = new
                members[new].append(p)
        top = below[top]


def common_prefix(s: list[int], a: int, b: int) -> int:
    """How far `s` reads the same from a as from b > a: steps twice as long while they agree, then half as long."""
    n, k, step = len(s), 0, 1
    while b + k + step <= n and s[a + k : a + k + step] == s[b + k : b + k + step]:
        k += step
        step *= 2
    while step:
        if b + k + step <= n and s[a + k : a + k + step] == s[b + k : b + k + step]:
            k += step
        step //= 2
    return k


def runs_of(s: list[int], min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """`start, length, period` of all runs, sorted by start and period.

    Every run has a Lyndon root under one order of the symbols or its reverse,
    and one of three periods or more has it twice in a row; the roots' stretch
    is extended to both sides as far as the period holds.
    """
    n, back, found = len(s), s[::-1], set()
    for order in (s, [-c for c in s]):
        for start, period, times in lyndon_roots(order):
            end = start + period * times
            if min_exponent * period > n:
                continue
            right = common_prefix(s, end - period, end)
            # reversed, the word before `start` stands at n - start
            lead = common_prefix(back, n - start - period, n - start)
            length = end + right - start + lead
            if length >= max(min_words, min_exponent * period):
                found.add((start - lead, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _spots(codes: np.ndarray, doc: np.ndarray, gram: int, min_words: int) -> list[tuple[int, int]]:
    """Stretches of words, each within one text, outside of which there is no run.

    Every window of `gram` words inside a run stands twice or more in its text,
    so a run lies within a stretch that such windows cover. Equal hashes of
    unlike windows only make a stretch longer.
    """
    n = len(codes) - gram + 1
    if n < 2:
        return []
    h = doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(gram):
        h = (h ^ (codes[k : k + n].astype(np.uint64) + np.uint64(k))) * _BASE
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(doc[:n] == doc[gram - 1 : gram - 1 + n])
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(codes) + 1, np.int64)
    again = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    twice[again] += 1
    np.subtract.at(twice, again + gram, 1)
    covered = np.cumsum(twice)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    inner = np.flatnonzero(np.diff(doc)) + 1
    inner = inner[covered[inner] & covered[inner - 1]]  # two texts that touch
    cuts = np.sort(np.concatenate([edge, inner, inner]))
    return [(a, b) for a, b in cuts.reshape(-1, 2).tolist() if b - a >= min_words]


def found_runs(texts: list[str | None], min_words: int, min_exponent: int) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """For each text its number of words, its runs and what is left of it."""
    split = [words(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for part in split for w in part), np.int64, int(sizes.sum()))
    doc, begin = np.repeat(np.arange(len(split)), sizes), np.cumsum(sizes) - sizes
    runs: dict[int, list[tuple[int, int, int]]] = {}
    # windows so short that each of a run's stands in it twice
    gram = max(1, min_words * (min_exponent - 2) // min_exponent)
    for a, b in _spots(codes, doc, gram, min_words):
        d = int(doc[a])
        base = a - int(begin[d])
        runs.setdefault(d, []).extend((base + start, length, period) for start, length, period in runs_of(codes[a:b].tolist(), min_words, min_exponent))
    out = []
    for d, w in enumerate(split):
        kept = w
        if own := runs.get(d):
            own.sort(key=lambda r: (r[0], r[2]))
            gone = np.zeros(len(w) + 1, np.int64)
            for start, length, period in own:
                gone[start + period] += 1
                gone[start + length] -= 1
            kept = [w[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
        out.append((len(w), own or [], b" ".join(kept).decode("utf-8", "surrogatepass")))
    return out


def periodic_runs(docs: DataFrame, min_words: int = 24, min_exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, n_words, runs, collapsed` for every row, over whole texts.

    `runs` is an array of (start, length, period), sorted by start and period:
    the stretches of words in which words one period apart are identical, the
    period being the smallest such, that have at least `min_words` words and
    `min_exponent` periods (3 or more) and that no neighbouring word extends.
    `collapsed` has the words that no run holds behind its first period, joined
    by one space.

    A null or empty text has no words, no runs and an empty `collapsed`;
    repeated rows come back each; a null id stays null; an empty table gives no
    rows. Other columns are not looked at. A task holds one batch of texts, and
    time and memory are linear in its words but for the lookups of extensions,
    which take n log n at most.
    """
    if min_exponent < 3 or min_words < 1:
        raise ValueError("a run has three periods and one word at least")

    @F.pandas_udf("struct<n_words:long,starts:array<long>,lengths:array<long>,periods:array<long>,collapsed:string>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for part in slices(texts):
            for n, runs, kept in found_runs(part.tolist(), min_words, min_exponent):
                out.append((n, [r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], kept))
        return pd.DataFrame(out, columns=["n_words", "starts", "lengths", "periods", "collapsed"])

    found = docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("f"))
    runs = F.arrays_zip(F.col("f.starts").alias("start"), F.col("f.lengths").alias("length"), F.col("f.periods").alias("period"))
    return found.select(F.col("id").alias(id_col), F.col("f.n_words").alias("n_words"), runs.alias("runs"), F.col("f.collapsed").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """The run of the greatest length over period (exactly), then the smallest start, then the smallest period; null if there is none."""

    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (x > y) | (x == y) & ((a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["period"] < b["period"]))

    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))


def repeat_tail(text: Column, start: Column, period: Column) -> Column:
    """The words of `text`, joined by spaces; from word `start` on its next `period` words over and over, up to as many words as before."""
    w = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rest = F.size(w) - start
    block = F.slice(w, start + 1, period)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / period).cast("int"))), F.lit(1), rest)
    return F.array_join(F.concat(F.slice(w, F.lit(1), start), tail), " ")
