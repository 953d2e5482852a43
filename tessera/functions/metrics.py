"""Rank metrics as columns: r is a rank from 1 (0: absent), k the size of the result, e the expected rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEEPNESS = 3.0


def _in(r: Column, k: Column, score: Column) -> Column:
    return F.when((r > 0) & (r <= k), score).otherwise(F.lit(0.0))


def expected(e: Column) -> Column:
    """The expected rank, 1 where none is given."""
    return F.when(F.coalesce(e, F.lit(0)) <= 0, F.lit(1)).otherwise(e)


def rr(r: Column, k: Column) -> Column:
    return _in(r, k, 1.0 / r)


def ps(r: Column, k: Column) -> Column:
    return _in(r, k, F.lit(1.0))


def np_(r: Column, k: Column) -> Column:
    """1 where the target is not among the results."""
    return 1.0 - ps(r, k)


def lzp(r: Column, k: Column) -> Column:
    return _in(r, k, 1.0 - (r - 1) / k)


def ezp(r: Column, k: Column, s: float = STEEPNESS) -> Column:
    return _in(r, k, (F.exp((k - r + 1) / s) - 1) / (F.exp(k / s) - 1))


def lep(r: Column, k: Column, e: Column) -> Column:
    return _in(r, k, 1.0 - F.abs(e - r) / k)


def eep(r: Column, k: Column, e: Column, s: float = STEEPNESS) -> Column:
    return _in(r, k, (F.exp((k - F.abs(e - r)) / s) - 1) / (F.exp(k / s) - 1))


def zndcg(r: Column, k: Column) -> Column:
    return _in(r, k, 1.0 / F.log2(r + 1))


def endcg(r: Column, k: Column, e: Column) -> Column:
    return _in(r, k, F.log2(e + 1) / F.log2(r + 1))


def min_position(r: Column, least: Column, window: int = 20) -> Column:
    """Falls from 1 by a twentieth for each place beyond the one asked for (places from 0); 0 if absent."""
    return F.when(r > 0, F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0), r - 1 - least) / float(window))).otherwise(F.lit(0.0))


#: The score of an actual against an expected group.
EXTENDED_WEIGHTS = {"HR,HR": 1.0, "HR,LR": 0.6, "HR,NP": 0.0, "LR,HR": 0.6, "LR,LR": 1.0, "LR,NP": 0.0, "NP,HR": 0.0, "NP,LR": 0.0, "NP,NP": 1.0}


def extended_presence(actual: Column, expected_group: Column, weights: dict[str, float] | None = None) -> Column:
    """The weight of the pair; actual is HR if the cut kept the target, LR if it is in the results, NP if not."""
    key, out = F.concat_ws(",", actual, expected_group), F.lit(0.0)
    for pair, weight in (weights or EXTENDED_WEIGHTS).items():
        out = F.when(key == pair, F.lit(weight)).otherwise(out)
    return out


def _pairs(ranks: Column, k: Column) -> Column:
    """For adjacent targets, whether both are in range and in order."""
    at = F.sequence(F.lit(0), F.size(ranks) - 2)
    good = lambda i: (F.get(ranks, i) > 0) & (F.get(ranks, i) <= k) & (F.get(ranks, i + 1) > 0) & (F.get(ranks, i + 1) <= k) & (F.get(ranks, i) < F.get(ranks, i + 1))
    return F.when(F.size(ranks) > 1, F.transform(at, lambda i: F.coalesce(good(i), F.lit(False))))


def crp(ranks: Column, k: Column) -> Column:
    """The share of adjacent targets in range and order; null for fewer than two targets."""
    good = _pairs(ranks, k)
    return F.size(F.filter(good, lambda x: x)) / F.size(good)


def cap(ranks: Column, k: Column) -> Column:
    """1 if all adjacent targets are in range and order, else 0; null for fewer than two targets."""
    return F.forall(_pairs(ranks, k), lambda x: x).cast("double")


POINTWISE = ("CP", "RR", "Ps", "NP", "lzp", "ezp", "lep", "eep", "znDCG", "enDCG")


def pointwise(r: Column, k: Column, e: Column) -> dict[str, Column]:
    """All metrics of one rank, by name."""
    e = expected(e)
    return {"CP": rr(r, k), "RR": rr(r, k), "Ps": ps(r, k), "NP": np_(r, k), "lzp": lzp(r, k), "ezp": ezp(r, k), "lep": lep(r, k, e), "eep": eep(r, k, e), "znDCG": zndcg(r, k), "enDCG": endcg(r, k, e)}
