"""Gradient-boosted trees in numpy: fitted once, scored from flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All nodes of all trees in one set of arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds: every row walks down one tree in lock-step with all others."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: int = 5) -> Forest:
    """Logistic loss, Newton leaves, split points at quantiles.

    `monotone` holds -1, 0 or 1 a feature: the score may only fall, do as it
    likes, or rise with it. A split against the sign is not taken, and the
    middle of its two values bounds all that comes below either side.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        at = len(feature)
        for column, v in ((feature, 0), (threshold, np.inf), (left, at), (right, at), (value, 0.0)):
            column.append(v)
        return at

    def grow(rows: np.ndarray, low: float, high: float, level: int, g: np.ndarray, h: np.ndarray) -> int:
        at, gs, hs = node(), g[rows].sum(), h[rows].sum()
        value[at] = rate * float(np.clip(-gs / (hs + penalty), low, high))
        if level == depth or len(rows) < 2 * least:
            return at
        best = (1e-6, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gl, hl = (np.cumsum(np.bincount(b, v[rows], len(c) + 1))[:-1] for v in (g, h))
            vl, vr = np.clip(-gl / (hl + penalty), low, high), np.clip(-(gs - gl) / (hs - hl + penalty), low, high)
            gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
            gain[(n < least) | (len(rows) - n < least) | (monotone[f] * (vr - vl) < 0)] = 0
            if gain[k := int(gain.argmax())] > best[0]:
                best = (gain[k], (f, k, (vl[k] + vr[k]) / 2))
        if best[1] is None:
            return at
        f, k, middle = best[1]
        goes = binned[rows, f] <= k
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[f])]
        feature[at], threshold[at] = f, cuts[f][k]
        left[at] = grow(rows[goes], *bounds[0], level + 1, g, h)
        right[at] = grow(rows[~goes], *bounds[1], level + 1, g, h)
        return at

    def forest() -> Forest:
        return Forest(*(np.array(v) for v in (feature, threshold, left, right, value, roots)), depth, base)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), -np.inf, np.inf, 0, p - y, p * (1 - p)))
        one = forest()
        one.roots, one.base = one.roots[-1:], 0.0
        margin += one.margin(x)
    return forest()
