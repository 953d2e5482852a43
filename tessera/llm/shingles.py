"""Hashes of word shingles: sketches that rule pairs out, bands that bring pairs together, exact counts."""

from __future__ import annotations

import numpy as np

from tessera.llm.substring import Prefix

#: Parts of a sketch, two bits each.
BINS = 256
#: Standard deviations that a sketch may be off before it rules a pair out.
SLACK = 5
#: Texts meet by so many bands of so many smallest shingle hashes: one pair in
#: a thousand at a similarity of 0.8 shares none.
BANDS, BAND = 24, 6
#: Pairs and hashes that are worked on at once.
AT_ONCE = 65_536
#: Multipliers, each of which brings the hashes into another order.
_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of the shingles of words given by their hashes, sorted; fewer words make one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(shingle, len(words))
    at = np.arange(len(words) - n + 1)
    return np.unique(Prefix(words).of(at, at + n))


def sketch(h: np.ndarray) -> bytes:
    """For each of `BINS` parts of the shingles one bit of the smallest, then whether there is one."""
    part = (h & np.uint64(BINS - 1)).astype(np.intp)
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, part, h >> np.uint64(8))
    full = np.zeros(BINS, np.uint8)
    full[part] = 1
    return np.concatenate([np.packbits((least & np.uint64(1)).astype(np.uint8) & full), np.packbits(full)]).tobytes()


def bands(h: np.ndarray) -> np.ndarray:
    """`BANDS` hashes, each of `BAND` smallest hashes of the shingles, every one under its own order."""
    if not len(h):
        return np.zeros(BANDS, np.uint64)
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        least = np.minimum(least, (h[None, i : i + 1024] * _ODD[:, None]).min(axis=1))
    return Prefix(least).of(np.arange(0, BANDS * BAND, BAND), np.arange(BAND, BANDS * BAND + 1, BAND))


def maybe_alike(sketches: np.ndarray, x: np.ndarray, y: np.ndarray, verify: float) -> np.ndarray:
    """Whether the sketches of rows x and y leave a similarity of `verify` open, up to `SLACK` deviations.

    A part that one text alone fills differs; of parts that differ in two
    texts one bit shows half.
    """
    bit, full, out = sketches[:, : BINS // 64], sketches[:, BINS // 64 :], []
    count = lambda v: np.bitwise_count(v).sum(axis=1, dtype=np.int64)
    for i in range(0, len(x), AT_ONCE):
        p, q = x[i : i + AT_ONCE], y[i : i + AT_ONCE]
        either = count(full[p] | full[q])
        differ = count(full[p] ^ full[q]) + 2 * count((bit[p] ^ bit[q]) & full[p] & full[q])
        out.append(differ <= (1 - verify) * either + SLACK * np.sqrt(either * (1 - verify**2)))
    return np.concatenate(out) if out else np.zeros(0, bool)


def shared_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair share.

    Few pairs (one text and its copies, say) are looked up in each other; where
    most sets meet most others all are counted together.
    """
    if len(x) > 16 * len(sets):
        return all_shared(sets)[x, y]
    out, order = np.zeros(len(x)), np.argsort(x, kind="stable")
    for pairs in np.split(order, np.flatnonzero(np.diff(x[order])) + 1) if len(x) else ():
        own = sets[x[pairs[0]]]
        for j in range(0, len(pairs), 256):
            part = pairs[j : j + 256]
            sizes = np.array([len(sets[k]) for k in y[part].tolist()])
            if not len(own) or not sizes.sum():
                continue
            others = np.concatenate([sets[k] for k in y[part].tolist()])
            there = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            sums, ends = np.concatenate([[0], np.cumsum(there)]), np.cumsum(sizes)
            out[part] = sums[ends] - sums[ends - sizes]
    return out


def all_shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = often > 1  # what one set alone has is shared with none
    column, of = (np.cumsum(common) - 1)[at[common[at]]], of[common[at]]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    out, width = np.zeros((len(sets), len(sets)), np.float64), 4096
    for lo in range(0, int(common.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), min(width, int(common.sum()) - lo)), np.float32)
        m[of[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out
