"""Near-duplicates by SimHash, found in an inverted index of byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.shingles import BANDS, bands, maybe_alike, shared_counts, shingle_hashes, sketch
from tessera.llm.substring import word_hashes
from tessera.llm.text import columns_of, whole_row, whole_runs, words
from tessera.session import dropped, written

SEED = 42
#: Rows of a list that are compared with so many others at once.
BLOCK = 512
#: Blocks of rows beside its largest group up to which a list or a group is compared pair by pair.
CROWD = 8
#: Sets of shingles in a block of those that pairs are counted by.
VERIFIED = 1024
#: Shingles whose bits are counted at once, and pairs that are tallied at once.
AT_ONCE, PAIRS = 65_536, 2_000_000
#: Odd multipliers: each gives the words of a text another fingerprint.
_PRINTS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)


#: The bits of each byte, and where the counts of each byte position begin.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_AT = np.arange(8 * len(_PRINTS)) * 256


def _majority(h: np.ndarray) -> np.ndarray:
    """How many of each row's hashes have each of the 64 bits: bytes are counted first, then their bits."""
    rows, ones = len(h), np.zeros((len(h), 64), np.int64)
    for i in range(0, h.shape[1], AT_ONCE):
        part = np.ascontiguousarray(h[:, i : i + AT_ONCE]).astype("<u8", copy=False)
        places = part.view(np.uint8).reshape(rows, -1, 8).astype(np.int64) + _AT[: 8 * rows].reshape(rows, 1, 8)
        ones += (np.bincount(places.ravel(), minlength=2048 * rows).reshape(8 * rows, 256) @ _BITS).reshape(rows, 64).astype(np.int64)
    return ones


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of the word shingles of a text, repeats included.

    A bit is set if it is set in more than half of the shingles' XXH64. Fewer
    words than a shingle make one shingle; no words give zero.
    """
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    whole, n, digest = b" ".join(w), max(1, len(w) - shingle + 1), xxhash.xxh64_intdigest
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist() if len(w) >= shingle else [len(whole)]
    ones = np.zeros(64, np.int64)
    for i in range(0, n, AT_ONCE):
        ones += _majority(np.array([[digest(whole[a:b], seed) for a, b in zip(starts[i : i + AT_ONCE], stops[i : i + AT_ONCE])]], np.uint64))[0]
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def word_prints(hashes: np.ndarray) -> np.ndarray:
    """Two SimHashes of the distinct words of a text, given by their hashes; zero for no words."""
    u = np.unique(hashes)
    h = u[None, :] * _PRINTS[:, None]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.packbits(2 * _majority(h ^ (h >> np.uint64(32))) > len(u), axis=1, bitorder="little").view("<u8").ravel()


def index_positions(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions one of which any two close fingerprints share.

    Fingerprints at `max_bits` differing bits share 8 - max_bits bytes at
    least. The positions fall into as many halves, quarters or eighths as
    leave the largest sets that one part must still hold by the pigeonhole rule.
    """
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must lie between 0 and 7: beyond, no byte need be shared")
    least, found = 8 - max_bits, []
    for parts in (1, 2, 4, 8):
        size = -(-least // parts)
        groups = [range(i, i + 8 // parts) for i in range(0, 8, 8 // parts)]
        found.append((size, [c for g in groups for c in combinations(g, min(size, len(g)))]))
    # the longest keys that cost no more than 28 rows a fingerprint
    return max((x for x in found if len(x[1]) <= 28), key=lambda x: (x[0], -len(x[1])))[1]


def posted_pairs(postings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows that stand in one posting list; `postings` names the list of each row, below zero for none."""
    rows = np.flatnonzero(postings >= 0)
    rows = rows[np.argsort(postings[rows], kind="stable")]
    of, x, y, d = postings[rows], [], [], 1
    while True:
        met = np.flatnonzero(of[d:] == of[:-d]) if d < len(of) else np.zeros(0, np.int64)
        if not len(met):
            break
        x.append(rows[met])
        y.append(rows[met + d])
        d += 1
    if not x:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(x), np.concatenate(y)


def tallied_pairs(fp: np.ndarray, of: np.ndarray, known: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one list that share `least` bytes at their places.

    The inverted index has a posting list for each list, position and byte.
    Every common posting list counts one for a pair; pairs with fewer than the
    guaranteed number go. `known` (rows x 8) marks the positions that make the
    list's key: all its pairs share them.
    """
    b, n, codes = fp.view(np.uint8).reshape(-1, 8).astype(np.int64), len(fp), []
    for p in range(8):
        x, y = posted_pairs(np.where(known[:, p], -1, of * 256 + b[:, p]))
        codes.append(np.minimum(x, y) * n + np.maximum(x, y))
    pair, often = np.unique(np.concatenate(codes), return_counts=True)
    x, y = pair // n, pair % n
    held = known.sum(axis=1)
    some = often + held[x] >= least
    if (held >= least).any():  # the key alone guarantees enough
        p, q = posted_pairs(np.where(held >= least, of, -1))
        return np.concatenate([x[some & (held[x] < least)], np.minimum(p, q)]), np.concatenate([y[some & (held[x] < least)], np.maximum(p, q)])
    return x[some], y[some]


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which links make a spanning forest, the lightest first, ties by their ends."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while (j := up.get(i, i)) != i:
            up[i] = up.get(j, j)
            i = j
        return i

    taken = []
    for k in np.lexsort((b, a, weight)).tolist():
        p, q = top(int(a[k])), top(int(b[k]))
        if p != q:
            up[max(p, q)] = min(p, q)
            taken.append(k)
    return np.array(taken, np.int64)


def list_sizes(rows: DataFrame, keys: list[str], labelled: bool) -> DataFrame:
    """`keys, most, k, m` of every list with two rows at least that may meet: its most common label, its rows, and the other rows.

    Without `labelled` every row is its own label. Written, so that joins with
    it read two plain shuffles and Spark can split a list with very many rows.
    """
    if labelled:
        sizes = rows.groupBy(*keys, "label").agg(F.count("*").alias("n")).groupBy(*keys)
        sizes = sizes.agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("t"), F.count("*").alias("labels")).filter("labels > 1").select(*keys, F.col("t.label").alias("most"), F.col("t.n").alias("k"), (F.col("n") - F.col("t.n")).alias("m"))
    else:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("label").alias("most")).filter("n > 1").select(*keys, "most", F.lit(1).cast("long").alias("k"), (F.col("n") - 1).alias("m"))
    return written(sizes, "sizes")


def dealt(rows: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """`rows` (keys, node, label, ...) with `kind, i, j, top, own`: any two rows of a list of `sizes` with unlike labels meet in one block.

    Rows of a list's most common label need not meet each other, so a list of
    very many rows that are known to belong together is dealt out once: its
    blocks meet the blocks of the other rows, and those meet each other. Lists
    with one label vanish.
    """
    both = rows.join(sizes, keys)
    top = F.col("label") == F.col("most")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    both = both.withColumn("top", top).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("top"), blocks("k")).otherwise(blocks("m"))).cast("int"))
    at = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    own = F.col("own")
    to_most = F.transform(upto("k"), lambda x: at(0, x, own))
    to_rest = F.when(F.col("m") > 1, F.transform(upto("m"), lambda x: at(1, F.least(own, x), F.greatest(own, x)))).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int>>"))
    places = F.when(F.col("top"), F.transform(upto("m"), lambda x: at(0, own, x))).otherwise(F.concat(to_most, to_rest))
    return both.withColumn("place", F.explode(places)).select("*", "place.*").drop("most", "k", "m", "place")


def _meet(run: pd.DataFrame, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of a block are to be compared there."""
    top, own, label = run["top"].to_numpy(bool), run["own"].to_numpy(), run["label"].to_numpy()
    across, one = run["kind"].to_numpy()[x] == 0, (run["i"] == run["j"]).to_numpy()[x]
    return (label[x] != label[y]) & np.where(across, top[x] != top[y], one | (own[x] != own[y]))


def _in_blocks(rows: DataFrame, keys: list[str], compare, ends: str = "label") -> DataFrame:
    """`a, b`: links between the `ends` of rows, enough to connect what `compare` finds; it gets runs of whole blocks and the number of each row's block."""
    every = [*keys, "kind", "i", "j"]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in whole_runs(batches, every):
            k = run[every].to_numpy(np.int64)
            number = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(run)]])
            pairs = np.cumsum(np.diff(cuts) ** 2) // PAIRS
            # some blocks at a time, as many as have so many pairs
            for part in np.split(np.arange(len(cuts) - 1), np.flatnonzero(np.diff(pairs)) + 1):
                some = run.iloc[cuts[part[0]] : cuts[part[-1] + 1]].reset_index(drop=True)
                x, y, weight = compare(some, number[cuts[part[0]] : cuts[part[-1] + 1]])
                if len(x):
                    end = some[ends].to_numpy(np.int64)
                    a, b = np.minimum(end[x], end[y]), np.maximum(end[x], end[y])
                    kept = spanning(a, b, weight)
                    yield pd.DataFrame({"a": a[kept], "b": b[kept]})

    return rows.repartition(*every).sortWithinPartitions(*every, "node").mapInPandas(of, "a long, b long")


def _close(max_bits: int, sets: list[tuple[int, ...]], verify: float | None):
    """Pairs of close fingerprints of a list; with `verify` those that sketches do not rule out, and all pairs of a band."""
    known = np.zeros((len(sets) + 1, 8), bool)
    for i, s in enumerate(sets):
        known[i, list(s)] = True

    def of(run: pd.DataFrame, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp, at = run["fp"].to_numpy(np.int64).view(np.uint64), run["at"].to_numpy(np.int64)
        of_band = at < 0
        x, y = tallied_pairs(fp, np.where(of_band, -1, number), known[np.where(of_band, len(sets), at % len(sets))], 8 - max_bits)
        bits = np.bitwise_count(fp[x] ^ fp[y])
        x, y, bits = x[bits <= max_bits], y[bits <= max_bits], bits[bits <= max_bits]
        if of_band.any():
            p, q = posted_pairs(np.where(of_band, number, -1))
            x, y, bits = np.concatenate([x, p]), np.concatenate([y, q]), np.concatenate([bits, np.full(len(p), 64, bits.dtype)])
        some = _meet(run, x, y)
        x, y, bits = x[some], y[some], bits[some]
        if verify is not None and len(x):
            some = maybe_alike(_sketches(run), x, y, verify)
            x, y, bits = x[some], y[some], bits[some]
        return x, y, bits

    return of


def _sketches(run: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, run["sketch"])), np.uint64).reshape(len(run), -1)


def _alike(verify: float):
    """Pairs of a block whose shingles have the similarity, counted exactly where sketches leave it open."""

    def of(run: pd.DataFrame, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = posted_pairs(number)
        some = _meet(run, x, y)
        x, y = x[some], y[some]
        some = maybe_alike(_sketches(run), x, y, verify)
        x, y = x[some], y[some]
        if not len(x):
            return x, y, np.zeros(0)
        every = {i: shingle_hashes(word_hashes([w.lower() for w in words(run["text"].iat[i])])) for i in np.unique(np.concatenate([x, y])).tolist()}
        alike = np.zeros(len(x))
        order = np.argsort(number[x], kind="stable")
        for pairs in np.split(order, np.flatnonzero(np.diff(number[x][order])) + 1):  # block by block
            used = np.unique(np.concatenate([x[pairs], y[pairs]]))
            sets, p, q = [every[i] for i in used.tolist()], np.searchsorted(used, x[pairs]), np.searchsorted(used, y[pairs])
            n, both = np.array([len(s) for s in sets]), shared_counts(sets, p, q)
            alike[pairs] = both / np.maximum(n[p] + n[q] - both, 1)
        some = alike >= verify
        return x[some], y[some], 1 - alike[some]

    return of


def _entries(n_prints: int, sets: list[tuple[int, ...]]) -> list[Column]:
    """The keys under which a class of `fps` stands in the index."""
    out = []
    for seed in range(n_prints):
        fp = F.element_at("fps", seed + 1)
        for at, positions in enumerate(sets):
            key = F.lit(0).cast("long")
            for p in positions:
                key = key * 256 + F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))
            out.append(F.struct(F.lit(seed * len(sets) + at).alias("at"), key.alias("key"), fp.alias("fp")))
    return out


def fingerprint_links(classes: DataFrame, max_bits: int = 3) -> DataFrame:
    """`a, b`: links that connect all `node` of which `fps` has one fingerprint, at `max_bits` differing bits at most.

    The inverted index lists the fingerprints under their positional bytes. A
    list for one byte would hold a 256th of all, so a list stands for several
    positions at once, chosen so that every pair with the guaranteed number of
    shared bytes meets in one list (`index_positions`). Within a list single
    positions have posting lists of their own, from which the shared bytes of
    each pair are tallied (`tallied_pairs`); pairs under the guaranteed number
    go, and the rest are verified bit by bit. A list gives a spanning forest of
    its links, never its pairs; a long list is dealt out in blocks, each pair
    of blocks to a task of its own.
    """
    sets = index_positions(max_bits)
    index = classes.select("node", F.explode(F.array(*_entries(1, sets))).alias("e")).select("node", F.col("node").alias("label"), "e.*")
    return _in_blocks(dealt(index, ["at", "key"], list_sizes(index, ["at", "key"], False)), ["at", "key"], _close(max_bits, sets, None))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, seed: int = SEED) -> DataFrame:
    """`id_col, fingerprint, component_id` for every row: texts whose fingerprints link, over any number of links.

    Two texts link if their fingerprints differ in `max_bits` bits at most.
    component_id is the smallest id reachable, the row's own included.

    Null and empty texts have fingerprint zero and link like any other. A null
    id takes the smallest id of its component (null if there is none); repeated
    rows come back each. An empty table gives an empty result. Other columns
    are not looked at. Equal fingerprints are one entry of the index.
    """

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    fps = written(docs.select(F.col(id_col).alias("__id"), of(F.col(text_col)).alias("node")), "fingerprints")
    classes = written(fps.groupBy("node").agg(F.min("__id").alias("least")), "classes")
    links = fingerprint_links(classes.select("node", F.array("node").alias("fps")), max_bits)
    rooted = classes.join(connected_components(links), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # written, as in the rounds: one component may hold a third of all classes
    small = written(rooted.groupBy("root").agg(F.min("least").alias("least")), "components")
    found = rooted.select("node", "root").join(small, "root").select("node", "least")
    return fps.join(found, "node").select(F.col("__id").alias(id_col), F.col("node").alias("fingerprint"), F.col("least").alias("component_id"))


def _texts(fps: DataFrame, nodes: DataFrame) -> DataFrame:
    """`node, text, sketch`: one text of each of some classes; the join shuffles at every size, as it must at scale."""
    return written(fps.join(nodes.select("node").distinct().hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"), F.first("sketch").alias("sketch")), "texts")


def prefix_links(members: DataFrame, texts: DataFrame, verify: float) -> DataFrame:
    """`a, b`: links of labels, enough to connect all pairs of `members` (node, label, group) of one group that have the similarity and unlike labels.

    No group's pairs are compared one by one. The shingles of a text are
    sorted by how many texts of the group have them, the rarest first. Two
    texts of the similarity, the smaller with x and the larger with y
    shingles, share at least 2v / (1 + v) of x and v of y, so one of the first
    x - ceil(2v / (1 + v) x) + 1 shingles of the one is among the first
    y - ceil(v y) + 1 of the other. Texts that share a template but have a
    ninth of their own do not meet at all. Pairs that meet, whose sizes and
    places leave enough, are counted by their exact shingles.
    """

    @F.pandas_udf("array<long>")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(word_hashes([w.lower() for w in words(t)])).view(np.int64) for t in batch])

    sets = written(texts.join(members.select("node").distinct(), "node", "left_semi").select("node", of("text").alias("shingles")), "sets")
    each = members.join(sets, "node").select("node", "label", "group", F.explode("shingles").alias("h"))
    often = written(each.groupBy("group", "h").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    # written, so that Spark can split a shingle that very many texts have
    counted = written(each.join(often, ["group", "h"], "left").select("node", "label", "group", F.coalesce("df", F.lit(1).cast("long")).alias("df"), "h"), "counted")
    ranked = counted.groupBy("node", "label", "group").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s")).withColumn("n", F.size("s"))
    first = lambda share: (F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1).cast("int")
    places = lambda share: F.posexplode(F.transform(F.slice("s", F.lit(1), first(share)), lambda x: x["h"])).alias("at", "h")
    some = ranked.filter("n > 0")
    ask = some.select("group", "node", "label", "n", places(verify))
    # a shingle that one text alone has leads nowhere
    own = some.select("group", "node", "label", "n", places(2 * verify / (1 + verify))).join(often.select("group", "h"), ["group", "h"], "left_semi")
    own = written(own.select("group", "h", F.col("node").alias("x"), F.col("label").alias("a"), F.col("n").alias("nx"), F.col("at").alias("i")), "own")
    ask = written(ask.select("group", "h", F.col("node").alias("y"), F.col("label").alias("b"), F.col("n").alias("ny"), F.col("at").alias("j")).join(own.select("group", "h").distinct(), ["group", "h"], "left_semi"), "ask")
    # first with the least label of each list alone: of a large family that puts nearly all together, at a cost that grows with its texts
    every = own.select("group", "h", F.col("x").alias("node"), F.col("a").alias("label")).unionByName(ask.select("group", "h", F.col("y").alias("node"), F.col("b").alias("label")))
    least = written(every.groupBy("group", "h").agg(F.min(F.struct("label", "node")).alias("t")), "least")
    near = every.join(least, ["group", "h"]).filter(F.col("label") != F.col("t.label")).select(F.col("node").alias("x"), F.col("t.node").alias("y"), F.col("label").alias("a"), F.col("t.label").alias("b")).distinct()
    links = _counted(near, sets, verify)
    roots = connected_components(links).withColumnRenamed("root", "to")
    now = lambda df, c: df.join(roots.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    least_shared = F.ceil(F.lit(verify / (1 + verify)) * (F.col("nx") + F.col("ny")) - 1e-9)
    room = F.least("i", "j") + 1 + F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j")) - 1
    met = now(own, "a").join(now(ask, "b"), ["group", "h"]).filter((F.col("a") != F.col("b")) & (F.col("nx") <= F.col("ny")) & (F.col("nx") >= F.lit(verify) * F.col("ny") - 1e-9) & (room >= least_shared)).select("x", "y", "a", "b").distinct()
    links = written(links.unionByName(_counted(met, sets, verify)), "prefix-links")
    dropped(least)
    for table in (sets, often, counted, own, ask):
        dropped(table)
    return links


def _counted(pairs: DataFrame, sets: DataFrame, verify: float) -> DataFrame:
    """`a, b`: of pairs (x, y, a, b) of nodes and their labels links enough to connect the labels of those that have the similarity, by their exact shingles.

    A set goes once to each two blocks in which it is asked for, not once for each pair.
    """
    n_blocks = max(1, -(-sets.count() // VERIFIED))
    block = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(n_blocks))
    met = written(pairs.select("x", "y", "a", "b", block("x").alias("i"), block("y").alias("j")), "met")
    asked = met.select(F.col("i").alias("p"), F.col("j").alias("q"), F.explode(F.array("x", "y")).alias("node")).distinct().join(sets, "node")

    def verified(pairs: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if pairs.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        node = given["node"].to_numpy(np.int64)
        order = np.argsort(node)
        sets = [np.asarray(given["shingles"].iat[k], np.int64).view(np.uint64) for k in order.tolist()]
        x, y = (np.searchsorted(node[order], pairs[c].to_numpy(np.int64)) for c in ("x", "y"))
        sizes = np.array([len(s) for s in sets])
        both = shared_counts(sets, x, y)
        alike = both / np.maximum(sizes[x] + sizes[y] - both, 1)
        some = alike >= verify
        ends = [pairs[c].to_numpy(np.int64)[some] for c in ("a", "b")]
        least, most = np.minimum(*ends), np.maximum(*ends)
        kept = spanning(least, most, 1 - alike[some])
        return pd.DataFrame({"a": least[kept], "b": most[kept]})

    links = written(met.groupBy("i", "j").cogroup(asked.groupBy("p", "q")).applyInPandas(verified, "a long, b long"), "links")
    dropped(met)
    return links


def verified_groups(fps: DataFrame, classes: DataFrame, verify: float, max_bits: int) -> DataFrame:
    """`node, root` for every class of `classes` (node, fps, sketch, bands): groups of texts that links of the similarity connect.

    1. Every class is compared, by exact shingles, with the least one that any
       of its bands lists: that alone puts nearly all copies of a text
       together, at a cost that grows with their number.
    2. The lists of bands and of close fingerprints give further candidates:
       pairs of unlike groups that sketches do not rule out; of a list with
       over `CROWD` blocks of rows beside its largest group all rows, without a look at
       their pairs.
    3. Such a link may be false, and what it connects may still be alike. So in
       what the candidates connect all pairs of unlike groups are compared by
       their exact shingles: one by one where there are no more than `CROWD` blocks of rows
       beside the largest group, else those that their rarest shingles
       bring together (`prefix_links`). No true link between candidates is
       lost, and no part compares in the square of its rows.
    """
    sets = index_positions(max_bits)
    of_bands = [F.struct(F.lit(-1 - i).alias("at"), F.element_at("bands", i + 1).alias("key"), F.lit(0).cast("long").alias("fp")) for i in range(BANDS)]
    entries = classes.select("node", F.explode(F.array(*_entries(len(_PRINTS), sets), *of_bands)).alias("e")).select("node", "e.*")
    # most lists have one text: they go before anything else is known of them
    lists = written(entries.groupBy("at", "key").agg(F.min("node").alias("group"), F.count("*").alias("n")).filter("n > 1").drop("n"), "lists")
    shared = written(entries.join(lists.hint("merge"), ["at", "key"]), "shared")
    # one link each, to the least of all: what it does not tell is found in the next steps
    edges = written(shared.filter((F.col("at") < 0) & (F.col("node") != F.col("group"))).groupBy("node").agg(F.min("group").alias("group")), "edges")
    stars = edges.select("group", "node", F.lit(1).cast("long").alias("label")).unionByName(edges.select("group", F.col("group").alias("node"), F.lit(0).cast("long").alias("label")).distinct())
    sizes, texts = list_sizes(stars, ["group"], True), _texts(fps, stars)
    # the sides of a star are its labels, so that the one meets the others and they do not meet
    links = written(_in_blocks(dealt(stars, ["group"], sizes).join(texts, "node"), ["group"], _alike(verify), "node"), "links")
    for table in (lists, edges, texts, sizes):
        dropped(table)
    first = written(connected_components(links), "groups")
    dropped(links)
    known = written(classes.select("node", "sketch").join(first, "node", "left").select("node", "sketch", F.coalesce("root", "node").alias("label")), "known")

    index = shared.drop("group").join(known.select("node", "label"), "node")
    mixed = written(index.groupBy("at", "key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("at", "key", F.col("a").alias("least")), "mixed")
    index = written(index.join(mixed, ["at", "key"]), "index")
    few, many = f"m <= {CROWD * BLOCK}", f"m > {CROWD * BLOCK}"
    sizes = list_sizes(index, ["at", "key"], True)
    crowded = index.join(sizes.filter(many).select("at", "key"), ["at", "key"], "left_semi").filter("label <> least").select(F.col("least").alias("a"), F.col("label").alias("b")).distinct()
    lists = dealt(index.drop("least").join(known.select("node", "sketch"), "node"), ["at", "key"], sizes.filter(few))
    loose = written(_in_blocks(lists, ["at", "key"], _close(max_bits, sets, verify)).unionByName(crowded), "loose")
    for table in (shared, mixed, index, sizes):
        dropped(table)
    parts = connected_components(loose)
    parts = parts.select(F.col("node").alias("label"), F.col("root").alias("group")).unionByName(parts.select(F.col("root").alias("label"), F.col("root").alias("group")).distinct())
    members = written(known.select("node", "label").join(parts, "label"), "members")
    sizes, texts = list_sizes(members, ["group"], True), _texts(fps, members)
    links = _in_blocks(dealt(members, ["group"], sizes.filter(few)).join(texts, "node"), ["group"], _alike(verify))
    large = members.join(sizes.filter(many).select("group"), "group", "left_semi")
    if not large.isEmpty():
        links = links.unionByName(prefix_links(large, texts, verify))
    links = written(links, "links")
    last = connected_components(links).withColumnsRenamed({"node": "label", "root": "last"})
    found = written(known.select("node", "label").join(last, "label", "left").select("node", F.coalesce("last", "label").alias("root")), "roots")
    for table in (first, known, loose, members, sizes, texts, links):
        dropped(table)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, verify: float = 0.8) -> DataFrame:
    """One row of each group of `docs`, the one with the smallest id, all columns kept.

    Two texts link if their five-word shingles have a similarity of `verify`,
    which is counted exactly. They meet if either of two fingerprints over the
    distinct words of a text differ in `max_bits` bits at most: a copy with few
    words changed keeps most of its set of words, while three bits of one
    fingerprint over shingles would lose it. Texts that share a band of
    smallest hashes meet as well, for many a pair has no close fingerprints.
    Rows are told apart by id and text: a row with a null id goes if its group
    has ids, else the least hash of a text decides, as it does among texts of a
    group that share the smallest id. Of rows equal in both the one whose other
    columns come first, written as JSON, stays. Null
    texts and texts without words are one group. An empty table gives no rows;
    columns may have any names.
    """

    @F.pandas_udf("struct<fps:array<long>,sketch:binary,bands:array<long>,shingles:binary>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            h = word_hashes([w.lower() for w in words(t)])
            s = shingle_hashes(h)
            out.append((word_prints(h).view(np.int64), sketch(s), bands(s).view(np.int64), sha256(s.tobytes()).digest()[:16]))
        return pd.DataFrame(out, columns=["fps", "sketch", "bands", "shingles"])

    h = F.xxhash64(text_col)
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), h.alias("hash"))
    fps = docs.select(row.alias("row"), F.col(text_col).alias("text"), of(F.col(text_col)).alias("f")).select("row", "text", "f.*")
    fps = written(fps.withColumn("node", F.xxhash64("shingles")), "fingerprints")
    classes = written(fps.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fps", "sketch", "bands")], F.min("row").alias("least")), "classes")
    roots = verified_groups(fps, classes, verify, max_bits)
    rooted = classes.select("node", "least").join(roots, "node")
    # written, as in the rounds: one group may hold a third of all classes
    small = written(rooted.groupBy("root").agg(F.min("least").alias("least")), "components")
    found = rooted.select("node", "root").join(small, "root").select("node", "least")
    groups = written(fps.select("node", "row").join(found, "node").select("row", "least"), "groups")
    for table in (fps, classes, roots, small):
        dropped(table)
    gone = groups.filter(F.col("row") != F.col("least")).select(F.col("row.id").alias("__gone"), F.col("row.hash").alias("__hash")).distinct()
    stay = docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]) & (h == gone["__hash"]), "left_anti")
    if groups.groupBy("row").count().filter("count > 1").isEmpty():
        return stay
    row = whole_row(docs)
    first = stay.groupBy(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return first.select(*columns_of("__row", docs))
