import hashlib
import random
import zlib

import numpy as np

from tessera.llm import queries
from tessera.llm.listrank import list_rank, shortened
from tessera.llm.ranges import in_ranges, running
from tessera.llm.trie import _digest_of_ends, numbered_turns, prefix_trie
from tests.llm.helpers import words


def plain_trie(convs):
    """Nodes of {conversation: [(role, text), ...]} by looking at every prefix."""
    through, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            through.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {p: [] for p in through}
    for p in through:
        if p:
            kids[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(through, key=len, reverse=True):
        own = (len(through[p]) - 1) * len(words(p[-1][1])) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids[p]) or 1, own + sum(sums[k][1] for k in kids[p]))
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(through[p]), len(p), min(through[p[:-1]]) if p else None, len(through[p]), len(kids[p]), *sums[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out)


def rows_of(convs):
    return [(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, num long, part string, k string")


def got_of(df):
    return sorted(map(tuple, df.collect()))


def test_trie_equals_every_prefix(spark):
    rng = random.Random(4)
    convs = {}
    for c in rng.sample(range(-50, 500), 120):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["", "a", "b c", "d  e\nf"])) for _ in range(rng.choice([1, 2, 3, 6]))]
        convs[c] = turns
    convs[900] = [("user", "deep")] * 150
    for c in range(1000, 1090):
        convs[c] = [("system", "the same")]
    rows = rows_of(convs)
    rng.shuffle(rows)
    empty = spark.createDataFrame([(5000,), (-60,), (900,), (None,)], "conv long")
    got = got_of(prefix_trie(numbered_turns(table(spark, rows)), empty))
    assert got == plain_trie(convs | {5000: [], -60: []})


def test_odd_rows(spark):
    # null turns first, ties by role and text, repeated rows are turns, null roles and texts empty, null conversations left out
    rows = [(1, 2, "user", "z"), (1, None, "user", "first"), (1, 2, "assistant", None), (1, 3, None, "w"), (1, 3, None, "w"), (None, 0, "user", "gone"), (2, 7, "user", "first")]
    convs = {1: [("user", "first"), ("assistant", ""), ("user", "z"), ("", "w"), ("", "w")], 2: [("user", "first")]}
    assert got_of(prefix_trie(numbered_turns(table(spark, rows)))) == plain_trie(convs)
    assert prefix_trie(numbered_turns(table(spark, []))).count() == 0
    only = spark.createDataFrame([(3,), (9,)], "conv long")
    assert got_of(prefix_trie(numbered_turns(table(spark, [])), only)) == plain_trie({3: [], 9: []})


def test_lists_in_any_order(spark):
    rng = random.Random(6)
    for n, at_once in ((1, 8), (7, 8), (60, 8), (400, 30)):
        place = list(range(n))
        rng.shuffle(place)
        names = rng.sample(range(10**6), n)
        links = [(names[a], names[b]) for a, b in zip(place, place[1:])] + [(names[place[-1]], -1)]
        df = spark.createDataFrame(links, "arc long, next long").repartition(3)
        assert {r.arc: r.pos for r in list_rank(df, at_once).collect()} == {names[p]: i for i, p in enumerate(place)}
    assert list_rank(spark.createDataFrame([], "arc long, next long")).count() == 0


def test_stretches_are_shortened():
    arc, after, size = np.array([5, 3, 9, 7]), np.array([9, 7, 20, -1]), np.array([1, 2, 3, 4])
    head, far, beyond, length = shortened(arc, after, size)
    assert arc[head].tolist() == [5, 3, 5, 3] and far.tolist() == [0, 0, 1, 2]
    assert beyond[[0, 1]].tolist() == [20, -1] and length[[0, 1]].tolist() == [4, 6]


def test_running_totals_across_ranges(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    rows = [(k, i, rng.randrange(100)) for k, n in ((1, 300), (2, 1), (3, 40), (9, 500)) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = in_ranges(spark.createDataFrame(rows, "key long, at long, v long").repartition(5), "key", "at")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt.select("part").distinct().count() > 1
    got = {(r.key, r.at): (r.s, r.before) for r in running(running(dealt, "key", ["at"], {"s": F.col("v")}), "key", ["at"], {"before": F.col("at")}, F.max, F.greatest, inclusive=False).collect()}
    sums = {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        assert got[k, i] == (sums[k], i - 1 if i else None)


def test_ends_are_hashed_over_batches():
    import pandas as pd

    frames = [pd.DataFrame([(1, 2, 3, "4,5"), (1, 2, 3, "9")], columns=["k1", "k2", "depth", "ids"]), pd.DataFrame([(1, 2, 3, "11"), (2, 0, 1, "7")], columns=["k1", "k2", "depth", "ids"])]
    got = pd.concat(list(_digest_of_ends(iter(frames)))).values.tolist()
    assert got == [[1, 2, 3, hashlib.sha256(b"4,5,9,11").hexdigest()], [2, 0, 1, hashlib.sha256(b"7").hexdigest()]]


def test_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    own = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn is not None, r.turn or 0)):
        own.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    got = queries.op13_prefix_trie(spark, sf)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got_of(got) == plain_trie(rebuilt)
