import os
import random

import numpy as np
import pytest

from tessera.streaming.keyed import KeyedTable, filter_of, may_hold

KIND = "k string, n int, v string"


def table(spark, tmp_path, **more):
    return KeyedTable(spark, f"file://{tmp_path}/t", ["k"], KIND, **more)


def rows(spark, *data):
    return spark.createDataFrame(list(data), KIND).coalesce(1)


def files(tmp_path):
    return sum(len(f) for _, _, f in os.walk(tmp_path))


def now(t):
    return sorted(((r.k or "", r.n, r.v) for r in t.rows().collect()))


def test_filters_hold_their_keys():
    keys = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000)
    bits = filter_of(keys[:1000])
    assert may_hold(bits, keys[:1000]).all()
    assert may_hold(bits, keys[1000:]).mean() < 0.03
    assert not may_hold(filter_of(keys[:0]), keys).any()


def test_insert_keeps_the_first_and_merges_parts(spark, tmp_path):
    t, want, rng = table(spark, tmp_path, buckets=2, most=2), {}, random.Random(2)
    for batch in range(5):
        new = [(rng.choice("abcdefgh"), rng.randrange(100), f"{batch}-{i}") for i in range(4)] + [(None, batch, "null")]
        t.insert(rows(spark, *new), batch, ["n", "v"])
        for k, n, v in sorted(new, key=lambda r: (r[1], r[2])):
            want.setdefault(k or "", (n, v))
    assert now(t) == sorted((k, *x) for k, x in want.items())
    assert all(len(p) <= 2 for p in t.manifest().parts.values())
    before = now(t)
    t.insert(rows(spark, ("z", 1, "again")), 4, ["n"])  # a batch that is run again
    assert now(t) == before


def test_only_parts_that_may_hold_a_key_are_opened(spark, tmp_path):
    t = table(spark, tmp_path, buckets=4)
    t.insert(rows(spark, *[(f"key{i}", i, "x") for i in range(40)]), 0, ["n"])
    parts = t.manifest().parts
    assert len(parts) == 4
    assert t.possible(rows(spark, ("key7", 0, "y")), parts).keys() == {b for b in parts if ("key7", 7, "x") in now_of(t, {b: parts[b]})}
    absent = t.possible(rows(spark, *[(f"other{i}", 0, "y") for i in range(3)]), parts)
    assert sum(map(len, absent.values())) <= 1  # but for a false hit
    # what no key of a batch can be in may be gone from the disk: it is not opened
    hit = next(b for b in parts if ("key7", 7, "x") in now_of(t, {b: parts[b]}))
    for b, commits in parts.items():
        if b != hit:
            for f in os.listdir(f"{tmp_path}/t/data/{commits[0]}/__bucket={b}"):
                os.unlink(f"{tmp_path}/t/data/{commits[0]}/__bucket={b}/{f}")
    t.insert(rows(spark, ("key7", 0, "second")), 1, ["n"])
    assert ("key7", 7, "x") in now_of(t, {hit: t.manifest().parts[hit]})


def now_of(t, parts):
    return {tuple(r) for r in t.rows(parts).collect()}


def test_many_upserts_leave_few_files(spark, tmp_path):
    t, want = table(spark, tmp_path, buckets=3), {}
    counts = []
    for batch in range(12):
        new = [(f"k{batch % 4}", batch, "x"), (f"k{(batch + 1) % 4}", batch - 5, "y")]
        t.upsert(rows(spark, *new), batch, ["n"])
        for k, n, v in new:
            if k not in want or want[k][0] <= n:
                want[k] = (n, v)
        counts.append(files(tmp_path))
    assert now(t) == sorted((k, *x) for k, x in want.items())
    assert max(counts[6:]) <= max(counts[:6]) + 4  # bounded, however many batches


def test_a_crash_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, buckets=2)
    t.upsert(rows(spark, ("a", 1, "old"), ("b", 1, "old")), 0, ["n"])
    before, count = now(t), files(tmp_path)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.upsert(rows(spark, ("a", 2, "new")), 1, ["n"])
    assert now(t) == before and files(tmp_path) > count
    t.upsert(rows(spark, ("a", 2, "new")), 1, ["n"])
    assert now(t) == [("a", 2, "new"), ("b", 1, "old")]
    t.upsert(rows(spark, ("b", 3, "new")), 2, ["n"])
    t.upsert(rows(spark, ("a", 4, "new")), 3, ["n"])
    assert len(os.listdir(f"{tmp_path}/t/data")) <= 4  # what the crash left is gone
    # two writers that began with the same manifest: the second one fails
    stale = t.manifest()
    t.upsert(rows(spark, ("c", 1, "x")), 4, ["n"])
    with pytest.raises(RuntimeError):
        t._commit(stale, 4, {})
