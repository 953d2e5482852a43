import hashlib
import random

import numpy as np
import pytest

from tessera.llm.substring import duplicate_spans, greedy_factors, joined, matched, removed_words
from tests.llm.helpers import corpus, docs_of, words


def brute(rows, least):
    first = {}
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - least + 1):
            key = tuple(w[k : k + least])
            if r[0] is not None:
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        keep = [True] * len(w)
        for k in range(len(w) - least + 1):
            if r[0] is not None and first[tuple(w[k : k + least])] < r[0]:
                keep[k : k + least] = [False] * least
        text = " ".join(x for x, y in zip(w, keep) if y)
        out.append((str(r[0]), len(w), len(w) - sum(keep), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("least,seed", [(50, 3), (12, 4)])
def test_removed_words_match_brute_force(spark, least, seed):
    rows = corpus(seed, 90)
    rows += [(200, (rows[3][1] or "") + "\t" + (rows[9][1] or ""), "en", "s"), (201, "  ".join(words(rows[3][1])), "en", "s"), (202, "q " * 400, "en", "s"), (203, "q " * 300 + "r " * 100, "en", "s")]
    got = duplicate_spans(docs_of(spark, rows), least=least).withColumn("n", removed_words()).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n, r.kept_sha256) for r in got) == brute(rows, least)


def test_empty_table(spark):
    assert duplicate_spans(docs_of(spark, [])).count() == 0


def test_factors_follow_one_reference_and_cover_all_windows():
    rng = random.Random(2)
    for _ in range(200):
        starts = sorted(rng.sample(range(80), rng.randint(1, 40)))
        ref, at, r, p = [], [], 0, 0
        for _ in starts:
            if rng.random() < 0.3:
                r, p = rng.randint(0, 2), rng.randint(0, 50)
            ref.append(r)
            at.append(p)
            p += 1
        found = greedy_factors(np.array(starts), np.array(ref), np.array(at), 10)
        covered = {k for a, n, *_ in found for k in range(a, a + n)}
        assert covered == {k for s in starts for k in range(s, s + 10)}
        places = {s: (r, p) for s, r, p in zip(starts, ref, at)}
        for a, n, r, p in found:  # every window of a factor stands at its place in the reference
            assert n >= 10 and all(places[a + k] == (r, p + k) for k in range(n - 9))


def test_a_factor_that_is_not_its_reference_is_none():
    w, other = [b"a"] * 30, [b"a"] * 12 + [b"x"] + [b"a"] * 17
    assert matched(w, (0, 30), [b"a"] * 30, 10) == [(0, 30)]
    assert matched(w, (0, 30), other, 10) == [(0, 12), (13, 30)]
    assert matched(w, (0, 30), other, 15) == [(13, 30)] and matched(w, (0, 30), [], 10) == []
    assert joined([(5, 9), (0, 5), (20, 30), (21, 25)]) == [(0, 9), (20, 30)]


def test_references_of_many_blocks_and_texts_of_repeats(spark):
    rng = random.Random(7)
    long = [f"w{rng.randint(0, 400)}" for _ in range(3000)]
    rows = [(i, t, "en", "s") for i, t in enumerate([
        " ".join(long), " ".join(long[700:2500]), " ".join([*long[100:900], "new", *long[2000:2950]]), " ".join((long[:130] * 9)[:1000]), " ".join(long[50:180] * 3),
        " ".join([*long[:63], *long[64:200]]), " ".join(long[63:128]), " ".join(["a b c d e f g"] * 60), " ".join(["b c d e f g a"] * 40), " ".join(["a"] * 500), " ".join(["a"] * 120 + ["b"] + ["a"] * 49),
    ])]
    got = duplicate_spans(docs_of(spark, rows)).withColumn("n", removed_words()).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n, r.kept_sha256) for r in got) == brute(rows, 50)
