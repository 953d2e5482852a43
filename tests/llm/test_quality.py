import re
from collections import Counter

import numpy as np

from tessera.llm.boosting import fit
from tessera.llm.quality import FEATURES, keep_good, quality_rules, statistics
from tests.llm.helpers import corpus, docs_of, words


def base(text):
    text = text or ""
    w = words(text)
    c, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_base_counts_match_brute_force():
    texts = [None, "", " ", "a", "a b", "a a a a", "a b c a b c a", "x\nx\n \n \nx \nx", "#*$%&|<> a|b\n#", "Ünï çödé x\x1cy z", "a b c d\ta b c\nd e f"]
    for t in [*texts, *[r[1] for r in corpus()]]:
        assert statistics(t)[:5] == base(t), t
        assert np.isfinite(statistics(t)).all()


def test_trees_learn_and_keep_to_their_signs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.3)).astype(float)
    sign = np.array([-1, 1, 0])
    forest = fit(x, y, sign)
    fresh = rng.random((1000, 3))
    want = (fresh[:, 0] < 0.5) & (fresh[:, 1] > 0.3)
    assert ((forest.probability(fresh) > 0.5) == want).mean() > 0.97
    for f, s in ((0, -1), (1, 1)):
        line = np.repeat(fresh[:50], 40, axis=0)
        line[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        step = np.diff(forest.margin(line).reshape(50, 40), axis=1)
        assert (s * step >= -1e-9).all()


def walked(forest, row):
    """The margin of one row, node by node."""
    total = forest.base
    for root in forest.roots:
        at = root
        while forest.left[at] != at or forest.right[at] != at:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        total += forest.value[at]
    return total


def test_flat_arrays_score_as_a_walk_through_the_trees():
    rng = np.random.default_rng(1)
    x = rng.random((800, 4))
    forest = fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), np.array([1, 0, 0, -1]))
    fresh = np.concatenate([rng.random((200, 4)), x[:50]])
    assert np.allclose(forest.margin(fresh), [walked(forest, r) for r in fresh])


def judged(spark):
    good = [(i, r[1], "en", "s") for i, r in enumerate(corpus(5, 60)) if r[1] and len(set(words(r[1]))) > 60]
    good = [(i, r[1], "en", "s") for i, r in enumerate(good)]
    junk = [(1000 + i, r[1].replace(" ", "*** "), "en", "s") for i, r in enumerate(good)]
    rows = [*good, *junk, (5000, None, None, None), (None, good[0][1], "en", "s"), good[0], (5001, "a " * 300, "en", "s")]
    labels = spark.createDataFrame([*((r[0], 1, None) for r in good), *((r[0], 0, 1) for r in junk), (None, 1, 0), (7777, 0, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    return rows, labels, docs_of(spark, rows)


def test_verdicts(spark):
    rows, labels, docs = judged(spark)
    got = quality_rules(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        junk = r.doc_id is not None and r.doc_id >= 1000
        assert r.kept != junk, r
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_without_labels_the_base_rules_decide(spark):
    rows, labels, docs = judged(spark)
    got = quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.score is None for r in got)
    assert quality_rules(docs_of(spark, []), labels).count() == 0
    assert len(FEATURES) == len(statistics("x")) - 5
