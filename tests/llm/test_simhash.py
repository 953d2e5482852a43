import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.components import connected_components
from tessera.llm.shingles import all_shared, shared_counts, shingle_hashes
from tessera.llm.simhash import fingerprint, index_positions, keep_one, near_duplicates, tallied_pairs
from tessera.llm.substring import word_hashes
from tests.llm.helpers import corpus, docs_of, words


def plain(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, links):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_fingerprint_is_that_of_the_definition():
    for text in (None, "", "One", "one two", "A b c d e f A b c", "Ä ä ö Z\tz q   x y", "w " * 500):
        assert fingerprint(text) == plain(text)


@pytest.mark.parametrize("bits", range(8))
def test_close_fingerprints_share_an_index_key(bits):
    from itertools import combinations

    sets = index_positions(bits)
    for bad in combinations(range(8), bits):  # the bytes that differ
        assert any(not set(s) & set(bad) for s in sets)


def test_groups_match_brute_force(spark):
    rows = corpus()
    got = {(r.doc_id, r.fingerprint % 2**64): r.component_id for r in near_duplicates(docs_of(spark, rows)).collect()}
    fps = {}
    for r in rows:
        fps.setdefault(plain(r[1]), []).append(r[0])
    keys = list(fps)
    links = [(a, b) for a in keys for b in keys if a < b and bin(a ^ b).count("1") <= 3]
    root = components(keys, links)
    for f, ids in fps.items():
        least = min(i for k in keys if root[k] == root[f] for i in fps[k] if i is not None)
        for i in ids:
            assert got[i, f] == least
    assert near_duplicates(docs_of(spark, rows)).count() == len(rows)


def test_keep_one_keeps_one_of_each_group_and_all_columns(spark):
    rows = corpus()
    docs = docs_of(spark, rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    texts = Counter(r.text for r in kept.collect())
    assert max(texts.values()) == 1
    assert set(t for t in texts if t and len(set(t.split())) > 30) <= {r[1] for r in rows}
    assert {r.doc_id for r in kept.collect()} >= {0, 3}


def test_empty_table(spark):
    assert near_duplicates(docs_of(spark, [])).count() == 0
    assert keep_one(docs_of(spark, [])).count() == 0


def test_long_paths_are_one_component(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (5, 5)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(101, 161), 100), 7: 3}


def _alike_sets(text):
    w = words((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_false_links_do_not_hide_true_ones(spark):
    # A has the words of B and B' in another order: equal fingerprints of words, hardly a shingle shared
    rng = random.Random(5)
    rows = []
    for g in range(6):
        b = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120)]
        near = [*b[:3], "changed", *b[3:]] if g % 2 else [*b, b[0]]
        for k, w in enumerate((sorted(b), sorted(b, reverse=True), b, near, b[::-1])):
            rows.append((10 * g + k, " ".join(w), "en", "s"))
    rng.shuffle(rows)
    kept = {r.doc_id for r in keep_one(docs_of(spark, rows)).collect()}
    assert kept == {r[0] for r in rows if r[0] % 10 != 3}


def shingles(text):
    return shingle_hashes(word_hashes([w.lower() for w in text.encode().split()]))


def test_shared_shingles_are_counted_exactly():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.choice([0, 3, 40, 200]))) for _ in range(50)]
    sets = [_alike_sets(t) if t else set() for t in texts]
    hashes = [shingles(t) for t in texts]
    got = all_shared(hashes)
    assert got.tolist() == [[len(a & b) if i != j else got[i, i] for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    for few in (3, 45):
        x, y = (a.ravel() for a in np.meshgrid(range(few), range(few, 50), indexing="ij"))
        assert shared_counts(hashes, x, y).tolist() == got[x, y].tolist()


@pytest.mark.parametrize("bits", [0, 1, 3, 5, 7])
def test_tallies_find_the_pairs_with_enough_shared_bytes(bits):
    rng = np.random.default_rng(bits)
    sets = index_positions(bits)
    fp = rng.integers(0, 3, (120, 8)).astype(np.uint8)
    of, known = rng.integers(0, 4, 120), np.zeros((120, 8), bool)
    for i in range(120):  # rows of a list share the bytes of its key
        positions = list(sets[of[i] % len(sets)])
        known[i, positions] = True
        fp[i, positions] = 9
    x, y = tallied_pairs(fp.reshape(-1).view("<u8"), of, known, 8 - bits)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if of[i] == of[j] and (fp[i] == fp[j]).sum() >= 8 - bits}
    assert set(zip(x.tolist(), y.tolist())) == want and len(x) == len(want)


def test_lists_of_many_blocks_lose_no_link(spark, monkeypatch):
    # workers are forked with the module as it is, so the small blocks are those of the driver's plan alone
    monkeypatch.setattr(simhash, "BLOCK", 3)
    monkeypatch.setattr(simhash, "CROWD", 1)
    test_groups_match_brute_force(spark)
    test_near_copies_match_brute_force(spark)


def alike(a, b):
    a, b = _alike_sets(a), _alike_sets(b)
    return len(a & b) >= 0.8 * len(a | b)


def test_near_copies_match_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for g in range(12):
        w = [word() for _ in range(rng.choice([30, 100, 160]))]
        rows.append(" ".join(w))
        for _ in range(rng.choice([1, 2, 9, 25])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                v[rng.randrange(len(v))] = word()
            rows.append(" ".join(v))
            w = v if rng.random() < 0.3 else w
    rows += ["", " ", "one two", "one two three", "One  two"]
    rng.shuffle(rows)
    root = components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if words(rows[i]) and words(rows[j]) and alike(rows[i], rows[j])])
    empty = [i for i, t in enumerate(rows) if not words(t)]
    want = {i for i in range(len(rows)) if root[i] == i and i not in empty} | {min(empty)}
    kept = {r.doc_id for r in keep_one(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect()}
    assert kept == want


def test_similarity_of_links_is_exact(spark):
    # 121 words have 117 shingles: 13 changed ones leave 104 of 130, which is 0.8, and 14 leave 103 of 131
    rng = random.Random(7)
    rows = []
    for g in range(24):
        w = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(121)]
        near = list(w)
        for at in (40, 80, 2, *([120] if g % 2 else [])):
            near[at] = "changed"
        rows += [(2 * g, " ".join(w), "en", "s"), (2 * g + 1, " ".join(near), "en", "s")]
    kept = {r.doc_id for r in keep_one(docs_of(spark, rows)).collect()}
    assert kept == {i for i in range(48) if i % 4 != 1}


def test_rows_are_told_apart_by_id_and_text(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(5))
    near = c + " more"
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (None, near), (5, d), (3, d), (5, e), (7, "x " + e), (7, "y"), (7, "y"), (8, "z"), (8, "z z")]
    kept = Counter((r.doc_id, r.text) for r in keep_one(docs_of(spark, [(*r, "en", "s") for r in rows])).collect())
    assert len({c, near} & {t for i, t in kept if i is None}) == 1
    assert {k: n for k, n in kept.items() if k[1] not in (c, near)} == dict.fromkeys([(1, a), (None, b), (3, d), (5, e), (7, "y"), (8, "z"), (8, "z z")], 1)


def test_rarest_shingles_bring_all_similar_pairs_together(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VERIFIED", 40)
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for g in range(4):
        template = [word() for _ in range(60)]
        for _ in range(30):
            own = [word() for _ in range(rng.choice([0, 2, 5, 8, 12, 20]))]
            rows.append((len(rows), len(rows) if rng.random() < 0.8 else 1000 + g, g, " ".join([*template, *own])))
    rows += [(len(rows), 5000, 0, ""), (len(rows) + 1, 5001, 0, "one two"), (len(rows) + 2, 5002, 0, "One two")]
    for verify in (0.8, 0.6):
        want = set()
        for i, a, g, s in rows:
            for j, b, h, t in rows:
                x, y = _alike_sets(s), _alike_sets(t)
                if a < b and g == h and words(s) and words(t) and len(x & y) >= verify * len(x | y) - 1e-9:
                    want.add((a, b))
        members = spark.createDataFrame([r[:3] for r in rows], "node long, label long, group long")
        texts = spark.createDataFrame([(r[0], r[3]) for r in rows], "node long, text string")
        got = {(r.a, r.b) for r in simhash.prefix_links(members, texts, verify).collect()}
        labels = {r[1] for r in rows}
        assert components(labels, got) == components(labels, want)


def test_of_rows_equal_in_id_and_text_the_first_stays(spark):
    rows = [(1, "a b c", k, None if k % 2 else "x") for k in (7, 3, 5, 4)] + [(2, "d e", 1, None)]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, n int, other string").repartition(parts)
        assert sorted(map(tuple, keep_one(docs).collect()), key=str) == [(1, "a b c", 3, None), (2, "d e", 1, None)]
