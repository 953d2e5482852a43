import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.runs import common_prefix, found_runs, lyndon_roots, periodic_runs, runs_of, strongest
from tests.llm.helpers import corpus, docs_of, words


def brute_runs(w, min_words=24, min_exponent=3):
    """Every stretch that a period holds in and no neighbour extends, at its smallest period."""
    found = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= 2 * q:
                found.setdefault((i, j + q - i), q)  # smaller periods come first
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items() if n >= max(min_words, min_exponent * q)), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def best(runs):
    return min(runs, key=lambda r: (-r[1] * 10**12 // r[2], r[0], r[2])) if runs else None


def lyndon_array(s):
    """The longest Lyndon word from each place: up to the next smaller suffix."""
    return [next((j - i for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s) - i) for i in range(len(s))]


def texts():
    rng = random.Random(5)
    out = []
    for k in range(160):
        abc = "abcdefghij"[: rng.choice([1, 2, 3, 10])]
        w = [rng.choice(abc) for _ in range(rng.choice([0, 5, 30, 80, 150]))]
        for _ in range(rng.randrange(4)):
            block = [rng.choice(abc) for _ in range(rng.choice([1, 2, 5, 9, 20]))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = block * rng.randrange(2, 9) + block[: rng.randrange(len(block) + 1)]
        out.append(" ".join(w))
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a  # Fibonacci words hold very many runs
    return [*out, " ".join(b), " ".join(["x"] * 500), " ".join(("p q r " * 60 + "s ") * 5), "", " \n\t ", None]


def test_groups_give_the_lyndon_array():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(1, 40))]
        array = lyndon_array(s)
        want = set()
        for i, n in enumerate(array):
            first = i < n or s[i - n : i] != s[i : i + n] or array[i - n] != n
            times = 1
            while i + times * n < len(s) and array[i + times * n] == n and s[i + times * n : i + (times + 1) * n] == s[i : i + n]:
                times += 1
            if first and times > 1:
                want.add((i, n, times))
        assert set(lyndon_roots(s)) == want


def test_common_prefix():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(30)]
        a = rng.randrange(29)
        b = rng.randrange(a + 1, 31)
        want = 0
        while b + want < 30 and s[a + want] == s[b + want]:
            want += 1
        assert common_prefix(s, a, b) == want


def test_runs_equal_brute_force():
    every = texts()
    for least, exponent in ((24, 3), (1, 3), (7, 4)):
        for text, (n, runs, left) in zip(every, found_runs(every, least, exponent)):
            w = words(text)
            assert n == len(w)
            assert runs == brute_runs(w, least, exponent)
            assert left == collapsed(w, runs)


def test_any_symbols():
    rng = random.Random(3)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(60))]
        assert runs_of(s, 3, 3) == brute_runs(s, 3, 3)


def test_odd_rows(spark):
    rows = [*corpus(), (None, "z " * 40, None, None), (700, "é ü " * 30, "de", None)]
    got = sorted(((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs_of(spark, rows)).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        w = words(text)
        runs = brute_runs(w) if len(w) < 2000 else []
        want.append((str(i), len(w), runs, collapsed(w, runs)))
    assert got == sorted(want, key=str)
    assert periodic_runs(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs_of(spark, []), min_exponent=2)


def test_a_very_long_text(spark):
    rng = random.Random(9)
    block = [str(rng.randrange(10**6)) for _ in range(30_000)]
    w = ["lead"] + block * 4 + ["end"]
    (row,) = periodic_runs(docs_of(spark, [(1, " ".join(w), None, None)])).collect()
    assert [tuple(r) for r in row.runs] == [(1, 120_000, 30_000)] and row.collapsed == " ".join(["lead", *block, "end"])


def test_strongest(spark):
    kind = "array<struct<start:long,length:long,period:long>>"
    cases = [([(5, 30, 10), (9, 90, 30), (2, 31, 10)], (2, 31, 10)), ([(5, 30, 10), (4, 90, 30)], (4, 90, 30)), ([(5, 30, 10), (5, 90, 30)], (5, 30, 10)), ([], None)]
    got = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], f"k int, r {kind}").select("k", strongest(F.col("r")).alias("b")).collect()
    for r in got:
        assert (tuple(r.b) if r.b else None) == cases[r.k][1]


def test_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = words(r.text)
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute_runs(w)
        b = best(runs)
        want.append((r.doc_id, len(runs), *(b or (None, None, None)), 1000 * b[1] // b[2] if b else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(collapsed(w, runs))))
    got = queries.op12_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(w[1] for w in want) > 10
