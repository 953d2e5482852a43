import re

from tessera.llm.decontaminate import clean, contamination, hits, without_spans
from tests.llm.helpers import corpus, docs_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def brute(rows, items, n=10):
    windows = {}
    for i, t in items:
        w = TERM.findall(low(t))
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add("null" if i is None else str(i))
    out = []
    for r in rows:
        w, hit, found = TERM.findall(low(r[1])), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if (s := windows.get(tuple(w[a : a + k]))) is not None:
                    hit |= set(range(a, a + k))
                    found |= s
        out.append((str(r[0]), len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out)


def case(spark):
    rows = [r for r in corpus() if r[0] != 64]
    long = next(r[1] for r in rows if r[1] and len(set(r[1].split())) > 50)
    rows += [(100, "x Ünder, OVER-the  " + long.upper(), "en", "s"), (101, "over the", "en", "s"), (102, "Over; the.over THE", "en", "s")]
    items = [(1, " ".join(long.split()[5:30])), (2, "over the"), (3, None), (4, "..."), (None, " ".join(long.split()[20:45])), (11, " ".join(long.split()[6:29])), (2, "over the")]
    return rows, items, spark.createDataFrame(items, "item_id long, text string")


def test_contamination_matches_brute_force(spark):
    rows, items, bench = case(spark)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in contamination(docs_of(spark, rows), bench).collect())
    assert got == brute(rows, items)


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    from tessera.llm import decontaminate

    rows, items, bench = case(spark)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in contamination(docs_of(spark, rows), bench).collect())
    assert got == brute(rows, items)


def test_clean_drops_documents_and_spans(spark):
    rows, items, bench = case(spark)
    docs = docs_of(spark, rows)
    bad = {i for i, _, hit, *_ in brute(rows, items) if hit}
    kept = clean(docs, bench)
    assert kept.columns == docs.columns
    assert {str(r.doc_id) for r in kept.collect()} == {str(r[0]) for r in rows} - bad
    cut = {str(r.doc_id): r.text for r in without_spans(docs, bench).collect()}
    assert cut["101"] == "" and cut["102"] == ""
    assert all(cut[str(r[0])] == r[1] for r in rows if str(r[0]) not in bad)
    assert sorted(cut) == sorted({str(r[0]) for r in rows})


def test_clean_tells_rows_apart_by_id_and_text(spark):
    _, _, bench = case(spark)
    rows = [(i, t, "en", "s") for i in (None, 8) for t in ("well over the top", "clean", None)]
    kept = [(r.doc_id, r.text) for r in clean(docs_of(spark, rows), bench).collect()]
    assert sorted(kept, key=str) == sorted([(i, t) for i in (None, 8) for t in ("clean", None)], key=str)
    assert len(clean(docs_of(spark, rows), bench, max_hit_share=0.5).collect()) == 6


def test_empty_tables(spark):
    rows, _, bench = case(spark)
    docs = docs_of(spark, rows)
    assert contamination(docs_of(spark, []), bench).count() == 0
    none = contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.n_hit for r in none)
    assert hits(docs, bench.limit(0)).count() == 0


def test_null_items_and_clashing_columns(spark):
    bench = spark.createDataFrame([("null", "one two three"), (None, "one two three"), ("b", "four five")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "one two three four five", "a", 1, 2), (1, "one two three four five", "b", 3, 4), (None, None, "c", 5, 6)], "doc_id long, text string, __spans string, __hash int, `a.b` int")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in contamination(docs, bench).collect())
    assert got == [("1", 5, 5, 3, "b,null,null"), ("1", 5, 5, 3, "b,null,null"), ("None", 0, 0, 0, "")]
    cut = without_spans(docs, bench)
    assert cut.columns == docs.columns and sorted((r.text or "", r["__spans"], r["a.b"]) for r in cut.collect()) == [("", "a", 2), ("", "b", 4), ("", "c", 6)]
