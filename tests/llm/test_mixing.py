import random

from pyspark.sql import functions as F

from tessera.llm.mixing import Flow, mix, mixed_rows, targets
from tests.llm.helpers import corpus, docs_of, words


def test_targets_fill_and_stop_at_twice_the_size():
    sizes = {"a": 100, "b": 1000, "c": 50, None: 10}
    got = targets(sizes)
    assert abs(sum(got.values()) - 1.5 * 1160) < 1e-6
    assert all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert got["a"] == 200 and got[None] == 20  # weights 3, 1, 2, 3: b has the least
    free = [s for s in sizes if got[s] < 2 * sizes[s] - 1e-9]
    w = {"a": 3, "b": 1, "c": 2, None: 3}
    assert len({round(got[s] / w[s], 6) for s in free}) <= 1
    assert targets({}) == {} and targets({"x": 0}) == {"x": 0.0}


def brute(sizes, quotas, uses):
    """Largest flow by trying the cheapest whole word at a time (small cases)."""
    best = Flow(sizes, quotas, uses).solve().routed
    taken = {p: sum(best[p].values()) for p in sizes}
    filled = {s: sum(f.get(s, 0) for f in best.values()) for s in quotas}
    return taken, filled


def test_flow_is_largest_and_spreads_uses():
    rng = random.Random(1)
    for _ in range(60):
        names = ["a", "b", "c"]
        patterns = [("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")]
        sizes = {p: rng.randint(0, 6) for p in patterns}
        quotas = {s: rng.randint(0, 9) for s in names}
        taken, filled = brute(sizes, quotas, 2)
        assert all(taken[p] <= 2 * sizes[p] for p in sizes) and all(filled[s] <= quotas[s] for s in names)
        # max-flow min-cut over all sets of sources
        cut = min(
            sum(quotas[s] for s in names if not k >> names.index(s) & 1) + sum(2 * sizes[p] for p in patterns if any(k >> names.index(s) & 1 for s in p))
            for k in range(8)
        )
        assert sum(filled.values()) == cut
        # the first use of all patterns is as large as a flow without second uses
        once = sum(Flow(sizes, quotas, 1).solve().routed[p][s] for p in patterns for s in p)
        assert sum(min(taken[p], sizes[p]) for p in patterns) == once


def test_mix_keeps_to_targets_and_reruns_agree(spark):
    rows = [r for r in corpus() if r[0] != 64]
    docs = docs_of(spark, rows)
    run = lambda d: sorted((str(r.doc_id), r.size, r.taken, r.targets[0], r.source_sizes[0]) for r in mix(d, F.array("source")).collect())
    got = run(docs)
    assert got == run(docs.repartition(7))
    assert len(got) == len(rows)
    by = {}
    for r in mix(docs, F.array("source")).collect():
        assert r.taken == r.size * r.uses <= 2 * r.size
        t = by.setdefault(r.sources[0], [r.targets[0], 0])
        t[1] += r.taken
    assert all(abs(taken - wanted) <= 200 for wanted, taken in by.values())
    sizes = sorted((str(r[0]), len(words(r[1]))) for r in rows)
    assert sizes == sorted((i, s) for i, s, *_ in got)


def test_rows_come_as_often_as_used_and_empty_tables_give_none(spark):
    docs = docs_of(spark, corpus())
    key = lambda i, text: (i, len(words(text)))
    used, seen = {}, {}
    for r in mix(docs, F.array("source")).collect():
        used[r.doc_id, r.size] = used.get((r.doc_id, r.size), 0) + r.uses
    out = mixed_rows(docs, F.array("source"))
    assert out.columns == docs.columns
    for r in out.collect():
        seen[key(r.doc_id, r.text)] = seen.get(key(r.doc_id, r.text), 0) + 1
    assert seen == {k: n for k, n in used.items() if n}
    assert mix(docs_of(spark, []), F.array("source")).count() == 0
    assert mixed_rows(docs_of(spark, []), F.array("source")).count() == 0


def test_equal_rows_come_within_one_row_of_the_target(spark):
    for ids in ([None] * 201, [5] * 201):
        docs = docs_of(spark, [(i, "a b c", "en", "x") for i in ids] + [(i, "other words here now", "en", "y") for i in range(100)])
        got = mix(docs, F.array("source")).collect()
        for source in "xy":
            own = [r for r in got if r.sources == [source]]
            assert abs(sum(r.taken for r in own) - own[0].targets[0]) <= 4
        out = mixed_rows(docs, F.array("source")).groupBy("source").count().collect()
        assert {r["source"]: r["count"] for r in out} == {s: sum(r.uses for r in got if r.sources == [s]) for s in "xy"}


def test_unlike_texts_under_one_id_go_their_own_way(spark):
    docs = docs_of(spark, [(1, f"text {i} " + "w " * (i % 7), "en", "x") for i in range(60)] + [(2, "z " * 500, "en", "y")])
    uses = {}
    for r in mixed_rows(docs, F.array("source")).collect():
        uses[r.text] = uses.get(r.text, 0) + 1
    again = {}
    for r in mixed_rows(docs.repartition(5), F.array("source")).collect():
        again[r.text] = again.get(r.text, 0) + 1
    assert uses == again


def test_null_and_empty_arrays_belong_to_no_source(spark):
    docs = docs_of(spark, [(i, "w " * 5, "en", "a") for i in range(10)] + [(10, "w w", "en", None), (11, "w w", "en", "none")])
    arrays = F.when(F.col("doc_id") == 10, F.lit(None)).when(F.col("doc_id") == 11, F.array().cast("array<string>")).otherwise(F.array("source"))
    got = {r.doc_id: r for r in mix(docs, arrays).collect()}
    assert len(got) == 12 and got[10].uses == got[11].uses == 0 and got[10].sources == []
    assert sum(r.taken for r in got.values()) == 75


def test_overlapping_sources(spark):
    docs = docs_of(spark, [(i, "w " * 30, "en", "ab"[i % 2]) for i in range(40)])
    both = F.when(F.col("doc_id") < 20, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source"))
    got = mix(docs, both).collect()
    assert abs(sum(r.taken for r in got) - 1.5 * sum(r.size for r in got) * 1.5) < 2000
    assert all(r.uses <= 2 for r in got)
