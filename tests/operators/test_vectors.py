import numpy as np

from tessera.operators import vectors
from tessera.operators import vectors as vectors_module
from tessera.operators.vectors import caps, centres_of, may_be_near, resolve_names, similar
from tessera.session import written


def clustered(rng, n, width=16, clusters=12, spread=0.05):
    heads = rng.normal(size=(clusters, width))
    return heads[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, width))


def plain(q, c, threshold):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    d = np.round(1 - unit(q) @ unit(c).T, 6)
    return {(int(i), int(j)): float(d[i, j]) for i, j in zip(*np.nonzero(d < threshold))}


def frames(spark, q, c):
    rows = lambda m, extra: [(i, [float(x) for x in v]) for i, v in enumerate(m)] + extra
    odd = [(100_000, None), (100_001, [0.0] * q.shape[1]), (100_002, [0.0] * q.shape[1])]
    return spark.createDataFrame(rows(q, odd), "query_id long, intention_vector array<double>"), spark.createDataFrame(rows(c, odd), "doc_id long, vector array<double>")


def test_bounds_never_hide_a_near_pair():
    rng = np.random.default_rng(3)
    for spread in (0.02, 0.3, 2.0):
        a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (clustered(rng, 300, spread=spread), clustered(rng, 400, spread=spread)))
        centres = centres_of(a, 20)
        x, y = caps(a, centres), caps(b, centres)
        for threshold in (0.01, 0.3, 0.9):
            near = may_be_near(x, y, threshold)
            part = lambda p, n: np.repeat(np.arange(len(p[1])), np.diff(np.append(p[1], n)))[np.argsort(p[0])]
            i, j = np.nonzero(1 - a @ b.T < threshold)
            assert near[part(x, len(a))[i], part(y, len(b))[j]].all()


def test_pruned_rows_are_all_rows_and_far_parts_are_left_out(spark, monkeypatch):
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(12, 16))
    draw = lambda n: heads[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, 16))
    q, c = draw(60), draw(900)
    asked, corpus = frames(spark, q, c)
    for block in (4 << 20, 16 * 8 * 50):  # one block, and many on both sides
        monkeypatch.setattr(vectors, "BLOCK_BYTES", block)
        every, skipped = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        got = {(r.query_id, r.doc_id): r.distance for r in similar(asked, corpus, 0.2, counted=(every, skipped)).collect()}
        want = plain(q, c, 0.2)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
        assert skipped.value > 0.7 * every.value > 0


def test_vectors_all_around_lose_nothing(spark):
    rng = np.random.default_rng(6)
    q, c = rng.normal(size=(40, 8)), rng.normal(size=(500, 8))
    asked, corpus = frames(spark, q, c)
    got = {(r.query_id, r.doc_id) for r in similar(asked, corpus, 0.6).collect()}
    assert got == plain(q, c, 0.6).keys()
    assert similar(asked.limit(0), corpus, 0.6).count() == 0 and similar(asked, corpus.limit(0), 0.6).count() == 0


def test_names_resolve_as_brute_force_and_hits_are_not_written(spark, monkeypatch):
    rng = np.random.default_rng(5)
    cells = lambda n: [[float(x) for x in v] for v in rng.normal(size=(n, 4))]
    names = [(f"n{i}", v) for i, v in enumerate(cells(25))] + [("void", None), ("zero", [0.0] * 4), (" ", [1.0] * 4)]
    keys = [(f"k{i % 70}" if i % 3 else "often", v) for i, v in enumerate(cells(150))] + [("null", None), ("zero", [0.0] * 4)] + [(f"t{i:02}", [1.0, 2.0, 3.0, 4.0]) for i in range(40)]
    said = [(f"k{i % 90}" if i % 4 else "often", v) for i, v in enumerate(cells(120))]
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} string, vector array<double>")

    def near(v, w):
        a, b = np.linalg.norm(v), np.linalg.norm(w)
        return round(1 - float(np.dot(v, w)) / (a * b), 6) if a and b else None

    for block, threshold, least in ((4 << 20, 0.05, 4), (32 * 8, 0.05, 4), (32 * 8, 0.4, 60), (4 << 20, 3.0, 2)):
        rows = {}

        def counted(df, name, rows=rows):
            out = written(df, name)
            rows[name] = out.count()
            return out

        monkeypatch.setattr(vectors_module, "BLOCK_BYTES", block)
        monkeypatch.setattr(vectors_module, "written", counted)
        want = set()
        for n, v in names:
            if not n.strip():
                continue
            by_name, hits = {}, set()
            for k, w in keys:
                if v and w and (d := near(v, w)) is not None:
                    by_name[k] = min(d, by_name.get(k, 9))
            hits = {k for k, d in by_name.items() if d < threshold} | {k for k, w in said if v and near(v, w) is not None and near(v, w) < threshold}
            rest = sorted((d, k) for k, d in by_name.items() if k not in hits)[: max(0, least - len(hits))]
            want |= {(n, k) for k in hits | {k for _, k in rest} or {n}}
        got = [tuple(r) for r in resolve_names(frame(names, "name"), frame(keys, "key"), frame(said, "key"), threshold, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        if threshold == 3.0:
            assert max(rows.values()) < 200 < len(want)
