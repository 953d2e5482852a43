import re

import corpus_pipeline
import duckdb
import numpy as np
from tessera.llm.decontaminate import contamination
from tessera.llm.oracles import MIX
from tests.llm.helpers import words
from tests.llm.test_decontaminate import brute as hit_by
from tests.llm.test_sharding import plain as sharded
from tests.llm.test_simhash import components

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_effect_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        rows = docs.collect()
        assert rows and all(before[r.doc_id] == r.text for r in rows)
        if "quality" in name:
            good = {r.doc_id for r in rows}
            assert all(len(words(before[i])) >= 50 for i in good) and 0 < len(good) < len(before)
        elif "dedup" in name:
            assert len({r.text for r in rows}) == len(rows)
            assert {before[i] for i in good} >= {r.text for r in rows}
        elif "decontamination" in name:
            assert contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("n_hit > 0").isEmpty()
        elif "mixing" in name:
            n = len({r.doc_id for r in rows})
            assert len(rows) <= 2 * n
            left = len(rows)
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) == left
    shards = {}
    for r in out:
        shards.setdefault(r.shard, []).append(r)
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in shards.values())
    assert max(shards) < 40 and re.fullmatch(r"\d+", str(out[0].text_crc32))


def shingle_table(texts):
    """For each text the numbers of its distinct five-word shingles."""
    known = {}
    out = []
    for t in texts:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({known.setdefault(tuple(w[i : i + 5]), len(known)) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_rows_match_a_plain_pipeline(spark):
    """Stages 2 to 5 by brute force, from what the quality rules keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, SF).toPandas()
    texts = good["text"].tolist()
    sets = shingle_table(texts)
    of = {}
    for i, s in enumerate(sets):
        for x in s:
            of.setdefault(x, []).append(i)
    shared = np.zeros((len(sets), len(sets)), int)
    for rows in of.values():
        shared[np.ix_(rows, rows)] += 1
    n = shared.diagonal()
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(shared, 1))) if shared[i, j] >= 0.8 * (n[i] + n[j] - shared[i, j])]
    by_id = np.argsort(good["doc_id"].to_numpy(), kind="stable")
    place = np.argsort(by_id)
    root = components(range(len(sets)), [(int(place[a]), int(place[b])) for a, b in links])
    good = good.iloc[[by_id[i] for i in range(len(sets)) if root[i] == i]]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, _, hit, *_ in hit_by(list(zip(good["doc_id"], good["text"])), bench) if hit}
    good = good[~good["doc_id"].astype(str).isin(bad)]
    con = duckdb.connect()
    con.register("documents", good)
    uses = {i: taken // size for i, size, taken in con.execute(f"select doc_id, size, taken from ({MIX})").fetchall() if size}
    mixed = [(r.doc_id, r.text) for r in good.itertuples() for _ in range(uses.get(r.doc_id, 0))]
    got = sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in corpus_pipeline.run(spark, SF).collect())
    assert len(mixed) > 50 and got == sharded(mixed, 40)
