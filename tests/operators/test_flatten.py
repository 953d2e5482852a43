import json
import random

from tessera.operators.flatten import WRAPPERS, flatten_json


def flat(spark, *texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, raw string, key string, doc string")
    return sorted((r.doc_id, r.key, r.value, r.unit) for r in flatten_json(df, "doc_id", "raw").collect())


def grown(rng, key, left):
    """A random value to stand under `key`, and the leaves it must give."""
    kind = rng.choice(["text", "number", "flag", "null", "pair", "named"] + ["list", "object"] * left)
    if kind == "text":
        t = rng.choice(["a", " b c ", 'q"[{', "\\]}", "é"])
        return t, [(key, t.strip(), None)]
    if kind == "number":
        n = rng.choice([0, -5, 10**12, 1.5, -0.25, 1e-7])
        return n, [(key, str(n), None)]
    if kind == "flag":
        return True, [(key, "True", None)]
    if kind == "null":
        return None, []
    if kind == "pair":
        value, unit = rng.choice([("v", "u"), ("value", "unit")])
        return {value: 7, unit: "mm", "more": {"deep": [1]}}, [(key, "7", "mm")]
    if kind == "named":
        return {"name": "gap", "value": "w", "units": None}, [(f"{key}.gap", "w", None)]
    if kind == "list":
        parts = [grown(rng, key, left - 1) for _ in range(rng.randrange(4))]
        return [p for p, _ in parts], [x for _, found in parts for x in found]
    out, found = {}, []
    for k in rng.sample(["a", "b", "c d", *WRAPPERS], rng.randrange(4)):
        out[k], more = grown(rng, key if k in WRAPPERS else f"{key}.{k}", left - 1)
        found += more
    return out, found


def test_random_nests(spark):
    rng = random.Random(12)
    texts, want = [], []
    for i in range(200):
        value, found = grown(rng, "top", 5)
        texts.append(json.dumps({"top": value}, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
        want += [(i, k, v, u) for k, v, u in found if v is not None]
    order = lambda rows: sorted(rows, key=lambda r: (*r[:3], r[3] or ""))
    assert order(flat(spark, *texts)) == order(want)


def test_numbers_are_printed_alike(spark):
    rng = random.Random(13)
    said = ["0", "-0", "7", "1.0", "1.50", "1e5", "1E-7", "1e16", "1e15", "123456789.125", "0.0001", "0.00012", "0.00001", "-2.5e-10", "1e100", "-1.25e-120", "12345678901234567890", "1234567.0", "12345678.9", "100000000000000.5", "1e22", "1e400"]
    said += [repr(rng.uniform(-1, 1) * 10.0 ** rng.randrange(-20, 25)) for _ in range(200)]
    got = {i: v for i, _, v, _ in flat(spark, *[f'{{"n": {s}}}' for s in said])}
    assert got == {i: str(json.loads(s)) for i, s in enumerate(said)}


def test_what_does_not_parse_and_deep_nests(spark):
    assert flat(spark, "[" * 900 + '{"a": 1}' + "]" * 900) == [(0, "a", "1", None)]
    assert flat(spark, "[" * 50_000 + "]" * 50_000, "{", None, "", '{"a": 1, "a": 2}', "[]", "{}", "null", '"text"') == []
    assert flat(spark, '{"a": {"value": {"b": [1, true]}, "unit": [2]}}') == [(0, "a", '{"b":[1,true]}', "[2]")]
    long = "x" * 3_000_000
    assert flat(spark, json.dumps({"k": long})) == [(0, "k", long, None)]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "{}")], "doc_id long, raw string")
    plan = flatten_json(df, "doc_id", "raw")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert flatten_json(df.limit(0), "doc_id", "raw").count() == 0
