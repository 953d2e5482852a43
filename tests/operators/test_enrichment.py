import json

from tessera.operators import attributes as A
from tessera.operators import inferred, tables
from tessera.operators.vectors import resolve_names, similar


def flat(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, raw string")
    return sorted((r.doc_id, r.key, r.value, r.unit) for r in A.flatten_json(df, "doc_id", "raw").collect())


def test_flatten(spark):
    assert flat(spark, '{"scientificMetadata": {"measurement": {"beamline": "ID16"}}}') == [(0, "measurement.beamline", "ID16", None)]
    got = flat(spark, '{"a": [1, {"b": true}], "e": {"value": 5, "unit": "keV"}, "t": {"v": "3", "u": "K"}, "p": {"name": "gap", "value": 1.5, "units": "mm"}, "n": null}', "not json", None)
    assert got == [(0, "a", "1", None), (0, "a.b", "True", None), (0, "e", "5", "keV"), (0, "p.gap", "1.5", "mm"), (0, "t", "3", "K")]
    df = spark.createDataFrame([(1, '{"document": {"x": 1}, "other": {"y": 2}}'), (2, '{"document": {"x": 1}, "collection": null}')], "doc_id long, raw string")
    assert [tuple(r) for r in A.standard_attributes(df).collect()] == [(1, "x", "1", None, "EXPLICIT")]
    assert flat(spark, '{"v": 1, "u": "m", "more": 2, "value": 3, "unit": "s"}', "5", '{"a": {"name": "n", "value": null, "units": "s"}, " ": 1}') == []
    assert flat(spark, "[" * 300 + '{"a": 1}' + "]" * 300) == [(0, "a", "1", None)]


def test_publications(spark):
    record = {
        "collection": None, "document": {"no": 1}, "panosc": {"a": 1}, "users": [{"name": "x"}, "y"], "investigation": {"id": 3}, "instruments": {"v": 1, "u": "m"}, "samplesMore": {"z": 1},
        "samples": [{"datafiles": [1], "parameters": [{"name": "__hidden", "value": 1, "units": "m"}, {"name": "temp", "value": 2, "units": "K"}, "raw"], "id": 7}, "plain"],
        "datasets": [{"datafiles": 1, "name": "d"}, "stray"], "datacite": [{"attributes": {"xml": "<x/>", "doi": "10.1"}, "id": 1}, 5],
    }
    df = spark.createDataFrame([(1, json.dumps(record)), (2, '{"panosc": {"a": 1}}'), (3, '{"collection": 1, "datacite": {"doi": 1}, "samples": {"id": 1}}')], "doc_id long, raw string")
    got = sorted((r.doc_id, r.key, r.value, r.unit) for r in A.publication_attributes(df).collect())
    want = [("a", "1", None), ("doi", "10.1", None), ("id", "1", None), ("instruments", "1", "m"), ("investigation.id", "3", None), ("name", "d", None), ("samples", "plain", None), ("samples.id", "7", None), ("samples.parameters", "raw", None), ("samples.parameters.temp", "2", "K"), ("users", "y", None), ("users.name", "x", None)]
    assert got == sorted((1, *w) for w in want)


def test_rows_and_derivations(spark):
    rows = spark.createDataFrame([(1, "energy", "5 keV", None, "EXPLICIT"), (1, "gap", "1-5mm", None, "EXPLICIT"), (1, "x", "3 K", None, "EXPLICIT"), (1, "x", "3", "K", "DERIVED"), (2, "publisher", "MAX IV Laboratory, Lund University", None, "EXPLICIT"), (3, "publisher", "PSI", None, "EXPLICIT"), (3, "publisher", "Paul Scherrer Institute", None, "DERIVED")], "doc_id long, key string, value string, unit string, type string")
    got = sorted((r.doc_id, r.key, r.value, r.unit) for r in A.derived_measurements(rows).collect())
    assert got == [(1, "energy", "5", "keV"), (1, "gap.max", "5", "mm"), (1, "gap.min", "1", "mm")]
    got = sorted((r.doc_id, r.value) for r in A.harmonised_publishers(rows).collect())
    assert got == [(2, "MAX IV"), (2, "MAX IV Laboratory")]
    names = spark.createDataFrame([(1, "creator", "Ann Bee, Cee Dee", None), (2, "creator", "One", None)], "doc_id long, key string, value string, unit string")
    assert sorted(r.value for r in A.split_value_rows(names, ["creator"]).collect()) == ["Ann Bee", "Cee Dee"]


def test_inserts(spark):
    old = spark.createDataFrame([("a", None)], "k string, u string")
    new = spark.createDataFrame([("a", None), ("a", "x"), ("b", None)], "k string, u string")
    assert sorted((r.k, r.u or "") for r in tables.insert_absent(new, old, ["k", "u"]).collect()) == [("a", "x"), ("b", "")]
    rows = spark.createDataFrame([("a", 2, "z"), ("a", 1, "y"), ("b", 3, "x")], "k string, n int, v string")
    assert sorted(r.v for r in tables.first_wins(rows, ["k"], ["n"]).collect()) == ["x", "y"]
    assert sorted(r.v for r in tables.latest_wins(rows, ["k"], ["n"]).collect()) == ["x", "z"]
    dim = tables.get_or_create(rows.withColumnRenamed("k", "name"), spark.createDataFrame([(7, "a")], "id long, name string"))
    assert sorted((r.id, r.name) for r in dim.collect()) == [(7, "a"), (8, "b")]


def test_packing(spark):
    rows = [(1, "a", f"v{i}") for i in range(3)] + [(1, "b", f"v{i}") for i in range(9)] + [(1, "c", "x"), (1, "c", "x"), (2, "a", " ")]
    got = inferred.pack_rows(spark.createDataFrame(rows, "doc_id long, key string, value string"), limit=4).collect()
    assert len(got) == 13
    size = {}
    for r in got:
        size.setdefault(r.cluster, set()).add((r.key, r.value))
    assert max(map(len, size.values())) <= 4
    assert len({r.cluster for r in got if r.key == "a"}) == 1 and len({r.cluster for r in got if r.key == "b"}) == 3


def test_candidates(spark):
    text = '{"filters": [{"name": "a", "description": "d", "value": "v", "unit": null, "evidence_indices": [0, "1", -1, "bad", 0]}, {"name": "", "value": "v"}, {"name": "b", "value": [1]}, {"name": "c"}]}'
    got = inferred.parse_candidates(spark.createDataFrame([(1, text), (2, "junk"), (3, None), (4, "[]"), (5, '{"filters": 3}')], "doc_id long, json string")).collect()
    assert [(r.name, r.evidence_indices) for r in got] == [("a", [0, 1])]
    # twelve usable candidates count, and all of their evidence; `[x]` is a text like any other
    many = [{"name": f" n  {i}", "description": "d" if i % 5 else " ", "value": [" [x] ", 5, True, 1.5][i % 4], "unit": ["", None, "mm", " k  g "][i % 4], "evidence_indices": list(range(20))} for i in range(1, 20)]
    got = inferred.parse_candidates(spark.createDataFrame([(1, json.dumps({"filters": [7, *many]}))], "doc_id long, json string")).collect()
    used = [m for i, m in enumerate(many, 1) if i % 5][:12]
    assert [(r.name, r.value, r.unit) for r in got] == [(m["name"].strip().replace("  ", " "), str(m["value"]).strip(), " ".join((m["unit"] or "").split()) or None) for m in used]
    assert all(r.evidence_indices == list(range(20)) for r in got)


def test_votes(spark):
    rows = [(1, "k", "x", None, "e1", "v", 1), (1, "k", "x", None, "e2", "v", 2), (1, "k", "y", None, "e1", "v", 1), (1, "t", "x", None, "e1", "v", 1), (1, "t", "y", None, "e2", "v", 1), (2, "k", "z", "mm", "e1", "v", 1)]
    got = sorted((r.doc_id, r.key, r.value) for r in inferred.vote(spark.createDataFrame(rows, "doc_id long, key string, value string, unit string, ekey string, evalue string, cluster int")).collect())
    assert got == [(1, "k", "x"), (2, "k", "z")]


def test_keys_are_resolved_in_turn(spark):
    keys = spark.createDataFrame([("beamEnergy", [1.0, 0.0]), ("temperature", [0.0, 1.0]), ("Temp.A", [0.7, 0.7]), ("temp_a", [0.7, 0.7])], "key string, vector array<double>")
    said = spark.createDataFrame([("temperature", "how hot  it is", [0.0, 1.0])], "key string, description string, vector array<double>")
    names = spark.createDataFrame([("beam energy", [0.0, 1.0]), ("How hot it is", [1.0, 1.0]), ("heat", [0.05, 1.0]), ("temp a", [0.7, 0.7]), ("novelThing", [-1.0, 0.2])], "name string, vector array<double>")
    got = {r.name: (r.key, r.is_new) for r in inferred.resolve_keys(names, keys, said).collect()}
    assert got == {"beam energy": ("beamEnergy", False), "How hot it is": ("temperature", False), "heat": ("temperature", False), "temp a": ("temp a", True), "novelThing": ("novel thing", True)}
    named = {}
    for r in resolve_names(names.filter("name in ('heat', 'novelThing')"), keys, said.drop("description"), threshold=0.5, least=2).collect():
        named.setdefault(r.name, set()).add(r.key)
    assert "temperature" in named["heat"] and len(named["heat"]) >= 2 and len(named["novelThing"]) == 2
    empty = resolve_names(names, keys.limit(0)).collect()
    assert all(r.name == r.key for r in empty) and len(empty) == 5


def test_similar_skips_null_and_zero_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id int, intention_vector array<double>")
    c = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "doc_id long, vector array<double>")
    assert [tuple(r) for r in similar(q, c).collect()] == [(1, 1, 0.0)]


def test_inferred_rows_are_replaced(spark):
    kind = "doc_id long, key string, value string, unit string, type string"
    old = spark.createDataFrame([(1, "a", "x", None, "INFERRED"), (1, "b", "y", None, "EXPLICIT"), (2, "a", "x", None, "INFERRED")], kind)
    new = spark.createDataFrame([(1, "b", "y", None), (1, "c", "z", None)], "doc_id long, key string, value string, unit string")
    got = sorted(map(tuple, inferred.replace_inferred(old, new, new.select("doc_id")).select("doc_id", "key", "value", "type").collect()))
    assert got == [(1, "b", "y", "EXPLICIT"), (1, "c", "z", "INFERRED"), (2, "a", "x", "INFERRED")]
