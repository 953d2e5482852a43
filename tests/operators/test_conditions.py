from tessera.operators.attributes import typed
from tessera.operators.conditions import Conditions, leaf_score, rank_conditions


def leaf(name, operator, value, **more):
    return {"name": name, "operator": operator, "value": value, **more}


def rows(spark):
    data = [
        (1, "energy", "5", "meV"), (1, "name", "Silver sample", None), (1, "date", "2023-05-06 07:08:09", None), (2, "energy", "7", None), (2, "name", "old silver", None), (2, "ok", "yes", None),
        (3, "energy", "9", "keV"), (3, "name", "gold", None), (3, "name", None, None), (4, "temp", "20", "°C"), (None, "name", "silver", None),
    ]
    return typed(spark.createDataFrame(data, "doc_id long, key string, value string, unit string"))


def test_leaves_that_are_not_valid(spark):
    for bad in (leaf("a", "BETWEEN", [1]), leaf("a", "IN", [1, "x"]), leaf("a", "IN", []), leaf("a", "=", [1]), leaf("a", ">", "text"), leaf("a", "~", 1), leaf("", "=", 1), {"name": "a", "operator": "="}, leaf("a", ">", True), leaf("a", "BETWEEN", [1, "b"]), leaf([], "=", 1)):
        assert leaf_score(bad) is None, bad


def test_text_scores_and_existential_negatives(spark):
    r = rows(spark)
    got = {x.doc_id: x.has_condition_1 for x in Conditions(leaf("name", "=", "silver")).flags(r.filter("doc_id is not null")).collect()}
    assert got == {1: 2, 2: 1}
    got = {x.doc_id for x in Conditions(leaf("name", "!=", "silver")).flags(r).collect()}
    assert got == {3}  # the null value matches nothing
    got = {x.doc_id for x in Conditions(leaf("name", "IS NULL", None)).flags(r).collect()}
    assert got == {3}


def test_units_dates_and_booleans(spark):
    ids = lambda tree: {x.doc_id for x in Conditions(tree).flags(rows(spark)).collect()}
    assert ids(leaf("energy", ">=", 5, unit="meV")) == {1, 2, 3}  # 7 has no unit and compares as it is
    assert ids(leaf("energy", "=", 0.005, unit="eV")) == {1}
    assert ids(leaf("energy", "BETWEEN", [8, 10], unit="keV")) == {3}
    assert ids(leaf("temp", "<", 300, unit="K")) == {4}
    assert ids(leaf("date", "=", "2023/05/06")) == {1} and ids(leaf("date", "<=", "2023-05-06")) == {1} and ids(leaf("date", "<", "2023-05-06")) == set()
    assert ids(leaf("ok", "=", True)) == {2} and ids(leaf("ok", "!=", True)) == set()


def test_dropped_leaves_vanish_from_the_tree(spark):
    tree = {"logic": "AND", "conditions": [leaf("name", "=", "silver"), leaf("x", ">", "text"), {"logic": "OR", "conditions": [leaf("energy", ">", 6), leaf("x", "IN", [])]}]}
    c = Conditions(tree)
    assert len(c.scores) == 2
    got = {r.doc_id: (r.full_match, r.partial_match_count, r.partial_rank) for r in rank_conditions(rows(spark), tree).collect()}
    assert got == {1: (0, 2, 1), 2: (1, 2, 1), 3: (0, 1, 2)}
    nothing = {"logic": "AND", "conditions": [leaf("x", "IN", [])]}
    assert rank_conditions(rows(spark), nothing).count() == 0


def test_values_by_meaning(spark):
    r = spark.createDataFrame([(1, "creator", "x", [1.0, 0.0]), (2, "creator", "y", [0.0, 1.0]), (3, "other", "z", [1.0, 0.0])], "doc_id long, key string, value string, value_vector array<double>")
    tree = leaf(["creator", "other"], "=", "nobody")
    assert {x.doc_id for x in Conditions(tree, {id(tree): [1.0, 0.1]}).flags(r).collect()} == {1}
    far = leaf(["creator"], "NOT IN", ["x", "y"])
    assert {x.doc_id for x in Conditions(far, {id(far): [1.0, 0.1]}).flags(r).collect()} == {2}
