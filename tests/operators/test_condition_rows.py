import json
import random

from pyspark.sql import functions as F

from tessera.operators import condition_rows as condition_rows_module
from tessera.operators.attributes import typed
from tessera.operators.condition_rows import condition_rows, rank_trees, read_leaf, read_tree
from tessera.operators.conditions import leaf_score, rank_conditions
from tessera.session import written
from tests.operators.test_conditions import leaf, rows

VALUES = [5, 7.5, True, "silver", "2023-05-06", "2023/05/06", "C:\\data", "50%", "", None, [5, 7], [5], [], ["a", "silver"], ["2023-05-06", "2023.05.07"], [1, "x"], [True, False]]
OPERATORS = ["=", "!=", "<", ">=", "like", "ILIKE", "NOT LIKE", "IN", "NOT IN", "BETWEEN", "not between", "IS NULL", "IS NOT NULL", "~"]


def test_the_same_leaves_are_valid(spark):
    for value in VALUES:
        for op in OPERATORS:
            for unit in (None, "meV", "furlong"):
                one = leaf("energy", op, value, unit=unit)
                assert (read_leaf(one) is None) == (leaf_score(one) is None), one
    assert read_leaf({"operator": "=", "value": 1}) is None and read_leaf(leaf([], "=", 1)) is None and read_leaf({"name": "a", "value": 1}) is None


def tree_of(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return leaf(rng.choice(["energy", "name", "date", "ok", "temp", ["energy", "temp"]]), rng.choice(OPERATORS), rng.choice(VALUES), **({"unit": rng.choice(["meV", "K", "keV", "miles"])} if rng.random() < 0.4 else {}))
    return {"logic": rng.choice(["AND", "OR", "or"]), "conditions": [tree_of(rng, depth - 1) for _ in range(rng.randrange(4))]}


def test_postfix():
    a, b, bad = leaf("a", "=", "x"), leaf("b", "=", "y"), leaf("c", "IN", [])
    assert read_tree({"logic": "AND", "conditions": [a, {"logic": "OR", "conditions": [b, a, bad]}, {"logic": "OR", "conditions": [bad]}]})[1] == [{"op": "leaf", "n": 0}, {"op": "leaf", "n": 1}, {"op": "leaf", "n": 2}, {"op": "or", "n": 2}, {"op": "and", "n": 2}]
    assert read_tree(a)[1] == [{"op": "leaf", "n": 0}] and read_tree(bad) == ([], []) and read_tree(None) == ([], []) and read_tree([a]) == ([], [])


def test_many_trees_equal_one_at_a_time(spark):
    rng = random.Random(11)
    trees = {i: tree_of(rng, 2) for i in range(14)}
    trees[50] = trees[0]
    attributes = rows(spark).unionByName(rows(spark).limit(1).selectExpr("9L as doc_id", "'name' as key", "'c:\\\\DATA 50%' as value", "unit", "value_boolean", "value_numeric", "value_timestamp", "value_si"))
    attributes = attributes.cache()
    queries = spark.createDataFrame([(i, json.dumps(t)) for i, t in trees.items()] + [(100, None), (101, "{"), (102, " ")], "query_id long, filters string")
    ranked, of = rank_trees(attributes, *condition_rows(queries))
    got = {}
    for r in ranked.join(of, "tree_id").collect():
        got.setdefault(r.query_id, {})[r.doc_id] = (r.full_match, r.partial_match_count, r.partial_rank)
    for i, t in trees.items():
        want = {r.doc_id: (r.full_match, r.partial_match_count, r.partial_rank) for r in rank_conditions(attributes, t).collect()}
        assert got.get(i, {}) == want, t
    assert set(got) <= set(trees)
    attributes.unpersist()


def test_meaning_and_backslashes(spark):
    data = [(1, "creator", "x", [1.0, 0.0]), (2, "creator", "y", [0.0, 1.0]), (3, "other", "z", [1.0, 0.0]), (4, "path", "c:\\Data\\1", None), (5, "path", "c:data", None), (6, "path", "100%", None), (7, "path", "100 x", None)]
    r = spark.createDataFrame(data, "doc_id long, key string, value string, value_vector array<double>")
    trees = [leaf(["creator", "other"], "=", "nobody"), leaf(["creator"], "NOT IN", ["x", "y"]), leaf("path", "=", "C:\\data"), leaf("path", "=", "c:\\\\data"), leaf("path", "=", "100\\%"), leaf("path", "=", "100%"), leaf("path", "!=", "C:\\data"), leaf("path", "LIKE", "100\\")]
    queries = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "query_id long, filters string")
    vectors = spark.createDataFrame([(0, 0, [1.0, 0.1]), (1, 0, [1.0, 0.1])], "query_id long, leaf int, vector array<double>")
    ranked, of = rank_trees(r, *condition_rows(queries), vectors=vectors)
    got = {}
    for x in ranked.join(of, "tree_id").collect():
        got.setdefault(x.query_id, set()).add(x.doc_id)
    assert got == {0: {1}, 1: {2}, 2: {5}, 3: {4}, 4: {6}, 5: {6, 7}, 6: {4, 6, 7}, 7: {6}}
    for i in range(2, 8):  # the same, one tree at a time
        assert {x.doc_id for x in rank_conditions(r.drop("value_vector"), trees[i]).collect()} == got[i]


def test_the_plan_does_not_grow_with_the_trees(spark):
    sizes = []
    for n in (2, 40):
        queries = spark.createDataFrame([(i, json.dumps(leaf("energy", ">", i))) for i in range(n)], "query_id long, filters string")
        ranked, _ = rank_trees(rows(spark), *condition_rows(queries))
        sizes.append(len(ranked._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_copies_of_documents_are_evaluated_once(spark, monkeypatch):
    """Tables between the attributes and the result grow with distinct values and sets of them alone; large ones are not broadcast."""
    queries = spark.createDataFrame([(0, json.dumps(leaf("energy", ">", 1))), (1, json.dumps({"logic": "OR", "conditions": [leaf("name", "LIKE", "s"), leaf("energy", "<=", 6)]}))], "query_id long, filters string")
    base = spark.createDataFrame([(0, "energy", "5"), (0, "name", "silver"), (1, "energy", "7"), (2, "name", "gold"), (3, "name", "as"), (3, "name", None), (3, None, "x")], "doc_id long, key string, value string").withColumn("unit", F.lit(None).cast("string"))
    seen, found = [], []
    for copies, most in ((1, condition_rows_module.BROADCAST_BYTES), (40, 0)):
        counts = {}

        def counted(df, name, counts=counts):
            out = written(df, name)
            counts[name] = out.count()
            return out

        monkeypatch.setattr(condition_rows_module, "written", counted)
        monkeypatch.setattr(condition_rows_module, "BROADCAST_BYTES", most)
        rows = base.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") + 10 * F.col("copy")).drop("copy")
        ranked, of = rank_trees(rows, *condition_rows(queries), typing=typed)
        got = ranked.join(of, "tree_id").select("query_id", "doc_id", "full_match", "partial_match_count", "partial_rank").collect()
        assert ("BroadcastHashJoin" in ranked._jdf.queryExecution().executedPlan().toString()) == (most > 0)
        assert counts.pop("documents") == 3 * copies
        seen.append(counts)
        found.append({(r.query_id, r.doc_id % 10, *r[2:]) for r in got})
        assert len(got) == 4 * copies
    assert seen[0] == seen[1]
    assert found[0] == found[1] == {(0, 0, 1, 1, 1), (0, 1, 1, 1, 1), (1, 0, 1, 3, 1), (1, 3, 1, 1, 2)}
