"""Condition trees of many queries as rows: leaves joined to attributes by key, trees folded from arrays."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import cosine_distance
from tessera.functions.units import literal_si, si_text
from tessera.operators.conditions import VECTOR_KEYS, VECTOR_THRESHOLD, pattern_of, strict_datetime
from tessera.session import written

#: What a leaf asks of a value, by the operator and the kind of its own values.
LEAF = "struct<leaf:int,names:array<string>,test:string,op:string,texts:array<string>,numbers:array<double>,moments:array<string>,flag:boolean,bare:boolean,si:array<double>,dim:string>"
#: A tree in postfix order: `leaf` takes the leaf of number n, `and` and `or` the last n results.
STEP = "struct<op:string,n:int>"
CONTENT = ["names", "test", "op", "texts", "numbers", "moments", "flag", "bare", "si", "dim"]
COMPARISONS = {"=", "!=", ">", "<", ">=", "<="}
LIKES = {"LIKE": "like", "ILIKE": "like", "NOT LIKE": "unlike", "NOT ILIKE": "unlike"}
#: Bytes of a written table's rows up to which it is sent to every task; its files tell little of them, as equal values take next to no room there.
BROADCAST_BYTES = 64 << 20
LISTS = {"BETWEEN": 2, "NOT BETWEEN": 2, "IN": 0, "NOT IN": 0}


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def read_leaf(node: dict) -> dict | None:
    """A leaf as a row of `LEAF` without its number, or None if it is not valid (see `conditions.leaf_score`)."""
    named = node.get("name")
    names = sorted({n for n in (named if isinstance(named, (list, tuple)) else [named]) if n})
    if not names or "operator" not in node or "value" not in node:
        return None
    op, value, unit = str(node["operator"]).upper(), node["value"], node.get("unit")
    row = dict.fromkeys([c for c in CONTENT], None) | {"names": [str(n) for n in names], "op": op, "bare": True}
    many = isinstance(value, (list, tuple))
    values = list(value) if many else [value]
    if op in ("IS NULL", "IS NOT NULL"):
        return row | {"test": "null"}
    if (op in LISTS) != many or (many and (not values or LISTS[op] and len(values) != LISTS[op])):
        return None
    moments = [strict_datetime(v) for v in values]
    texts = all(isinstance(v, str) for v in values)
    if all(map(_is_number, values)) and (op in LISTS or op in COMPARISONS):
        row |= {"test": "number", "numbers": [float(v) for v in values]}
        if isinstance(unit, str) and unit.strip():
            si = [literal_si(v, unit) for v in row["numbers"]]
            row |= {"bare": False} | ({} if any(x is None for x in si) else {"si": [x[0] for x in si], "dim": si[0][1]})
        return row
    if all(moments) and (op in COMPARISONS or "BETWEEN" in op):
        return row | {"test": "moment", "moments": [m.isoformat(" ") for m in moments]}
    if op in LISTS:
        return row | {"test": "text", "texts": values} if texts else None
    if isinstance(value, bool) and op in ("=", "!="):
        return row | {"test": "flag", "flag": value}
    if op in LIKES and not all(moments):
        return row | {"test": LIKES[op], "texts": [str(value)]}
    if texts and op in ("=", "!="):
        return row | {"test": "like" if op == "=" else "unlike", "texts": values}
    return None


def read_tree(tree) -> tuple[list[dict], list[dict]]:
    """The valid leaves of a tree, numbered from 0, and its postfix form; nothing for a tree without any."""
    leaves: list[dict] = []
    steps: list[dict] = []
    todo = [(tree, False)]
    counts: list[int] = []  # results that the open nodes have so far
    while todo:
        node, closing = todo.pop()
        if closing:
            n = counts.pop()
            if n:
                if n > 1:
                    steps.append({"op": "or" if str(node["logic"]).upper() == "OR" else "and", "n": n})
                if counts:
                    counts[-1] += 1
        elif isinstance(node, dict) and "logic" in node and "conditions" in node:
            counts.append(0)
            todo.append((node, True))
            todo += [(c, False) for c in reversed(node["conditions"] or [])]
        elif isinstance(node, dict) and (leaf := read_leaf(node)) is not None:
            steps.append({"op": "leaf", "n": len(leaves)})
            leaves.append({"leaf": len(leaves), **leaf})
            if counts:
                counts[-1] += 1
    return leaves, steps


def _read_filters(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        try:
            out.append(read_tree(json.loads(t) if t else None))
        except (ValueError, RecursionError):
            out.append(([], []))
    return pd.DataFrame(out, columns=["leaves", "steps"])


def condition_rows(queries: DataFrame, query_col: str = "query_id", filters_col: str = "filters") -> tuple[DataFrame, DataFrame]:
    """Leaves and trees of queries whose `filters_col` holds a condition tree as JSON.

    The leaves are `query_col, leaf, names, test, op, ...`, a row each; the
    trees `query_col, steps`, for queries with one valid leaf at least. Leaves
    that are not valid vanish and a node with one child is that child, so a
    null, blank or broken text has no tree. One small parse for each query.
    """
    of = F.pandas_udf(_read_filters, f"struct<leaves:array<{LEAF}>,steps:array<{STEP}>>")
    read = written(queries.select(query_col, of(F.col(filters_col)).alias("r")).select(query_col, "r.*").filter(F.size("leaves") > 0), "filters")
    return read.select(query_col, F.explode("leaves").alias("l")).select(query_col, "l.*"), read.select(query_col, "steps")


def with_keys(leaves: DataFrame, resolved: DataFrame) -> DataFrame:
    """`leaves` with the keys in place of the raw names that `resolved(name, key)` has; other names stay."""
    each = leaves.select("*", F.explode("names").alias("name")).join(resolved.groupBy("name").agg(F.collect_set("key").alias("keys")), "name", "left")
    keys = [c for c in leaves.columns if c != "names"]
    met = each.select(*[c for c in keys if c in ("query_id", "leaf")], F.explode(F.coalesce("keys", F.array("name"))).alias("key"))
    names = met.groupBy(*[c for c in keys if c in ("query_id", "leaf")]).agg(F.array_sort(F.collect_set("key")).alias("names"))
    return leaves.drop("names").join(names, [c for c in keys if c in ("query_id", "leaf")]).select(leaves.columns)


def _pattern(text: Column) -> Column:
    """`conditions.pattern_of` for a column."""
    return F.regexp_replace(text, r"(?s)\\(?![%_\\])(.)|(\\.)", "$1$2")


def _compare(c: Column, values: Column) -> Column:
    """A value against the leaf's, by its operator."""
    op, first, second = F.col("op"), F.get(values, F.lit(0)), F.get(values, F.lit(1))
    out = F.when(op == "=", c == first).when(op == "!=", c != first).when(op == ">", c > first).when(op == "<", c < first).when(op == ">=", c >= first).when(op == "<=", c <= first)
    return out.when(op == "BETWEEN", c.between(first, second)).when(op == "NOT BETWEEN", ~c.between(first, second)).when(op == "IN", F.array_contains(values, c)).when(op == "NOT IN", ~F.array_contains(values, c))


def _either(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def leaf_scores(meaning: bool) -> Column:
    """What an attribute row scores for the leaf beside it: 2, 1 or 0; `meaning` tells whether there are vectors."""
    value, own, number, op = F.col("value"), F.col("value_si"), F.col("value_numeric"), F.col("op")
    if meaning:
        d = cosine_distance(F.col("value_vector"), F.col("vector"))
        known = F.col("key").isin(VECTOR_KEYS)
        near, far = F.coalesce(known & (d < VECTOR_THRESHOLD), F.lit(False)), F.coalesce(known & (d > VECTOR_THRESHOLD), F.lit(False))
    else:
        near = far = F.lit(False)
    low, asked = F.lower("value"), F.lower(F.get("texts", F.lit(0)))
    # most values hold no wildcard; LIKE compiles a pattern for each
    plain = ~asked.rlike(r"[%_\\]")
    starts = F.when(plain, F.startswith(low, asked)).otherwise(F.expr("lower(value) like lower(at_start)"))
    inside = F.when(plain, F.contains(low, asked)).otherwise(F.expr("lower(value) like lower(anywhere)"))
    plainly = _compare(number, F.col("numbers"))
    equal = (own["dim"] == F.col("dim")) & F.array_contains(F.transform("si", lambda m: si_text(m)), si_text(own["magnitude"]))
    of_si = F.when(op.isin("=", "IN"), equal).when(op.isin("!=", "NOT IN"), ~equal).otherwise((own["dim"] == F.col("dim")) & _compare(own["magnitude"], F.col("si")))
    numbers = F.when(F.col("bare"), plainly).when(own.isNull(), plainly).otherwise(F.when(F.col("dim").isNotNull(), of_si))
    moments = F.transform("moments", lambda m: m.cast("timestamp_ntz"))
    ts = F.col("value_timestamp")
    when = _either(_compare(ts, moments), _compare(F.to_date(ts), F.transform(moments, lambda m: F.to_date(m))))
    texts = _either(_compare(value, F.col("texts")), F.when(op == "IN", near).when(op == "NOT IN", far))
    test = F.col("test")
    met = (
        F.when(test == "unlike", _either(~inside, far)).when(test == "null", F.when(op == "IS NULL", value.isNull()).otherwise(value.isNotNull()))
        .when(test == "number", numbers).when(test == "moment", when).when(test == "text", texts).when(test == "flag", F.when(op == "=", F.col("value_boolean") == F.col("flag")).otherwise(F.col("value_boolean") != F.col("flag")))
    )
    return F.when(test == "like", F.when(starts, 2).when(_either(inside, near), 1).otherwise(0)).otherwise(F.coalesce(met, F.lit(False)).cast("int"))


def _numbered(df: DataFrame, number: str, name: str) -> DataFrame:
    """The rows of `df` with a number each that stays."""
    return written(df.withColumn(number, F.monotonically_increasing_id()), name)


def sized(df: DataFrame, more: Column | int = 0) -> DataFrame:
    """A written table as one side of a join: broadcast if its rows, 64 bytes each and `more`, are counted as few, else never, however small its files are."""
    size = df.agg(F.coalesce(F.sum(F.lit(64).cast("long") + more), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def rank_trees(attributes: DataFrame, leaves: DataFrame, trees: DataFrame, doc_col: str = "doc_id", query_col: str = "query_id", vectors: DataFrame | None = None, typing: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """`tree_id, doc_col, full_match, partial_match_count, partial_rank` for documents that meet a condition, and `query_col, tree_id`.

    `leaves` and `trees` come from `condition_rows`; `vectors` is (query_col,
    leaf, vector), for leaves that also compare by meaning. The plan does not
    depend on the number of trees: equal leaves are evaluated once for each
    distinct value, and equal trees are folded once for each distinct set of
    values that the leaves tell apart; documents only look up what their set
    has. `typing` (`attributes.typed`) types the distinct values of attributes
    that are not typed yet. full_match is 1 where the tree holds; the rank is
    dense over the sum of the scores, the largest first. Rows of a null
    document or without a key count for nothing.
    """
    parts = int(attributes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = leaves.withColumnRenamed(query_col, "__q")
    if vectors is not None:
        leaves = leaves.join(vectors.select(F.col(query_col).alias("__q"), "leaf", F.col("vector").cast("array<double>").alias("vector")), ["__q", "leaf"], "left")
    else:
        leaves = leaves.withColumn("vector", F.lit(None).cast("array<double>"))
    leaves = leaves.withColumn("lid", F.sha2(F.to_json(F.struct(*CONTENT, "vector"), {"ignoreNullFields": "false"}), 256))
    leaves = written(leaves, "leaves")
    once = leaves.groupBy("lid").agg(*[F.first(c).alias(c) for c in (*CONTENT, "vector")])
    text = F.get("texts", F.lit(0))
    once = once.withColumn("at_start", F.when(F.col("test") == "like", _pattern(F.concat(text, F.lit("%"))))).withColumn("anywhere", F.when(F.col("test").isin("like", "unlike"), _pattern(F.concat(F.lit("%"), text, F.lit("%")))))
    once = _numbered(once, "at", "leaf-content")
    each = once.select("*", F.explode("names").alias("key")).drop("names", "lid")

    # distinct values, and what each scores
    kinds = {"value_boolean": "boolean", "value_numeric": "double", "value_timestamp": "timestamp_ntz", "value_si": "struct<magnitude:double,dim:string>"}
    own = ["key", "value", *[c for c in (["unit"] if typing else [*kinds]) + ["value_vector"] if c in attributes.columns]]
    rows = attributes.filter(F.col(doc_col).isNotNull()).join(each.select("key").distinct(), "key", "left_semi").select(F.col(doc_col).alias("__doc"), F.struct(*own).alias("own"))
    values = written(rows.select("own").distinct(), "values")
    known = values.select("own", "own.*") if typing is None else typing(values.select("own", "own.*"))
    known = known.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in known.columns})
    met = known.repartition(parts).join(each, "key").select("own", "at", leaf_scores("value_vector" in own).alias("score")).filter("score > 0")
    hits = written(met.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("at", "score"))).alias("hits")), "hits")
    sets = _numbered(hits.select("hits").distinct(), "set", "hit-sets")

    # documents by the sets that their values have: equal lists are one profile
    of_value = written(hits.join(sized(sets, 32 * F.size("hits")), "hits").select("own", "set"), "sets-of-values")
    docs = written(rows.join(sized(of_value, F.coalesce(F.length("own.value"), F.lit(0)) + (8 * F.coalesce(F.array_size("own.value_vector"), F.lit(0)) if "value_vector" in own else 0)), "own").groupBy("__doc").agg(F.array_sort(F.collect_set("set")).alias("sets")).repartition(parts), "documents")
    profiles = _numbered(docs.select("sets").distinct(), "profile", "profiles")
    flags = profiles.select("profile", F.explode("sets").alias("set")).join(sized(sets, 32 * F.size("hits")), "set").select("profile", F.explode("hits").alias("h")).select("profile", "h.*")
    flags = flags.repartition(parts, "profile").groupBy("profile", "at").agg(F.max("score").alias("score"))

    named = leaves.join(sized(once.select("lid", "at")), "lid").groupBy("__q").agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "at"))), lambda x: x["at"]).alias("ats"))
    asked = written(trees.withColumnRenamed(query_col, "__q").join(named, "__q").select("__q", "steps", "ats").withColumn("tree", F.sha2(F.to_json(F.struct("steps", "ats")), 256)), "trees")
    numbers = _numbered(asked.groupBy("tree").agg(F.first("steps").alias("steps"), F.first("ats").alias("ats")), "tree_id", "tree-numbers")
    found = flags.join(numbers.select("tree_id", F.posexplode("ats").alias("leaf", "at")), "at").groupBy("tree_id", "profile").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "score"))).alias("scores"))
    found = found.join(sized(numbers.select("tree_id", "steps"), 40 * F.size("steps")), "tree_id").select("tree_id", "profile", holds(F.col("steps"), F.col("scores")).cast("int").alias("full_match"), F.aggregate(F.map_values("scores"), F.lit(0), lambda a, x: a + x).alias("partial_match_count"))
    found = written(found, "met")
    sums = found.select("tree_id", "partial_match_count").distinct()  # two values a leaf at most
    ranks = sums.withColumn("partial_rank", F.dense_rank().over(W.partitionBy("tree_id").orderBy(F.desc("partial_match_count"))))
    ranked = written(found.join(sized(written(ranks, "tree-ranks")), ["tree_id", "partial_match_count"]), "ranked-profiles")
    out = docs.join(sized(profiles, 8 * F.size("sets")), "sets").join(sized(ranked), "profile").select("tree_id", F.col("__doc").alias(doc_col), "full_match", "partial_match_count", "partial_rank")
    return out, asked.join(numbers.select("tree", "tree_id"), "tree").select(F.col("__q").alias(query_col), "tree_id")


def holds(steps: Column, scores: Column) -> Column:
    """Whether a postfix tree holds, given the scores of the leaves that have one."""

    def step(stack: Column, s: Column) -> Column:
        rest = F.size(stack) - s["n"]
        last = F.slice(stack, rest + 1, s["n"])
        joined = F.when(s["op"] == "and", F.forall(last, lambda x: x)).otherwise(F.exists(last, lambda x: x))
        return F.when(s["op"] == "leaf", F.concat(stack, F.array(F.call_function("map_contains_key", scores, s["n"])))).otherwise(F.concat(F.slice(stack, F.lit(1), rest), F.array(joined)))

    return F.coalesce(F.get(F.aggregate(steps, F.array().cast("array<boolean>"), step), F.lit(0)), F.lit(False))
