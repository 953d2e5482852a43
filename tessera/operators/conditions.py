"""Structured conditions over attribute rows: leaves, trees and the condition ranking."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import cosine_distance
from tessera.functions.units import literal_si, si_text
from tessera.session import written

#: Keys whose text values are also compared by meaning.
VECTOR_KEYS = [
    "authors", "creator", "author", "owner", "authors.name", "principalInvestigator", "investigator",
    "measurement.team", "users.fullName", "creators.name", "contributors.name", "publisher", "parameters.SamplePatient_info",
]
VECTOR_THRESHOLD = 0.30
FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y.%m.%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d"]
COMPARE = {"=": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}


def strict_datetime(value) -> datetime | None:
    """The six formats of `functions.scalars.strict_timestamp`, for a literal."""
    for f in FORMATS if isinstance(value, str) else ():
        try:
            return datetime.strptime(value.strip(), f)
        except ValueError:
            continue
    return None


def pattern_of(text: str) -> str:
    """A LIKE pattern that Spark takes: a backslash before anything but `%`, `_` and itself stands for what follows it, and vanishes."""
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], text, flags=re.DOTALL)


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _names(leaf: dict) -> list[str]:
    n = leaf.get("name")
    return sorted({x for x in (n if isinstance(n, (list, tuple)) else [n]) if x})


def _by_meaning(leaf: dict, vector: Sequence[float] | None, far: bool = False) -> Column:
    """Whether the value's vector is near (or far from) the condition's, for the keys that have vectors."""
    keys = [n for n in _names(leaf) if n in VECTOR_KEYS]
    if vector is None or not keys:
        return F.lit(False)
    d = cosine_distance(F.col("value_vector"), F.array(*[F.lit(float(x)) for x in vector]))
    return F.coalesce(F.col("key").isin(keys) & ((d > VECTOR_THRESHOLD) if far else (d < VECTOR_THRESHOLD)), F.lit(False))


def _dates(op: str, values: list[datetime]) -> Column:
    """A comparison that holds for the moments or for their days."""
    ts, lits = F.col("value_timestamp"), [F.lit(v).cast("timestamp_ntz") for v in values]
    if "BETWEEN" in op:
        both = [ts.between(*lits), F.to_date(ts).between(*[F.to_date(x) for x in lits])]
        return (~both[0] | ~both[1]) if op.startswith("NOT") else (both[0] | both[1])
    return COMPARE[op](ts, lits[0]) | COMPARE[op](F.to_date(ts), F.to_date(lits[0]))


def _numbers(op: str, values: list[float], unit: str | None) -> Column:
    """A comparison of numbers; with a unit that of SI magnitudes, or of bare numbers where there are none."""
    own, number = F.col("value_si"), F.col("value_numeric")

    def compare(c: Column, lits: list) -> Column:
        if "BETWEEN" in op:
            return ~c.between(*lits) if op.startswith("NOT") else c.between(*lits)
        if "IN" in op:
            return ~c.isin(lits) if op.startswith("NOT") else c.isin(lits)
        return COMPARE[op](c, F.lit(lits[0]))

    plain = compare(number, [float(v) for v in values])
    if not (isinstance(unit, str) and unit.strip()):
        return plain
    si = [literal_si(float(v), unit) for v in values]
    if any(x is None for x in si):
        return own.isNull() & plain
    same = own["dim"] == si[0][1]
    if op in ("=", "!=", "IN", "NOT IN"):
        texts = [f"{m:.11e}" for m, _ in si]
        equal = same & si_text(own["magnitude"]).isin(texts)
        met = equal if op in ("=", "IN") else ~equal
    else:
        met = same & compare(own["magnitude"], [m for m, _ in si])
    return F.when(own.isNotNull(), met).otherwise(plain)


def leaf_score(leaf: dict, vector: Sequence[float] | None = None) -> Column | None:
    """What one attribute row scores for a leaf: 2, 1 or 0; None for a leaf that is not valid.

    `name` is one key or a list of keys. Text by `=` and `LIKE` scores 2 at the
    start of a value and 1 inside it, in any case, with `%` and `_` as
    wildcards and a backslash to take the next character as it is. Negations hold if some row does not match. Not valid are wrong
    numbers of values, lists of mixed types, lists beside other operators,
    order on plain text, and unknown operators.
    """
    if not {"name", "operator", "value"} <= leaf.keys() or not _names(leaf):
        return None
    op, value, unit = str(leaf["operator"]).upper(), leaf["value"], leaf.get("unit")
    text, flag = F.col("value"), None
    if op in ("BETWEEN", "NOT BETWEEN"):
        if not (isinstance(value, (list, tuple)) and len(value) == 2):
            return None
        dates = [strict_datetime(v) for v in value]
        if all(map(_number, value)):
            flag = _numbers(op, list(value), unit)
        elif all(dates):
            flag = _dates(op, dates)
        elif all(isinstance(v, str) for v in value):
            flag = text.between(*value) if op == "BETWEEN" else ~text.between(*value)
    elif op in ("IN", "NOT IN"):
        if not (isinstance(value, (list, tuple)) and value):
            return None
        if all(map(_number, value)):
            flag = _numbers(op, list(value), unit)
        elif all(isinstance(v, str) for v in value):
            flag = text.isin(list(value)) if op == "IN" else ~text.isin(list(value))
            flag = flag | _by_meaning(leaf, vector, op == "NOT IN")
    elif op in ("IS NULL", "IS NOT NULL"):
        flag = text.isNull() if op == "IS NULL" else text.isNotNull()
    elif isinstance(value, (list, tuple)):
        return None
    elif (op in ("LIKE", "ILIKE") or op == "=" and isinstance(value, str)) and strict_datetime(value) is None:
        score = F.when(text.ilike(pattern_of(f"{value}%")), 2).when(text.ilike(pattern_of(f"%{value}%")) | _by_meaning(leaf, vector), 1).otherwise(0)
        return F.when(F.col("key").isin(_names(leaf)), score).otherwise(0)
    elif (op in ("NOT LIKE", "NOT ILIKE") or op == "!=" and isinstance(value, str)) and strict_datetime(value) is None:
        flag = ~text.ilike(pattern_of(f"%{value}%")) | _by_meaning(leaf, vector, far=True)
    elif op in COMPARE:
        if (moment := strict_datetime(value)) is not None:
            flag = _dates(op, [moment])
        elif isinstance(value, bool):
            flag = COMPARE[op](F.col("value_boolean"), F.lit(value)) if op in ("=", "!=") else None
        elif _number(value):
            flag = _numbers(op, [value], unit)
    if flag is None:
        return None
    return F.when(F.col("key").isin(_names(leaf)) & flag, 1).otherwise(0)


class Conditions:
    """A tree of conditions: its valid leaves, numbered densely, and its truth by their flags.

    A node is {logic, conditions}, a leaf {name, operator, value, unit?}.
    Leaves that are not valid vanish, they do not make an AND false; a node
    with one child is that child; nothing left is false.
    """

    def __init__(self, tree: dict | None, vectors: dict[int, Sequence[float]] | None = None):
        self.scores: list[Column] = []
        self.names: set[str] = set()
        self._vectors = vectors or {}
        self._tree, self._row = tree, None
        self.truth = self._walk(tree) if tree else None

    def _walk(self, node: dict) -> Column | None:
        if "logic" in node and "conditions" in node:
            parts = [t for t in (self._walk(c) for c in node["conditions"] if isinstance(c, dict)) if t is not None]
            if not parts:
                return None
            return reduce(Column.__or__ if str(node["logic"]).upper() == "OR" else Column.__and__, parts)
        score = leaf_score(node, self._vectors.get(id(node)))
        if score is None:
            return None
        self.scores.append(score)
        self.names.update(_names(node))
        return self._flag(len(self.scores))

    def _flag(self, n: int) -> Column:
        return (F.col(f"has_condition_{n}") if self._row is None else self._row[f"has_condition_{n}"]) > 0

    def truth_of(self, row: Column) -> Column:
        """The tree's truth by the flags in a struct."""
        again = Conditions(None, self._vectors)
        again._row = row
        return again._walk(self._tree)

    @property
    def active(self) -> bool:
        return bool(self.scores)

    def flags(self, attributes: DataFrame, doc_col: str = "doc_id") -> DataFrame:
        """`doc_col, has_condition_1 ...`: all leaves in one pass, documents without any flag left out.

        Only rows of the named keys are read; the maxima are taken before the
        shuffle, so a document with very many attributes is no hot task.
        """
        rows = attributes.filter(F.col("key").isin(sorted(self.names)))
        every = [f"has_condition_{i + 1}" for i in range(len(self.scores))]
        found = rows.groupBy(doc_col).agg(*[F.max(s).alias(n) for s, n in zip(self.scores, every)])
        return found.filter(reduce(Column.__or__, [F.col(n) > 0 for n in every]))


def rank_conditions(attributes: DataFrame, tree: dict, doc_col: str = "doc_id", vectors: dict[int, Sequence[float]] | None = None) -> DataFrame:
    """`doc_col, full_match, partial_match_count, partial_rank` for documents that meet a condition.

    full_match is 1 where the tree holds; the rank is dense over the sum of
    the flags, the largest first. The ranks of the few sums are found apart
    and joined back, so no window gathers all documents. Without a valid leaf
    the result is empty; documents with a null id are left out.
    """
    c = Conditions(tree, vectors)
    if not c.active:
        empty = attributes.select(F.col(doc_col)).limit(0)
        return empty.select(doc_col, F.lit(0).alias("full_match"), F.lit(0).alias("partial_match_count"), F.lit(0).alias("partial_rank"))
    total = reduce(Column.__add__, [F.col(f"has_condition_{i + 1}") for i in range(len(c.scores))])
    found = c.flags(attributes.filter(F.col(doc_col).isNotNull()), doc_col)
    found = found.select(doc_col, c.truth.cast("int").alias("full_match"), total.alias("partial_match_count"))
    sums = found.select("partial_match_count").distinct()  # two values a leaf at most
    ranks = sums.select("partial_match_count", F.dense_rank().over(W.orderBy(F.desc("partial_match_count"))).alias("partial_rank"))
    return found.join(F.broadcast(ranks), "partial_match_count").select(doc_col, "full_match", "partial_match_count", "partial_rank")


def rank_condition_trees(attributes: DataFrame, trees: dict[str, dict], doc_col: str = "doc_id", vectors: dict[int, Sequence[float]] | None = None) -> DataFrame:
    """`tree_id, doc_col, full_match, partial_match_count, partial_rank` for a table of queries that name their trees.

    The leaves of all trees are flagged in one pass over the attributes, and
    each tree has a row only for documents that meet one of its conditions.
    Queries with the same filters share a tree.
    """
    parts = {t: Conditions(tree, vectors) for t, tree in trees.items()}
    parts = {t: c for t, c in parts.items() if c.active}
    if not parts:
        return rank_conditions(attributes, {}, doc_col).select(F.lit(None).cast("string").alias("tree_id"), "*")
    names, flags, rows = set().union(*(c.names for c in parts.values())), [], []
    for i, (t, c) in enumerate(parts.items()):
        own = [f"__t{i}_{k + 1}" for k in range(len(c.scores))]
        flags += [F.max(s).alias(n) for s, n in zip(c.scores, own)]
        # the tree's truth reads its flags by their plain names
        named = F.struct(*[F.col(n).alias(f"has_condition_{k + 1}") for k, n in enumerate(own)])
        rows.append(F.struct(F.lit(t).alias("tree_id"), c.truth_of(named).cast("int").alias("full_match"), reduce(Column.__add__, [F.col(n) for n in own]).alias("partial_match_count")))
    found = attributes.filter(F.col(doc_col).isNotNull() & F.col("key").isin(sorted(names))).groupBy(doc_col).agg(*flags)
    each = found.select(doc_col, F.explode(F.array(*rows)).alias("r")).select("r.tree_id", doc_col, "r.full_match", "r.partial_match_count").filter("partial_match_count > 0")
    each = written(each, "trees")
    sums = each.select("tree_id", "partial_match_count").distinct()  # two values a leaf at most
    ranks = sums.withColumn("partial_rank", F.dense_rank().over(W.partitionBy("tree_id").orderBy(F.desc("partial_match_count"))))
    return each.join(F.broadcast(ranks), ["tree_id", "partial_match_count"]).select("tree_id", doc_col, "full_match", "partial_match_count", "partial_rank")


def condition_vectors(values: DataFrame, cond_col: str = "cond_id", vector_col: str = "value_vector") -> DataFrame:
    """`cond_col, vector`: the mean of the vectors of a condition's values."""
    cells = values.filter(F.col(vector_col).isNotNull()).select(cond_col, F.posexplode(vector_col).alias("at", "x"))
    means = cells.groupBy(cond_col, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(cond_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))
