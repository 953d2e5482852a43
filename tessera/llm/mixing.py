"""Mixing sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.text import WORD, columns_of, whole_row
from tessera.session import written

#: Parts of the seeded order; only the part in which a quota ends is sorted.
PARTS = 4096


def size_in_words(text: Column) -> Column:
    """The words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (3, 1, 2), budget_percent: int = 150, max_uses: int = 2) -> dict[str | None, float]:
    """Words wanted of each source.

    The budget is shared by weight; weights repeat over the sources in the
    order of their code points, null last. No target goes beyond `max_uses`
    times its source's size: what is above is shared again among the rest.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, free, out = budget_percent * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if rest * weight[s] > 100 * max_uses * sizes[s] * total]
        if not full:
            return out | {s: rest * weight[s] / (100 * total) for s in free}
        for s in full:
            out[s] = float(max_uses * sizes[s])
            rest -= 100 * max_uses * sizes[s]
            free.remove(s)
    return out


@dataclass
class Flow:
    """Words that go from each pattern of sources to each of its sources."""

    sizes: dict[tuple, int]
    quotas: dict[str | None, int]
    max_uses: int
    routed: dict[tuple, dict[str | None, int]] = field(default_factory=dict)

    def solve(self) -> Flow:
        """The cheapest flow among the largest.

        A pattern's words cost more at each further use, and only the arcs into
        patterns cost anything. So the cheapest augmenting paths are those that
        start at a pattern with words left at the lowest use that is open: uses
        are opened one after another, and each is filled by shortest paths.
        """
        self.routed = {p: dict.fromkeys(p, 0) for p in self.sizes}
        left = dict(self.quotas)
        of: dict[str | None, list[tuple]] = {}
        for p in self.sizes:
            for s in p:
                of.setdefault(s, []).append(p)
        for _ in range(self.max_uses):
            for p in self.sizes:
                room = self.sizes[p]
                while room and (path := self._path(p, left, of)):
                    step = min(room, left[path[-1]], *(self.routed[path[i]][path[i - 1]] for i in range(2, len(path), 2)))
                    for i in range(0, len(path) - 1, 2):
                        self.routed[path[i]][path[i + 1]] += step
                        if i:
                            self.routed[path[i]][path[i - 1]] -= step
                    left[path[-1]] -= step
                    room -= step
        return self

    def _path(self, start: tuple, left: dict, of: dict) -> list | None:
        """pattern, source, pattern, source ...: ends at a source with quota left."""
        came: dict = {}
        todo, seen = deque([start]), {start}
        while todo:
            p = todo.popleft()
            for s in p:
                if s in came:
                    continue
                came[s] = p
                if left.get(s, 0) > 0:
                    path = [s]
                    while (q := came[path[0]]) != start:
                        path = [self._via[q], q, *path]
                    return [start, *path]
                for q in of[s]:
                    if q not in seen and self.routed[q][s] > 0:
                        seen.add(q)
                        self._via[q] = s
                        todo.append(q)
        return None

    _via: dict = field(default_factory=dict)


def _sorted_sources(sources: Column) -> Column:
    """The sources of a row as canonical JSON; a null array is no source at all."""
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))), {"ignoreNullFields": "false"})


def mix(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = (3, 1, 2), budget_percent: int = 150, max_uses: int = 2, seed: int = 17, max_patterns: int = 10_000) -> DataFrame:
    """`id_col, size, sources, uses, taken, source_sizes, targets` for every row.

    `sources` is an array column: the sources that a row belongs to. Rows are
    summed by this pattern; the patterns (at most `max_patterns`, else an
    error) go to the driver, where a min-cost flow routes their words to the
    sources' quotas. A pattern from which the flow takes k whole uses and a
    part gives every row k times, and once more the rows that come first in a
    seeded order until the part is reached; at last the one row whose size
    comes nearest to what is missing. No row is used over `max_uses` times.

    Null texts have no words and are never missed. A null source is a source
    of its own; a row with a null or empty array belongs to none and is not
    used. The order is that of a hash of seed, id and text, so rows may share
    an id; rows equal in both are interchangeable, and the quota may end among
    them. An empty table gives no rows. Nothing else depends on partitions or
    order, so reruns agree.
    """
    return _mixed(docs, sources, id_col, text_col, weights, budget_percent, max_uses, seed, max_patterns).select(F.col("__id").alias(id_col), "size", "sources", "uses", "taken", "source_sizes", "targets")


def _mixed(docs: DataFrame, sources: Column, id_col: str, text_col: str, weights: tuple[int, ...] = (3, 1, 2), budget_percent: int = 150, max_uses: int = 2, seed: int = 17, max_patterns: int = 10_000, row: Column | None = None) -> DataFrame:
    """What `mix` gives with `__id` for the id, and `__row` if one is asked for."""
    own = [] if row is None else [row.alias("__row")]
    kept = [] if row is None else ["__row"]
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    # the tie-break is written with the rows: it parts rows that are equal in id and text
    base = docs.select(F.col(id_col).alias("__id"), size_in_words(F.col(text_col)).alias("size"), _sorted_sources(sources).alias("pattern"), F.md5(name.cast("binary")).alias("h"), F.monotonically_increasing_id().alias("tie"), *own)
    base = written(base.withColumn("part", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")), "mix")
    found = base.groupBy("pattern").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"over {max_patterns} patterns of sources")
    sizes = {tuple(json.loads(r["pattern"])): r["n"] for r in found}
    by_source: dict[str | None, int] = {}
    for p, n in sizes.items():
        for s in p:
            by_source[s] = by_source.get(s, 0) + n
    wanted = targets(by_source, weights, budget_percent, max_uses)
    flow = Flow(sizes, {s: round(t) for s, t in wanted.items()}, max_uses).solve().routed
    plan = []
    for r in found:
        p = tuple(json.loads(r["pattern"]))
        n, got = r["n"], sum(flow[p].values())
        plan.append((r["pattern"], list(p), got // n if n else 0, got % n if n else 0, [by_source[s] for s in p], [wanted[s] for s in p]))
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(plan, "pattern string, sources array<string>, whole long, rest long, source_sizes array<long>, targets array<double>"))

    run = W.partitionBy("pattern").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = base.groupBy("pattern", "part").agg(F.sum("size").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).join(plan.select("pattern", "rest"), "pattern")
    ends = parts.filter("before <= rest and rest < before + n").groupBy("pattern").agg(F.max_by("part", "part").alias("cut"), F.max_by("before", "part").alias("before"), F.first("rest").alias("rest"))
    # one row for each pattern; only the rows of a pattern's cut part are sorted
    inner = base.join(F.broadcast(ends), "pattern").filter("part = cut")
    upto = F.col("before") + F.sum("size").over(W.partitionBy("pattern").orderBy("h", "size", "tie").rowsBetween(W.unboundedPreceding, 0))
    place = F.struct("h", "size", "tie")
    inner = inner.select("pattern", "cut", "rest", "before", place.alias("place"), upto.alias("upto")).withColumn("in", F.col("upto") <= F.col("rest"))
    upper = inner.groupBy("pattern").agg(F.first("cut").alias("cut"), F.max(F.when(F.col("in"), F.col("place"))).alias("last"), (F.first("rest") - F.greatest(F.first("before"), F.max(F.when(F.col("in"), F.col("upto"))))).alias("gap"))
    upper = written(upper, "mix-ends")
    more = F.coalesce((F.col("part") < F.col("cut")) | (F.col("part") == F.col("cut")) & (place <= F.col("last")), F.lit(False))
    staged = base.join(F.broadcast(upper), "pattern", "left").withColumn("more", more)

    off = F.abs(F.col("gap") - F.col("size"))
    fill = staged.filter(~F.col("more") & (off < F.col("gap"))).groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "h", "size", "tie")).alias("f")).select("pattern", F.col("f.tie").alias("fill"))
    done = staged.join(F.broadcast(fill), "pattern", "left").join(plan.drop("rest"), "pattern")
    uses = F.col("whole") + F.when(F.col("more") | F.coalesce(F.col("tie") == F.col("fill"), F.lit(False)), 1).otherwise(0)
    return done.select("__id", "size", "sources", uses.cast("int").alias("uses"), (F.col("size") * uses).alias("taken"), "source_sizes", "targets", *kept)


def mixed_rows(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` as often as the mix uses them, with their own columns alone.

    Every row goes with its own number of uses; no join by id tells rows apart.
    """
    rows = _mixed(docs, sources, id_col, text_col, row=whole_row(docs), **options).filter("uses > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), "uses"))).select(*columns_of("__row", docs))
