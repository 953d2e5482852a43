"""The trie of conversations' first turns, its subtrees summed along an Euler tour."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.listrank import list_rank
from tessera.llm.ranges import bit_xor, in_ranges, running, xor
from tessera.llm.text import WORD
from tessera.session import dropped, written

#: Conversation ids that are joined in one row before they are hashed.
BLOCK = 4096
#: Places of the tour that are summed in one row, at least, and such rows at most.
PLACES, ROWS = 16_384, 10_000
NODE = ["k1", "k2", "depth"]


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv, k, role, text`: turns numbered from 0 within their conversation, sorted by turn (null first), role and text; null roles and texts are empty."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).filter("conv is not null")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = in_ranges(rows, "conv", *order, name="turns")
    # rows that are equal in all columns are interchangeable
    return running(dealt, "conv", order, {"k": F.lit(1).cast("long")}).select("conv", (F.col("k") - 1).alias("k"), "role", "text")


def _digest_of_ends(batches):
    """One row for each node from the rows of its blocks, which follow each other in order; no node is held whole."""
    node, sha = None, None
    for batch in batches:
        out = []
        for *key, ids in batch[[*NODE, "ids"]].itertuples(index=False, name=None):
            if key != node:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, sha.hexdigest())], columns=[*NODE, "ends_sha256"])


def _nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes, numbered, and the digests of the conversations that end in them."""
    text = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = turns.select("conv", "k", F.sha2(text, 256).alias("sha"), F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("words"))
    dealt = in_ranges(rows, "conv", "k", name="turns")
    placed = written(running(dealt, "conv", ["k"], {"depth": F.lit(1).cast("long")}), "placed")
    dropped(dealt)
    # a turn at its place is 128 bits; those of a prefix, put together, name its node
    own = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "sha"), 256)
    half = lambda a: F.conv(F.substring(own, a, 16), 16, -10).cast("long")
    steps = running(placed, "conv", ["k"], {"k1": half(1), "k2": half(17)}, bit_xor, xor)
    steps = written(steps.select("conv", "depth", "words", "k1", "k2", xor(F.col("k1"), half(1)).alias("p1"), xor(F.col("k2"), half(17)).alias("p2")), "steps")
    dropped(placed)

    zero = [F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "depth")]
    nodes = steps.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max(F.struct("p1", "p2")).alias("p"))
    parent = F.struct(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2")).alias("p")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(*zero, "conv", "n_convs", F.lit(0).cast("long").alias("words"), parent)
    # a node is known by the smallest conversation through it and its depth; numbers follow that order, so that they mostly follow the tour
    dealt = in_ranges(nodes.unionByName(root).withColumn("one", F.lit(1)), "conv", "depth", name="nodes")
    nodes = written(running(dealt, "one", ["conv", "depth"], {"num": F.lit(1).cast("long")}).withColumn("num", F.col("num") - 1).drop("part", "one"), "numbered")
    dropped(dealt)

    last = steps.groupBy("conv").agg(F.max(F.struct("depth", "k1", "k2")).alias("e")).select("conv", "e.k1", "e.k2", "e.depth")
    last = last.unionByName(convs.join(last.select("conv"), "conv", "left_anti").select("conv", *zero))
    blocks = last.groupBy(*NODE, F.floor(F.col("conv") / BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    ends = written(blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids").mapInPandas(_digest_of_ends, "k1 long, k2 long, depth long, ends_sha256 string"), "ends")
    dropped(steps)
    return nodes, ends


def _tour(tree: DataFrame, kids: DataFrame) -> DataFrame:
    """`arc, next`: every node's arcs in (2 num) and out (2 num + 1), each with the arc that follows."""
    into, out = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    dealt = in_ranges(tree.filter("parent_num is not null").select("num", F.col("parent_num").alias("parent")), "parent", "num", name="siblings")
    elder = running(dealt, "parent", ["num"], {"elder": F.col("num")}, F.max, F.greatest, inclusive=False).filter("elder is not null")
    row = lambda df, a, b: df.select(a.alias("arc"), b.alias("next"))
    every = [
        row(elder, out("elder"), into("num")),
        row(kids, into("parent"), into("first")),
        row(kids, out("final"), out("parent")),
        row(tree.filter("n_children = 0"), into("num"), out("num")),
        row(tree.filter("parent_num is null"), out("num"), F.lit(-1).cast("long")),
    ]
    whole = every[0]
    for more in every[1:]:
        whole = whole.unionByName(more)
    return whole


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """A row for each distinct sequence of first turns, from the empty one: `conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`.

    `turns(conv, k, role, text)` as `numbered_turns` gives it; `convs(conv)`
    names conversations that may have no turn (those of `turns` are known
    anyway). A node is named by the smallest conversation through it and its
    depth. `n_leaves` are the childless nodes of its subtree, itself included;
    `saved_tokens` sums over the subtree the words of each node's text times
    the conversations through it beyond the first; `ends_sha256` hashes the
    ids of the conversations that end there, ascending.

    Prefixes are told apart by 128 bits of SHA-256 for each turn at its place.
    The tree's Euler tour is a list of arcs, two for each node; its ranking
    gives every arc a place, and sums over places, taken at both arcs of a
    node, give its subtree's.

    A null role or text is empty, a row of a null conversation or a null `k`
    is left out, rows equal in conversation and `k` stand by their texts'
    hashes, an empty table gives no rows. Other columns are not looked at. No
    conversation, node or set of siblings has to fit into one task; the ids
    that end in one node are hashed one after another by one task, in blocks.
    """
    turns = turns.select(F.col("conv").cast("long").alias("conv"), "k", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv is not null and k is not null")
    known = turns.select("conv")
    if convs is not None:
        known = known.unionByName(convs.select(F.col("conv").cast("long").alias("conv")).filter("conv is not null"))
    nodes, ends = _nodes(turns, written(known.distinct(), "convs"))

    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("num").alias("parent_num"), F.col("conv").alias("parent_conv"))
    # written before it is used further, so that Spark can split the children of one node
    kept = ["k1", "k2", "depth", "num", "conv", "n_convs", "words"]
    linked = written(nodes.filter("depth > 0").select(*kept, "p.p1", "p.p2").join(above, ["p1", "p2", "depth"]).select(*kept, "parent_num", "parent_conv"), "linked")
    root = nodes.filter("depth = 0").select(*kept, F.lit(None).cast("long").alias("parent_num"), F.lit(None).cast("long").alias("parent_conv"))
    kids = written(linked.groupBy(F.col("parent_num").alias("parent")).agg(F.min("num").alias("first"), F.max("num").alias("final"), F.count("*").alias("n_children")), "kids")
    tree = linked.unionByName(root).join(kids.select(F.col("parent").alias("num"), "n_children"), "num", "left")
    tree = written(tree.join(ends, NODE, "left").select(*kept, "parent_num", "parent_conv", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")), "tree")
    for table in (nodes, linked, ends):
        dropped(table)

    ranked = list_rank(_tour(tree, kids))
    dropped(kids)
    worth = tree.select("num", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    per = F.lit(max(PLACES, -(-2 * tree.count() // ROWS)))
    # every node's worth stands at its arc in
    steps = ranked.select(F.expr("shiftright(arc, 1)").alias("num"), "pos", (F.col("arc") % 2 == 0).alias("enters")).join(worth, "num")
    at = lambda c: F.when(F.col("enters"), F.col(c)).otherwise(0)
    steps = written(steps.select("num", "pos", "enters", at("leaf").alias("leaf"), at("saved").alias("saved"), F.call_function("div", F.col("pos"), per).alias("part")), "tour")
    totals = steps.groupBy("part").agg(F.sum("leaf").alias("leaf_before"), F.sum("saved").alias("saved_before"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("leaf_before", "saved_before")])
    inside = W.partitionBy("part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    sums = steps.select("num", "enters", "leaf", "saved", "part", *[F.sum(c).over(inside).alias(f"{c}_upto") for c in ("leaf", "saved")]).join(F.broadcast(totals), "part")
    # what the arc out has summed beyond the arc in, and the node's own
    span = lambda c: F.sum(F.when(F.col("enters"), F.col(c) - F.col(f"{c}_upto") - F.col(f"{c}_before")).otherwise(F.col(f"{c}_upto") + F.col(f"{c}_before")))
    below = sums.groupBy("num").agg(span("leaf").alias("n_leaves"), span("saved").alias("saved_tokens"))
    return tree.join(below, "num").select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
