"""List ranking: the place of every element of one linked list that is a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import dropped, written

#: Elements that a task holds at once.
AT_ONCE = 16_384
STEP = "arc long, next long, size long, head long, offset long"


def shortened(arc: np.ndarray, after: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the list among the elements at hand become one element each, named after their first.

    Gives the head of every element, its distance from the head, and at heads
    what follows the stretch (-1: nothing) and how long it is. Distances are
    found by pointer doubling.
    """
    order = np.argsort(arc)
    at = np.searchsorted(arc, after, sorter=order)
    to = order[np.minimum(at, len(arc) - 1)]
    here = (after >= 0) & (arc[to] == after)
    head, far = np.arange(len(arc)), np.zeros(len(arc), np.int64)
    head[to[here]] = np.flatnonzero(here)
    far[to[here]] = size[here]
    while True:
        above = head[head]
        if (above == head).all():
            break
        far += far[head]
        head = above
    last = np.flatnonzero(~here)
    beyond, length = np.full(len(arc), -1, np.int64), np.zeros(len(arc), np.int64)
    beyond[head[last]] = after[last]
    length[head[last]] = far[last] + size[last]
    return head, far, beyond, length


def _contract(batches):
    rows = pd.concat(list(batches), ignore_index=True)
    if rows.empty:
        return
    arc, after, size = (rows[c].to_numpy(np.int64) for c in ("arc", "next", "size"))
    head, far, beyond, length = shortened(arc, after, size)
    for lo in range(0, len(arc), 65_536):
        k = slice(lo, lo + 65_536)
        yield pd.DataFrame({"arc": arc[k], "next": beyond[k], "size": length[k], "head": arc[head[k]], "offset": far[k]})


def _coin(c: Column, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), c) % 2 == 0


def list_rank(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """`arc, pos` for every row of `links(arc long, next long)`: the distance from the start of the list.

    Numbers are not negative, `next` is -1 at the end; there is one list, and
    each number stands in one row. In each round the rows are dealt out to
    tasks of about `at_once`, which shorten what stretches of the list they
    hold to their heads. Rows are dealt by ranges of their numbers, which
    takes nearly all where numbers follow the list; once that no longer halves
    the list, by coins: a row whose coin is 0 goes to where its follower is if
    that has coin 1, so a quarter of any list goes, whatever its order. When
    one task can hold the rest it finds the places of the heads, and the rounds
    are taken back: every element stands its distance behind its head.
    An empty table gives no rows.
    """
    now, levels, n, by_range, turn = written(links.select("arc", "next", F.lit(1).cast("long").alias("size")), "list"), [], links.count(), True, 0
    while n > 0:
        parts = -(-n // at_once)
        if parts == 1:
            dealt = now.repartition(1)
        elif by_range:
            dealt = now.repartitionByRange(parts, "arc")
        else:
            turn += 1
            meets = (F.col("next") >= 0) & _coin(F.col("arc"), turn) & ~_coin(F.col("next"), turn)
            dealt = now.withColumn("__to", F.when(meets, F.col("next")).otherwise(F.col("arc"))).repartition(parts, "__to").drop("__to")
        done = written(dealt.mapInPandas(_contract, STEP), "list")
        dropped(now)
        if parts == 1:
            levels.append(done)
            break
        heads = done.filter("arc = head").select("arc", "next", "size")
        levels.append(done)
        now = written(heads, "list")
        left = now.count()
        by_range, n = by_range and left <= n // 2, left
    if not levels:
        return now.select("arc", F.lit(0).cast("long").alias("pos"))
    pos = levels[-1].select("arc", F.col("offset").alias("pos"))
    for k, level in enumerate(reversed(levels[:-1])):
        known = pos.select(F.col("arc").alias("head"), F.col("pos").alias("head_pos"))
        # after the last round the heads are at most `at_once` rows
        found = level.select("arc", "head", "offset").join(F.broadcast(known) if k == 0 else known, "head")
        pos = written(found.select("arc", (F.col("head_pos") + F.col("offset")).alias("pos")), "list")
    return pos
