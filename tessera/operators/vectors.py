"""Vector similarity joins and the rankings made of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import written

#: Bytes of vectors in a block, and of all queries up to which they are sent to every task.
BLOCK_BYTES, BROADCAST_BYTES = 4 << 20, 64 << 20
#: Distances that are held at once.
CELLS = 2_000_000
DECIMALS = 6
#: Directions by which vectors are parted, vectors that they are found from, and how much a bound gives way to rounding.
CENTRES, SAMPLE, MARGIN = 64, 2048, 1e-5


def _unit(vectors) -> np.ndarray:
    """Vectors of length 1 as rows; NaN for those of length 0."""
    m = np.stack([np.asarray(v, float) for v in vectors])
    length = np.linalg.norm(m, axis=1)
    return m / np.where(length > 0, length, np.nan)[:, None]


def centres_of(sample: np.ndarray, n: int = CENTRES) -> np.ndarray:
    """Up to `n` directions around which the sample's vectors lie: each new one the vector farthest from those before, then a few rounds of means."""
    sample = sample[~np.isnan(sample).any(axis=1)]
    if not len(sample):
        return np.zeros((1, 1))
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    centres = sample[chosen]
    for _ in range(4):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def caps(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of length 1 parted by their nearest centre: their order, where each part begins, and the direction and angle of the cap that it lies in."""
    own = (units @ centres.T).argmax(axis=1)
    order = np.argsort(own, kind="stable")
    starts = np.flatnonzero(np.diff(own[order], prepend=-1))
    mean = np.add.reduceat(units[order], starts, axis=0)
    length = np.linalg.norm(mean, axis=1, keepdims=True)
    mean = np.where(length > 1e-9, mean / np.where(length > 1e-9, length, 1), units[order][starts])
    sizes = np.diff(np.append(starts, len(units)))
    angle = np.arccos(np.clip((units[order] * np.repeat(mean, sizes, axis=0)).sum(axis=1), -1, 1))
    return order, starts, mean, np.maximum.reduceat(angle, starts)


def may_be_near(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """For each two caps whether vectors in them may be nearer than `threshold`: they are apart by the angle between the caps' directions less both their own."""
    apart = np.arccos(np.clip(a[2] @ b[2].T, -1, 1)) - a[3][:, None] - b[3][None, :]
    return 1 - np.cos(np.clip(apart, 0, np.pi)) < threshold + MARGIN


def similar(queries: DataFrame, corpus: DataFrame, threshold: float = 0.5, query_col: str = "query_id", query_vector: str = "intention_vector", vector_col: str = "vector", nearest: int = 0, key_col: str = "key", counted=None) -> DataFrame:
    """`query_col`, the columns of `corpus` but its vector, and `distance`, for cosine distances under `threshold`.

    Both sides are packed in blocks of `BLOCK_BYTES`; each block of the corpus
    meets each block of queries, and a task multiplies two blocks at a time.
    The queries' blocks are counted and broadcast up to `BROADCAST_BYTES`,
    beyond they are shuffled.

    Within two blocks vectors are parted by the nearest of some directions,
    and parts whose caps lie too far apart for any two of their vectors to be
    nearer than the threshold are not multiplied. The directions are found
    from `SAMPLE` vectors of the corpus at most, all that passes through the
    driver; the result does not depend on them. `counted`, a pair of
    accumulators, is told of all pairs of parts and of those left out.

    With `nearest` a block also gives each query its nearest keys (`key_col`),
    ties included: the nearest of all are among them. Then a key comes once for
    each block, with its least distance, and `corpus` may have no other column.

    Distances are rounded to six places, so equal ones tie. Null and zero
    vectors and null keys meet nothing.
    """
    wanted = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_col).alias("__q"), F.col(query_vector).cast("array<double>").alias("__v"))
    n, width = wanted.agg(F.count("*"), F.max(F.size("__v"))).first()
    per_block = max(1, BLOCK_BYTES // (8 * max(width or 1, 1)))
    n_blocks = max(1, -(-n // per_block))
    asked = wanted.groupBy(F.pmod(F.xxhash64("__q"), F.lit(n_blocks)).alias("__block")).agg(F.collect_list("__q").alias("__ids"), F.collect_list("__v").alias("__asked"))
    kept = [c for c in corpus.columns if c != vector_col]
    kinds = {c: corpus.schema[c].dataType.simpleString() for c in kept}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), per_block):
                part = batch.iloc[i : i + per_block]
                m = np.stack([np.asarray(v, float) for v in part[vector_col]])
                yield pd.DataFrame({**{c: [part[c].tolist()] for c in kept}, "__m": [m.tobytes()]})

    rows = corpus.filter(F.col(vector_col).isNotNull() & (F.col(key_col).isNotNull() if nearest else F.lit(True)))
    packed = rows.select(*kept, F.col(vector_col).cast("array<double>")).mapInPandas(pack, ", ".join([*(f"`{c}` array<{k}>" for c, k in kinds.items()), "__m binary"]))
    packed = packed.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    head = [] if nearest else rows.select(F.col(vector_col).cast("array<double>").alias("v")).limit(SAMPLE).collect()
    centres = centres_of(_unit([r["v"] for r in head])) if head else None
    met = packed.join(F.broadcast(asked) if n * (width or 0) * 8 <= BROADCAST_BYTES else asked, "__block")
    schema = ", ".join([f"`{query_col}` {queries.schema[query_col].dataType.simpleString()}", *(f"`{c}` {k}" for c, k in kinds.items()), "distance double"])

    def pruned(q: np.ndarray, ids: pd.Series, c: np.ndarray, columns: pd.DataFrame) -> Iterator[pd.DataFrame]:
        some, there = np.flatnonzero(~np.isnan(q).any(axis=1)), np.flatnonzero(~np.isnan(c).any(axis=1))
        if not len(some) or not len(there):
            return
        q, c = q[some], c[there]
        of_q, of_c = caps(q, centres), caps(c, centres)
        near = may_be_near(of_q, of_c, threshold)
        if counted is not None:
            counted[0].add(int(near.size))
            counted[1].add(int((~near).sum()))
        ends, last = np.append(of_c[1], len(c)), np.append(of_q[1], len(q))
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            mine = of_q[0][last[k] : last[k + 1]]
            other = np.concatenate([of_c[0][ends[j] : ends[j + 1]] for j in np.flatnonzero(near[k]).tolist()])
            step = max(1, CELLS // len(other))
            for i in range(0, len(mine), step):
                d = np.round(1 - q[mine[i : i + step]] @ c[other].T, DECIMALS) + 0.0
                a, b = np.nonzero(d < threshold)
                if len(a):
                    out = columns.iloc[there[other[b]]].reset_index(drop=True)
                    out.insert(0, query_col, ids.iloc[some[mine[i + a]]].to_numpy())
                    yield out.assign(distance=d[a, b])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                q, ids = _unit(row["__asked"]), pd.Series(list(row["__ids"]))
                columns = pd.DataFrame({c: list(row[c]) for c in kept})
                c = np.frombuffer(row["__m"], float).reshape(len(columns), -1)
                length = np.linalg.norm(c, axis=1)
                c = c / np.where(length > 0, length, np.nan)[:, None]
                if nearest:  # rows of a key stand together, for one minimum each
                    order = np.argsort(columns[key_col].to_numpy(), kind="stable")
                    c, columns = c[order], columns.iloc[order]
                    starts = np.flatnonzero(np.append(True, columns[key_col].to_numpy()[1:] != columns[key_col].to_numpy()[:-1]))
                    columns = columns.iloc[starts]
                elif centres is not None:
                    yield from pruned(q, ids, c, columns)
                    continue
                step = max(1, CELLS // max(len(c), 1))
                for i in range(0, len(q), step):
                    d = np.round(1 - q[i : i + step] @ c.T, DECIMALS) + 0.0
                    found = d < threshold
                    if nearest:
                        d = np.fmin.reduceat(d, starts, axis=1)
                        full = np.where(np.isnan(d), np.inf, d)
                        least = np.partition(full, min(nearest, full.shape[1]) - 1, axis=1)[:, min(nearest, full.shape[1]) - 1]
                        found = np.isfinite(full) & ((full < threshold) | (full <= least[:, None]))
                    a, b = np.nonzero(found)
                    if len(a):
                        out = columns.iloc[b].reset_index(drop=True)
                        out.insert(0, query_col, ids.iloc[a + i].to_numpy())
                        yield out.assign(distance=d[a, b])

    return met.mapInPandas(multiply, schema)


def _dense_rank(df: DataFrame, by: str, *order) -> DataFrame:
    """`df` with `rank`, dense by `order` within `by`.

    The rows are written once. Ranks are found over the distinct sort keys and
    joined back, so one query with very many candidates makes no hot window of
    all its rows, and nothing is computed twice.
    """
    named = written(df.select("*", *[c.alias(f"__o{i}") for i, (c, _) in enumerate(order)]), "ranked")
    keys = [f"__o{i}" for i in range(len(order))]
    w = W.partitionBy(by).orderBy(*[F.desc(k) if down else F.asc(k) for k, (_, down) in zip(keys, order)])
    ranks = named.select(by, *keys).distinct().withColumn("rank", F.dense_rank().over(w))
    return named.join(ranks, [by, *keys]).drop(*keys)


def rank_documents(queries: DataFrame, docs: DataFrame, threshold: float = 0.5, query_col: str = "query_id", doc_col: str = "doc_id", query_vector: str = "intention_vector", vector_col: str = "vector") -> DataFrame:
    """`query_col, doc_col, distance, rank`: documents nearer than `threshold`, densely ranked."""
    near = similar(queries, docs.select(doc_col, vector_col), threshold, query_col, query_vector, vector_col)
    return _dense_rank(near, query_col, (F.col("distance"), False))


def rank_chunks(queries: DataFrame, chunks: DataFrame, threshold: float = 0.5, query_col: str = "query_id", doc_col: str = "doc_id", query_vector: str = "intention_vector", vector_col: str = "vector") -> DataFrame:
    """`query_col, doc_col, distance, chunk_count, rank`: documents by their best chunk, then by how many qualify."""
    near = similar(queries, chunks.select(doc_col, vector_col), threshold, query_col, query_vector, vector_col)
    best = near.groupBy(query_col, doc_col).agg(F.min("distance").alias("distance"), F.count("*").alias("chunk_count"))
    return _dense_rank(best, query_col, (F.col("distance"), False), (F.col("chunk_count"), True))


def _by_key(keys: DataFrame, descriptions: DataFrame | None, name_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """`key, said, v` of keys' names and, where `said`, of their descriptions, and the width of the vectors."""
    both = keys.select("key", F.lit(False).alias("said"), F.col(vector_col).cast("array<double>").alias("v"))
    if descriptions is not None:
        both = both.unionByName(descriptions.select("key", F.lit(True).alias("said"), F.col(vector_col).cast("array<double>").alias("v")))
    both = both.filter("key is not null and v is not null")
    return both, both.agg(F.max(F.size("v"))).first()[0] or 1


def resolve_names(names: DataFrame, keys: DataFrame, descriptions: DataFrame | None = None, threshold: float = 0.5, least: int = 4, name_col: str = "name", vector_col: str = "vector") -> DataFrame:
    """`name_col, key` for every non-empty raw name.

    All keys whose name or description is nearer than `threshold`, filled up
    to `least` with the next nearest key names; the raw name itself if there
    is no key at all. `keys` is (key, vector), `descriptions` the same.

    Where names have very many keys the hits are most of the result, so they
    are neither shuffled nor written: all vectors of a key stand in one block,
    where it is a hit once or not at all. Blocks are met twice, first for the
    number of a name's hits and its nearest other keys, `least` of a block,
    then for the hits themselves. Keys of more vectors than a block holds stand
    in several; their hits are made distinct by a shuffle of theirs alone.
    """
    asked = written(names.filter(F.trim(F.coalesce(name_col, F.lit(""))) != "").dropDuplicates([name_col]), "names")
    both, width = _by_key(keys, descriptions, name_col, vector_col)
    per_block = max(1, BLOCK_BYTES // (8 * width))
    counts = written(both.groupBy("key").count(), "vectors-of-keys")
    total, largest = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    queries = asked.filter(F.col(vector_col).isNotNull()).select(F.col(name_col).alias("__q"), F.col(vector_col).cast("array<double>").alias("__v"))
    n = queries.count()
    n_blocks, parts = max(1, -(-n // per_block)), max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // per_block))
    blocks = queries.groupBy(F.pmod(F.xxhash64("__q"), F.lit(n_blocks)).alias("__block")).agg(F.collect_list("__q").alias("__ids"), F.collect_list("__v").alias("__asked"))

    q_kind, key_kind = names.schema[name_col].dataType.simpleString(), keys.schema["key"].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by key in blocks; a key's rows are not parted if there are no more than a block holds."""
        held, last = [], None

        def block(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"keys": [part["key"].tolist()], "said": [part["said"].tolist()], "m": [np.stack([np.asarray(v, float) for v in part["v"]]).tobytes()]})

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < 2 * per_block:
                continue
            rows = pd.concat(held, ignore_index=True)
            while len(rows) >= 2 * per_block:
                new = np.flatnonzero(rows["key"].to_numpy()[1:] != rows["key"].to_numpy()[:-1]) + 1
                cut = int(new[new <= per_block].max()) if (new <= per_block).any() else per_block
                yield block(rows.iloc[:cut])
                rows = rows.iloc[cut:].reset_index(drop=True)
            held = [rows]
        rows = pd.concat(held, ignore_index=True) if held else None
        if rows is not None and len(rows):
            yield block(rows)

    def nearness(row: dict) -> Iterator[tuple]:
        """Names of a pair of blocks, a few at a time, their keys, which are hits, and how near the keys' names are."""
        q, ids, said = _unit(row["__asked"]), np.array(row["__ids"], object), np.array(row["said"], bool)
        c = np.frombuffer(row["m"], float).reshape(len(said), -1)
        length = np.linalg.norm(c, axis=1)
        c = c / np.where(length > 0, length, np.nan)[:, None]
        own = np.array(row["keys"], object)
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        step = max(1, CELLS // len(own))
        for i in range(0, len(q), step):
            d = np.round(1 - q[i : i + step] @ c.T, DECIMALS) + 0.0
            hit = np.logical_or.reduceat(d < threshold, starts, axis=1)
            named = np.fmin.reduceat(np.where(said, np.nan, d), starts, axis=1)
            yield ids[i : i + step], own[starts], hit, named

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The number of a name's hits, and its nearest keys that are no hits, ties included."""
        for batch in batches:
            for row in batch.to_dict("records"):
                for ids, own, hit, named in nearness(row):
                    yield pd.DataFrame({"q": ids, "key": None, "distance": None, "hits": hit.sum(axis=1)})
                    rest = np.where(hit | np.isnan(named), np.inf, named)
                    if least and rest.shape[1]:
                        at = np.partition(rest, min(least, rest.shape[1]) - 1, axis=1)[:, min(least, rest.shape[1]) - 1]
                        found = np.isfinite(rest) & (rest <= at[:, None])
                        if found.sum() > 4 * least * len(ids):  # of very many that tie the first keys are enough
                            tied = found & (rest == at[:, None])
                            found &= ~tied | (tied.cumsum(axis=1) <= least)
                        a, b = np.nonzero(found)
                        yield pd.DataFrame({"q": ids[a], "key": own[b], "distance": rest[a, b], "hits": 0})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                for ids, own, hit, _ in nearness(row):
                    a, b = np.nonzero(hit)
                    yield pd.DataFrame({"q": ids[a], "key": own[b]})

    def met(rows: DataFrame, name: str) -> DataFrame:
        packed = written(rows.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(pack, f"keys array<{key_kind}>, said array<boolean>, m binary"), name)
        tiled = packed.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        return tiled.join(F.broadcast(blocks) if n * width * 8 <= BROADCAST_BYTES else blocks.hint("merge"), "__block")

    big = counts.filter(F.col("count") > per_block).select("key")
    tiles = met(both.join(big, "key", "left_anti") if largest > per_block else both, "blocks")
    seen = tiles.mapInPandas(sums, f"q {q_kind}, key {key_kind}, distance double, hits long")
    hits = tiles.mapInPandas(each, f"q {q_kind}, key {key_kind}")
    if largest > per_block:
        far, near = _large_keys(asked, keys.join(big, "key", "left_semi"), descriptions.join(big, "key", "left_semi") if descriptions is not None else None, threshold, least, name_col, vector_col)
        seen = seen.unionByName(far).unionByName(near.groupBy("q").agg(F.count("*").alias("hits")).select("q", F.lit(None).cast(key_kind).alias("key"), F.lit(None).cast("double").alias("distance"), "hits"))
        hits = hits.unionByName(near)
    first = F.row_number().over(W.partitionBy("q").orderBy("distance", "key"))
    seen = written(seen.filter("key is not null or hits > 0"), "seen")
    n_hits = seen.groupBy("q").agg(F.sum("hits").alias("n"))
    fill = seen.filter("key is not null").withColumn("place", first).filter(F.col("place") <= least).join(n_hits, "q").filter(F.col("place") <= F.lit(least) - F.col("n")).select("q", "key")
    raw = asked.select(F.col(name_col).alias("q")).join(seen.select("q").distinct(), "q", "left_anti").select("q", F.col("q").alias("key"))
    return hits.unionByName(fill).unionByName(raw).withColumnRenamed("q", name_col)


def _large_keys(asked: DataFrame, keys: DataFrame, descriptions: DataFrame | None, threshold: float, least: int, name_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Of keys that stand in several blocks: the nearest that are no hits as (q, key, distance, hits), and the hits as (q, key)."""
    best = written(similar(asked, keys.select("key", vector_col), threshold, name_col, vector_col, vector_col, nearest=least).groupBy(F.col(name_col).alias("q"), "key").agg(F.min("distance").alias("distance")), "near")
    hits = best.filter(F.col("distance") < threshold).select("q", "key")
    if descriptions is not None:
        # one row a block, name and key is enough
        said = similar(asked, descriptions.select("key", vector_col), threshold, name_col, vector_col, vector_col, nearest=1).filter(F.col("distance") < threshold)
        hits = hits.unionByName(said.select(F.col(name_col).alias("q"), "key"))
    hits = written(hits.distinct(), "hits")
    far = best.join(hits, ["q", "key"], "left_anti").withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("distance", "key"))).filter(F.col("place") <= least)
    return far.select("q", "key", "distance", F.lit(0).cast("long").alias("hits")), hits
