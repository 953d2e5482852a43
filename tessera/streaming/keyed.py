"""A table in buckets of its keys, with a manifest of what is current and a filter of the keys in each part."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.tables import first_wins, latest_wins

#: Bits of a filter for each key, and places that a key sets: one key in a hundred that is not there seems to be.
BITS, PLACES = 10, 7
BUCKET = "__bucket"


@dataclass
class Manifest:
    """What is current: for each bucket the commits whose parts it consists of, and the last batch that is in it."""

    number: int = -1
    batch: int = -1
    parts: dict[int, list[str]] = field(default_factory=dict)


class _Files:
    """The file system that a path lies in."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        where = self.at(name)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> bool:
        """Writes a file whole under its name; False if it is there already."""
        draft = self.at(f"_draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(draft, self.at(name)):
            self.fs.delete(draft, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _hits(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """The places that each of some 64-bit hashes sets in a filter, keys x places."""
    h = keys.view(np.uint64)
    step = ((h >> np.uint64(32)) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step ^= step >> np.uint64(29)
    return ((h[:, None] + np.arange(PLACES, dtype=np.uint64) * step[:, None]) % np.uint64(n_bits)).astype(np.int64)


def filter_of(keys: np.ndarray) -> bytes:
    """A Bloom filter of some 64-bit hashes."""
    n_bits = 8 * max(8, -(-BITS * len(keys) // 8))
    bits = np.zeros(n_bits, np.uint8)
    bits[_hits(keys, n_bits).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which hashes a filter does not rule out."""
    own = np.unpackbits(np.frombuffer(bits, np.uint8))
    return own[_hits(keys, len(own))].all(axis=1)


class KeyedTable:
    """Rows under `path`, told apart by `keys`, in `buckets` by the hash of their keys.

    A commit writes new parts of the buckets that it touches, then a manifest
    that names the parts of every bucket; a part that no manifest names does
    not count. So a commit is there whole or not at all, readers keep what
    they began with, and a batch that is run again after a failure changes
    nothing twice. After a commit what neither the last manifest nor the one
    before it names is removed, so the number of files is bounded: a bucket has
    `most` parts at most, then it is written as one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema, buckets: int = 64, most: int = 8):
        self.spark, self.keys, self.buckets, self.most = spark, list(keys), buckets, most
        self.files = _Files(spark, path)
        self.schema = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema

    def manifest(self) -> Manifest:
        found = sorted(n for n in self.files.names("_manifest") if n.endswith(".json"))
        if not found:
            return Manifest()
        said = json.loads(self.files.read(f"_manifest/{found[-1]}"))
        return Manifest(int(found[-1][:-5]), said["batch"], {int(b): p for b, p in said["parts"].items()})

    def rows(self, only: dict[int, list[str]] | None = None) -> DataFrame:
        """All rows, or those of some parts; files of other parts are not opened."""
        parts = self.manifest().parts if only is None else only
        paths = [f"{self.files.root}/data/{c}/{BUCKET}={b}" for b, commits in sorted(parts.items()) for c in commits]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _hash(self):
        return F.xxhash64(F.lit(7), *self.keys).alias("h")

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Writes rows as parts of their buckets and the filters of their keys; gives the commit's name and its buckets."""
        commit = uuid.uuid4().hex
        self._bucketed(rows).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.files.root}/data/{commit}")
        written = [int(n.split("=")[1]) for n in self.files.names(f"data/{commit}") if n.startswith(BUCKET)]
        if written:
            own = self._bucketed(self.rows({b: [commit] for b in written})).select(BUCKET, self._hash())

            def of(part: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({BUCKET: part[BUCKET].iloc[:1].to_numpy(), "bits": [filter_of(part["h"].to_numpy(np.int64))]})

            own.groupBy(BUCKET).applyInPandas(of, f"{BUCKET} int, bits binary").write.partitionBy(BUCKET).parquet(f"{self.files.root}/filters/{commit}")
        return commit, written

    def _commit(self, before: Manifest, batch: int, parts: dict[int, list[str]]) -> None:
        name = f"_manifest/{before.number + 1:012d}.json"
        if not self.files.write_once(name, json.dumps({"batch": batch, "parts": parts})):
            raise RuntimeError(f"another writer has committed {name}")
        self._clean(before.parts, parts)

    def _clean(self, *kept: dict[int, list[str]]) -> None:
        named = {(c, b) for parts in kept for b, commits in parts.items() for c in commits}
        for kind in ("data", "filters"):
            for commit in self.files.names(kind):
                own = [n for n in self.files.names(f"{kind}/{commit}") if n.startswith(BUCKET)]
                gone = [n for n in own if (commit, int(n.split("=")[1])) not in named]
                for n in [None] if len(gone) == len(own) else gone:
                    self.files.delete(f"{kind}/{commit}" + (f"/{n}" if n else ""))
        for old in sorted(n for n in self.files.names("_manifest") if n.endswith(".json"))[:-2]:
            self.files.delete(f"_manifest/{old}")

    def possible(self, new: DataFrame, parts: dict[int, list[str]]) -> dict[int, list[str]]:
        """Of some parts those whose filter does not rule out every key of `new`; filters of other buckets are not read."""
        paths = {c: [f"{self.files.root}/filters/{c}/{BUCKET}={b}" for b, commits in parts.items() if c in commits] for commits in parts.values() for c in commits}
        if not paths:
            return {}
        filters = None
        for c, own in paths.items():
            one = self.spark.read.option("basePath", f"{self.files.root}/filters/{c}").schema(f"bits binary, {BUCKET} int").parquet(*own).withColumn("commit", F.lit(c))
            filters = one if filters is None else filters.unionByName(one)

        def of(keys: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            h = np.unique(keys["h"].to_numpy(np.int64)) if len(keys) else np.zeros(0, np.int64)
            hit = [len(h) > 0 and may_hold(bits, h).any() for bits in own["bits"]]
            return own.loc[hit, [BUCKET, "commit"]]

        asked = self._bucketed(new).select(BUCKET, self._hash()).distinct()
        met = asked.groupBy(BUCKET).cogroup(filters.groupBy(BUCKET)).applyInPandas(of, f"{BUCKET} int, commit string")
        out: dict[int, list[str]] = {}
        for r in met.collect():  # a row for each part at most: `buckets` times `most`
            out.setdefault(r[BUCKET], []).append(r["commit"])
        return out

    def _touched(self, df: DataFrame) -> list[int]:
        return [r[0] for r in self._bucketed(df).select(BUCKET).distinct().collect()]  # `buckets` at most

    def insert(self, new: DataFrame, batch: int, order: list[str]) -> None:
        """Adds rows of keys that are not there; of each key the first by `order`. Only parts whose filter may hold one of the keys are opened."""
        now = self.manifest()
        if batch <= now.batch:
            return
        touched = {b: now.parts[b] for b in self._touched(new) if b in now.parts}
        own = first_wins(new, self.keys, order, self.rows(self.possible(new, touched)))
        commit, written = self._write(own.select(*self.schema.fieldNames()))
        parts = dict(now.parts)
        for b in written:
            parts[b] = [*parts.get(b, []), commit]
        full = {b: p for b, p in parts.items() if len(p) > self.most}
        if full:
            merged, _ = self._write(self.rows(full))
            parts |= {b: [merged] for b in full}
        self._commit(now, batch, parts)

    def upsert(self, new: DataFrame, batch: int, order: list[str]) -> None:
        """Puts the last row by `order` of each key in place of what is there; buckets without such a key are not read."""
        now = self.manifest()
        if batch <= now.batch:
            return
        before = self.rows({b: now.parts[b] for b in self._touched(new) if b in now.parts})
        commit, written = self._write(latest_wins(before.unionByName(new.select(*self.schema.fieldNames())), self.keys, order))
        self._commit(now, batch, now.parts | {b: [commit] for b in written})
