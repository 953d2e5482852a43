"""Substring dedup: documents factored greedily against indexed blocks of earlier text."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import words
from tessera.session import dropped, written

#: Words of a sampled gram of the index, against the least factor.
GRAM_SHARE = 4
#: Words of a reference block.
BLOCK = 64
#: Any two odd numbers will do: word hashes are random already.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """`base` to the powers 0 to n, and their inverses modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(2 * n, 4096) + 1, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[base] = tuple(both)
    return _POWERS[base]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    """Word to 64-bit hash; those of short words are kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, 7)
        if len(word) < 40:
            self[word] = h
        return h


_KNOWN = _Hashes()


def word_hashes(w: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    if len(_KNOWN) > 500_000:
        _KNOWN.clear()
    return np.fromiter(map(_KNOWN.__getitem__, w), np.uint64, len(w))


class Prefix:
    """Hashes of any runs of a document's words."""

    def __init__(self, hashes: np.ndarray, base: int = BASES[0]):
        power, self.inverse = _powers(base, len(hashes))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def anchors(prefix: Prefix, n: int, least: int, gram: int) -> np.ndarray:
    """For each window of `least` words the position of its smallest gram, the first of equals.

    Equal windows have it at the same place. Found by doubling the stretch
    that each position stands for.
    """
    at = np.arange(n - gram + 1)
    h = prefix.of(at, at + gram)
    have, width = 1, least - gram + 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        have += step
    return at


def _around(prefix: Prefix, n: int, at: np.ndarray, least: int, gram: int) -> np.ndarray:
    """A hash of all that a window which holds the gram can reach, cut at the document's ends."""
    left, right = np.maximum(at + gram - least, 0), np.minimum(at + least, n)
    lengths = ((at - left) * 4096 + (right - at)).astype(np.uint64)
    return prefix.of(left, right) ^ _mixed(lengths)


def _grams(batches: Iterator[pd.DataFrame], least: int, gram: int) -> Iterator[pd.DataFrame]:
    """Per document: words, the hash of all of them, and its anchors."""
    for batch in batches:
        rows = []
        for text in batch["text"]:
            w = words(text)
            pos = grams = around = np.zeros(0, np.int64)
            if len(w) >= least:
                prefix = Prefix(word_hashes(w))
                pos = np.unique(anchors(prefix, len(w), least, gram))
                grams = prefix.of(pos, pos + gram).view(np.int64)
                around = _around(prefix, len(w), pos, least, gram).view(np.int64)
            rows.append((sha256(b" ".join(w)).digest(), len(w), pos.astype(np.int32), grams, around))
        found = pd.DataFrame(rows, columns=["sha", "n", "pos", "gram", "around"])
        yield pd.concat([batch[["id", "key"]].reset_index(drop=True), found], axis=1)


def _windows(batches: Iterator[pd.DataFrame], least: int, gram: int) -> Iterator[pd.DataFrame]:
    """The windows that anchors alone do not decide, by two hashes each."""
    for batch in batches:
        out = []
        for i, key, text, pos, state in zip(batch["id"], batch["key"], batch["text"], batch["pos"], batch["state"]):
            w = words(text)
            hashes = word_hashes(w)
            open_ = _decided(Prefix(hashes), len(w), least, gram, pos, state)[2]
            if len(open_):
                one, two = (Prefix(hashes, b).of(open_, open_ + least).view(np.int64) for b in BASES)
                out.append(pd.DataFrame({"id": i, "key": key, "start": open_.astype(np.int32), "one": one, "two": two}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _decided(prefix: Prefix, n: int, least: int, gram: int, pos, state) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of each window, the starts that repeat earlier text for sure, and those that must be looked up.

    `pos` and `state` hold the anchors whose gram stands in several documents:
    0 it differs around, 1 it is the same around everywhere and first stands
    here, 2 it is the same and stands earlier.
    """
    of = np.full(n, 3, np.int8)  # in this document alone
    of[np.asarray(pos, np.int64)] = np.asarray(state, np.int64)
    anchor = anchors(prefix, n, least, gram)
    return anchor, np.flatnonzero(of[anchor] == 2), np.flatnonzero(of[anchor] == 0)


def greedy_factors(start: np.ndarray, ref: np.ndarray, at: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """The parse as (from, length, reference, place in it): each factor as long as it follows one reference.

    Window `start[i]` first stands in document `ref[i]` at word `at[i]`. The
    next factor begins at the last window that leaves no covered word out, so
    factors overlap at their boundaries as little as may be.
    """
    out: list[tuple[int, int, int, int]] = []
    if not len(start):
        return out
    breaks = (np.diff(start) != 1) | (np.diff(ref) != 0) | (np.diff(at) != 1)
    ends = np.append(np.flatnonzero(breaks), len(start) - 1)
    last = ends[np.searchsorted(ends, np.arange(len(start)))]
    i = 0
    while i < len(start):
        end = int(start[last[i]]) + least
        out.append((int(start[i]), end - int(start[i]), int(ref[i]), int(at[i])))
        i = max(int(last[i]) + 1, int(np.searchsorted(start, end, "right")) - 1)
    return out


def matched(w: list[bytes], factor: tuple[int, int], reference: list[bytes], least: int) -> list[tuple[int, int]]:
    """(from, to) of the stretches of `least` words or more in which a factor is its reference, word by word."""
    at, length = factor
    own = w[at : at + length]
    if own == reference:
        return [(at, at + length)]
    same = np.array([False, *(x == y for x, y in zip(own, reference)), False])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(at + a, at + b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _planned(batches: Iterator[pd.DataFrame], least: int, gram: int) -> Iterator[pd.DataFrame]:
    """Texts with the factors that the index gives them; texts without any are left out."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            w = words(r.text)
            anchor, sure, _ = _decided(Prefix(word_hashes(w)), len(w), least, gram, r.pos, r.state)
            number: dict[tuple, int] = {}
            code = lambda ids, keys: np.array([number.setdefault(x, len(number)) for x in zip(ids, keys)], np.int64)
            start, ref, at = sure, np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(sure):
                here, place = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
                later = np.asarray(r.state, np.int64) == 2
                spots = np.asarray(r.pos, np.int64)[later]
                here[spots] = code(np.asarray(r.rid)[later].tolist(), np.asarray(r.rkey)[later].tolist())
                place[spots] = np.asarray(r.rpos)[later]
                ref, at = here[anchor[sure]], place[anchor[sure]] - (anchor[sure] - sure)
            if r.starts is not None:
                start = np.concatenate([sure, np.asarray(r.starts, np.int64)])
                ref = np.concatenate([ref, code(np.asarray(r.sid).tolist(), np.asarray(r.skey).tolist())])
                at = np.concatenate([at, np.asarray(r.spos, np.int64)])
                order = np.argsort(start, kind="stable")
                start, ref, at = start[order], ref[order], at[order]
            found = greedy_factors(start, ref, at, least)
            if found:
                names = list(number)
                out.append((r.id, r.key, r.sha, r.text, [{"at": a, "len": n, "rid": names[k][0], "rkey": names[k][1], "rpos": p} for a, n, k, p in found]))
        if out:
            yield pd.DataFrame(out, columns=["id", "key", "sha", "text", "factors"])


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of reference texts that factors point into."""
    for batch in batches:
        out = []
        for i, key, text, numbers in zip(batch["rid"], batch["rkey"], batch["text"], batch["numbers"]):
            w = words(text)
            out += [(i, key, int(k), b" ".join(w[k * BLOCK : (k + 1) * BLOCK])) for k in numbers]
        if out:
            yield pd.DataFrame(out, columns=["rid", "rkey", "number", "words"])


def _parsed(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Each text's factors compared with the reference blocks, word by word; what holds becomes its spans."""
    for batch in batches:
        out = []
        for i, sha, text, factors, given in zip(batch["id"], batch["sha"], batch["text"], batch["factors"], batch["given"]):
            w, blocks = words(text), {(g["rid"], g["rkey"], g["number"]): bytes(g["words"]).split(b" ") for g in given}
            found = []
            for f in factors:
                first, n = divmod(f["rpos"], BLOCK)
                reference = [x for k in range(first, (f["rpos"] + f["len"] - 1) // BLOCK + 1) for x in blocks.get((f["rid"], f["rkey"], k), ())]
                found += matched(w, (f["at"], f["len"]), reference[n : n + f["len"]], least)
            spans = joined(found)
            keep = np.ones(len(w), bool)
            for a, b in spans:
                keep[a:b] = False
            kept = [w[k] for k in np.flatnonzero(keep).tolist()]
            out.append((i, sha, [{"from": a, "to": b} for a, b in spans], sha256(b" ".join(kept)).hexdigest()))
        yield pd.DataFrame(out, columns=["id", "sha", "spans", "kept"])


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """`id_col, n_words, spans, kept_sha256` for every row.

    spans are the (from, to) words, to exclusive, of the factors: stretches of
    `least` words or more all of whose windows also start in a document with a
    smaller id. kept_sha256 is that of the other words, joined by spaces.

    All documents are reference text. It is indexed whole and dealt out in
    blocks of `BLOCK` words, of which a document meets those that the index
    says it shares a long factor with; to no other block it could be tied.

    1. Exact copies are set aside; the smallest id of equal word sequences
       stands for all, the others are one factor each.
    2. Each window's smallest gram is its entry in the index. An entry of one
       document alone ends every factor. An entry around which all documents
       agree, as far as a window reaches, gives all its windows the place where
       it first stands.
    3. At the boundaries of such stretches, where documents differ around a
       shared entry, the windows themselves are looked up, by two 64-bit
       hashes, for the place where each first stands.
    4. Each document is parsed greedily: a factor follows its reference as far
       as the windows do, the next begins where it ends.
    5. The reference blocks of the factors meet the documents and every factor
       is compared with them word by word; what is not equal is no factor, so
       no result rests on hashes.

    Rows with a null id neither lose words nor count as earlier; null texts
    and texts of fewer words than `least` keep all; of rows that repeat an id
    none is earlier than the other; an empty table gives no rows. Other columns
    are not looked at. No step gathers the documents of a gram, a window or a
    block: only minima and maxima per hash are taken, summed before the
    shuffle, and lists are gathered for one document, bounded by its length.
    """
    gram = max(4, least // GRAM_SHARE)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    seen = written(rows.mapInPandas(lambda b: _grams(b, least, gram), f"id {kind}, key long, sha binary, n int, pos array<int>, gram array<long>, around array<long>"), "grams")
    # the word sequences that stand more than once, with their smallest ids
    base = written(seen.select("id", "sha", "n"), "words")
    copies = base.filter(F.col("id").isNotNull() & (F.col("n") >= least)).groupBy("sha").agg(F.min("id").alias("rep"), F.count("*").alias("k")).filter("k > 1").drop("k")
    copies = written(copies, "copies")
    known = base.join(copies, "sha", "left")
    single = seen.filter(F.col("id").isNotNull() & (F.col("n") >= least)).join(copies, "sha", "left").filter("rep is null or id = rep")
    entries = single.select("id", "key", "sha", F.explode(F.arrays_zip("pos", "gram", "around")).alias("e")).select("id", "key", "sha", "e.*")
    index = entries.groupBy("gram").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("around").alias("a"), F.max("around").alias("b")).filter("lo < hi")
    # minima are written, so that the joins back read two plain shuffles and Spark can split an entry that very many documents share
    index = written(index, "index")
    state = F.when(F.col("a") != F.col("b"), 0).when(F.col("id") == F.col("lo"), 1).otherwise(2)
    shared = written(entries.drop("around").join(index, "gram").select("gram", "id", "key", "sha", "pos", state.alias("state")), "shared")
    dropped(seen)
    dropped(index)
    place = lambda at: F.min(F.struct("id", "key", at)).alias("ref")
    first = written(shared.filter("state = 1").groupBy("gram").agg(place("pos")), "first")
    own = ["id", "key", "sha"]
    later = shared.filter("state = 2").join(first, "gram").select(*own, "pos", "state", F.col("ref.id").alias("rid"), F.col("ref.key").alias("rkey"), F.col("ref.pos").alias("rpos"))
    # entries without a reference name themselves: a null among 64-bit hashes would turn them into floating point on the way to Python
    rest = shared.filter("state <> 2").select(*own, "pos", "state", F.col("id").alias("rid"), F.col("key").alias("rkey"), F.col("pos").alias("rpos"))
    flags = later.unionByName(rest).groupBy(*own).agg(F.collect_set(F.struct("pos", "state", "rid", "rkey", "rpos")).alias("f"))
    flags = written(flags.select(*own, *[F.col(f"f.{c}").alias(c) for c in ("pos", "state", "rid", "rkey", "rpos")]), "flags")
    dropped(shared)
    dropped(first)

    # only texts with an open anchor have windows to look up
    some = flags.filter(F.array_contains("state", 0)).select("id", "key", "pos", "state")
    looked = rows.join(some, ["id", "key"]).select("id", "key", "text", "pos", "state")
    looked = written(looked.mapInPandas(lambda b: _windows(b, least, gram), f"id {kind}, key long, start int, one long, two long"), "windows")
    earlier = looked.groupBy("one", "two").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").drop("hi")
    earlier = written(earlier, "earlier")
    hits = written(looked.join(earlier, ["one", "two"]), "hits")
    dropped(looked)
    dropped(earlier)
    first = written(hits.filter("id = lo").groupBy("one", "two").agg(place("start")), "first")
    met = hits.filter("id > lo").join(first, ["one", "two"]).groupBy("id", "key").agg(F.collect_set(F.struct("start", F.col("ref.id").alias("sid"), F.col("ref.key").alias("skey"), F.col("ref.start").alias("spos"))).alias("s"))
    met = written(met.select("id", "key", F.col("s.start").alias("starts"), *[F.col(f"s.{c}").alias(c) for c in ("sid", "skey", "spos")]), "starts")
    dropped(hits)
    dropped(first)

    open_ = flags.filter(F.array_contains("state", 2) | F.array_contains("state", 0)).join(met, ["id", "key"], "left").filter(F.array_contains("state", 2) | F.col("starts").isNotNull())
    plan = rows.join(open_, ["id", "key"]).mapInPandas(lambda b: _planned(b, least, gram), f"id {kind}, key long, sha binary, text string, factors array<struct<at:int,len:int,rid:{kind},rkey:long,rpos:int>>")
    plan = written(plan, "plan")
    asked = plan.select(*own, F.explode("factors").alias("f")).select(*own, F.col("f.rid").alias("rid"), F.col("f.rkey").alias("rkey"), F.explode(F.sequence((F.col("f.rpos") / BLOCK).cast("int"), ((F.col("f.rpos") + F.col("f.len") - 1) / BLOCK).cast("int"))).alias("number"))
    asked = written(asked.distinct(), "asked")
    # the blocks asked of a reference are as many as it has at most
    wanted = asked.select("rid", "rkey", "number").distinct().groupBy("rid", "rkey").agg(F.collect_list("number").alias("numbers"))
    blocks = rows.withColumnsRenamed({"id": "rid", "key": "rkey"}).join(wanted, ["rid", "rkey"]).mapInPandas(_blocks, f"rid {kind}, rkey long, number int, words binary")
    blocks = written(blocks.dropDuplicates(["rid", "rkey", "number"]), "blocks")
    given = asked.join(blocks, ["rid", "rkey", "number"]).groupBy(*own).agg(F.collect_list(F.struct("rid", "rkey", "number", "words")).alias("given"))
    array = "array<struct<from:int,to:int>>"
    spans = plan.join(given, own).select("id", "sha", "text", "factors", "given").mapInPandas(lambda b: _parsed(b, least), f"id {kind}, sha binary, spans {array}, kept string")
    spans = written(spans.filter(F.size("spans") > 0).dropDuplicates(["id", "sha"]), "spans")
    for table in (flags, met, plan, asked, blocks):
        dropped(table)
    both = known.join(spans, ["id", "sha"], "left")
    copy = F.col("rep").isNotNull() & (F.col("id") > F.col("rep"))
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n").alias("to"))).cast(array)
    return both.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast(array))).alias("spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def removed_words() -> Column:
    """The words that `spans` cover, as a column."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
