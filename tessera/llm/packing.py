"""Lexical retrieval packing: windows filled with the nearest unused documents by BM25."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, repeat
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import slices
from tessera.session import written

#: Saturation of term counts and weight of lengths.
K1, B = 1.2, 0.75
#: Terms of a seed that are looked up, those of greatest weight.
QUERY_TERMS = 24
#: Latin letters that have one lower case each, and ASCII marks but the apostrophe, which may begin a contraction.
LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: Letters and digits, white space and marks of Latin-1, and what only Python takes for white space; marks that get spaces around them.
KINDS = bytes(ord("?" if 28 <= c < 32 else " " if chr(c).isspace() else "a" if category(chr(c))[0] in "LN" else "!") for c in range(256))
COMMON_MARKS = ",.;:!?()\"-/"
#: Blank-free strings whose tokens a worker keeps before it starts anew, and the words and marks that they consist of.
MAX_CACHED, MAX_PARTS = 700_000, 1_200_000
#: Tokens of the documents that share one inverted index.
SHARD_TOKENS = 1 << 21


def _parts_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer drops blanks and treats what stands between them apart."""
    norm = spec.get("normalizer") or {}
    norms = norm.get("normalizers", [norm] if norm else [])
    split = spec.get("pre_tokenizer") or {}
    first = split.get("pretokenizers", [split])[0]
    plain = all(n["type"] in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for n in norms)
    if not plain or first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    pattern = first["pattern"].get("Regex")
    return bool(pattern) and not regex.search(pattern, " \n") and all(len(m) < 4 for m in regex.findall(pattern, "a b\nc 1")) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])


def _kinds(text: str) -> bytes | None:
    """The kind of each character of a text, if all are of Latin-1."""
    try:
        return text.encode("latin-1").translate(KINDS)
    except UnicodeEncodeError:
        return None


def _words_and_marks(spec: dict) -> bool:
    """Whether a tokenizer that parts at blanks makes runs of letters and single marks tokens of their own, and no added token can be found where marks stand alone."""
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    seen = "ab" + "".join(f"{m}é{m} Xß 1" for m in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~") + "x"
    return regex.findall(pattern, seen) == re.findall(r"[abxXéß]+|\S", seen) and all(b"!!" in (_kinds(t["content"]) or b"!!") for t in spec["added_tokens"])


class _Known(dict):
    """Strings to the bytes of their token ids; one that is not there is noted in `new`, and its place is filled by `Encoder._learn`."""

    def __init__(self):
        self.new: dict[str, bytearray] = {}

    def __missing__(self, string: str) -> bytearray:
        self[string] = self.new[string] = place = bytearray()
        return place


class Encoder:
    """Token ids of whole texts, as the library gives them.

    Where the tokenizer drops blanks, a text is cut at spaces and line breaks
    and each distinct string between them is looked up or encoded once. Of one
    that is a word of Latin letters with marks behind it word and marks are
    tokens of their own, so each distinct word in lower case is given to the
    library once; many are joined by spaces, and the tokens that end a word
    part them. A text of Latin-1 where no two marks stand together is put in
    lower case as a whole, and its common marks between spaces.
    """

    def __init__(self, raw: str):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        self.lib = Tokenizer.from_str(raw)
        self.by_chunk = _parts_at_blanks(spec)
        self.kind = "<u2" if max(spec["model"]["vocab"].values(), default=0) < 1 << 16 and all(t["id"] < 1 << 16 for t in spec["added_tokens"]) else "<u4"
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = None
        if self.by_chunk and suffix and {"type": "Lowercase"} in spec["normalizer"].get("normalizers", []) and _words_and_marks(spec):
            self.ends = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
            # words in lower case need neither the normaliser nor the pattern
            rest = spec["pre_tokenizer"]["pretokenizers"][1:]
            self.lean = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}))
        self._anew()
        self._anew_parts()

    def _anew(self) -> None:
        self.known = _Known()

    def _anew_parts(self) -> None:
        self.parts: dict[str, bytes] = {"": b""}

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _learn_parts(self, words: list[str], others: list[str]) -> None:
        """Keeps the tokens of words of Latin letters in lower case, and of other strings."""
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            ids = np.array(self.lean.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(cuts) != len(part):
                raise ValueError("a word of letters must end in one token that ends a word")
            flat = ids.tobytes()
            self.parts.update(zip(part, [flat[a:b] for a, b in zip([0, *cuts], cuts)]))
        self.parts.update(zip(others, map(self._bytes, self._raw(others))))

    def _learn(self) -> None:
        """Fills the places of strings that were not known."""
        new, parts, letters = self.known.new, self.parts, LETTERS.fullmatch
        if not new:
            return
        if self.ends is None:
            found = list(map(self._bytes, self._raw(list(new))))
        else:
            cut = {}
            for c in new:
                if not letters(c):
                    m = LATIN.fullmatch(c)
                    cut[c] = (m[1].lower(), m[2]) if m else (c, "")
            lacking = [w for w in new if w not in cut and w not in parts]
            more = dict.fromkeys(w for w in chain.from_iterable(cut.values()) if w not in parts and (w not in new or w in cut))
            self._learn_parts(lacking + [w for w in more if letters(w)], [w for w in more if not letters(w)])
            found = [parts[c] if c not in cut else parts[cut[c][0]] + parts[cut[c][1]] for c in new]
        for place, ids in zip(new.values(), found):
            place += ids
        self.known.update(zip(new, found))
        self.known.new = {}

    def _strings(self, text: str) -> list[str]:
        """What is looked up of a text."""
        if self.ends is not None:
            kinds = _kinds(text)
            if kinds is not None and b"!!" not in kinds and b"?" not in kinds:
                text = text.lower()
                for mark in COMMON_MARKS:
                    if mark in text:
                        text = text.replace(mark, f" {mark} ")
                return text.split()
        return text.replace("\n", " ").split(" ")

    def flat_ids(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by `end` if there is one, and where each text begins, and the last one ends."""
        if not self.by_chunk:
            every = [x + ([] if end is None else [end]) for x in self._raw(texts)]
            sizes = np.array([len(x) for x in every], np.int64)
            return np.fromiter((i for x in every for i in x), np.int32, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])
        if len(self.known) > MAX_CACHED:
            self._anew()
        if len(self.parts) > MAX_PARTS:
            self._anew_parts()
        get = self.known.__getitem__
        found = [list(map(get, self._strings(t))) for t in texts]
        self._learn()
        whole = [b"".join(f) for f in found]
        size = np.dtype(self.kind).itemsize
        cuts = np.concatenate([[0], np.cumsum([len(w) // size + (end is not None) for w in whole], dtype=np.int64)])
        if end is None:
            return np.frombuffer(b"".join(whole), self.kind), cuts
        if end > np.iinfo(self.kind).max:
            every = np.frombuffer(b"".join(whole), self.kind).astype(np.int64)
            return np.insert(every, cuts[1:] - np.arange(1, len(cuts)), end), cuts
        last = self._bytes([end])
        return np.frombuffer(b"".join(chain.from_iterable(zip(whole, repeat(last)))), self.kind), cuts

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        every, cuts = self.flat_ids(texts)
        return [every[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


@lru_cache(2)
def _encoder(key: str, raw: str) -> Encoder:
    return Encoder(raw)


def _orders(n: int) -> np.ndarray:
    """Four orders of all token ids, as ranks of 16 bits."""
    rng = np.random.default_rng(11)
    return np.stack([(rng.permutation(n) * (65_535 / max(n - 1, 1))).astype(np.uint64) for _ in range(4)])


def sketches(doc: np.ndarray, token: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The least token of each document in each of four orders, given its distinct tokens: documents that share tokens stand near each other when sorted by it."""
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    least = np.minimum.reduceat(orders[:, token], begin, axis=1)
    return (least << np.array([[48], [32], [16], [0]], np.uint64)).sum(axis=0, dtype=np.uint64).astype(np.int64)


class Shard:
    """Documents with one inverted index: tokens to the documents that hold them, with BM25 weights.

    `weights` has the inverse document frequency of every token over the whole
    corpus, `mean` the mean length of what is indexed. Of a document longer
    than a window only what is left after its full windows is indexed and
    retrieved.
    """

    def __init__(self, ids: list[np.ndarray], weights: np.ndarray, mean: float, window: int):
        self.window = window
        self.full = [len(x) // window for x in ids]
        self.lo = [k * window for k in self.full]
        self.hi = [len(x) for x in ids]
        rests = [x[k:] for x, k in zip(ids, self.lo)]
        sizes = np.array([len(r) for r in rests], np.int64)
        n = len(weights)
        keys, counts = np.unique(np.repeat(np.arange(len(ids)), sizes) * n + np.concatenate(rests), return_counts=True)
        self.doc, self.term = keys // n, keys % n
        tf, length = counts.astype(np.float64), sizes[self.doc] / mean
        self.weight = weights[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
        self.importance = weights[self.term] * tf
        self.rows = np.searchsorted(self.doc, np.arange(len(ids) + 1))
        order = np.argsort(self.term, kind="stable")
        self.post_doc, self.post_weight = self.doc[order], self.weight[order]
        terms, first = np.unique(self.term[order], return_index=True)
        self.posting = dict(zip(terms.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)])))
        self.unused = sizes > 0

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share a term of the seed, best score first, the earlier of equal ones first."""
        a, b = self.rows[seed], self.rows[seed + 1]
        top = np.argsort(-self.importance[a:b], kind="stable")[:QUERY_TERMS] + a
        score = np.zeros(len(self.unused))
        for t in self.term[top].tolist():
            lo, hi = self.posting[t]
            score[self.post_doc[lo:hi]] += self.post_weight[lo:hi]
        score *= self.unused
        found = np.flatnonzero(score > 0)
        near = found
        if len(found) > 32:  # most windows need a few; the rest is sorted only if they do not do
            bound = np.partition(score[found], len(found) - 16)[len(found) - 16]
            near = found[score[found] >= bound]
            yield from near[np.argsort(-score[near], kind="stable")].tolist()
            near = found[score[found] < bound]
        yield from near[np.argsort(-score[near], kind="stable")].tolist()

    def sequences(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences as lists of (document, start, end).

        First the full windows of long documents. Then a seed, the earliest
        unused document, is followed by its unused neighbours until the window
        is full; the last one is cut, and the rest of it is the next seed. A
        seed whose neighbours do not fill its window goes on with those of the
        last of them, then with the earliest unused document. What is left at
        the end is cut into powers of two, which need no padding.
        """
        w = self.window
        for d, k in enumerate(self.full):
            for i in range(k):
                yield [(d, i * w, (i + 1) * w)]
        at, seed, n = 0, -1, len(self.unused)
        while True:
            if seed < 0:
                while at < n and not self.unused[at]:
                    at += 1
                if at == n:
                    return
                seed = at
            self.unused[seed] = False
            room, parts = w - (self.hi[seed] - self.lo[seed]), [(seed, self.lo[seed], self.hi[seed])]
            seed, asked = -1, parts[0][0]
            while room:
                last = asked
                for d in self.neighbours(asked):
                    take = min(room, self.hi[d] - self.lo[d])
                    parts.append((d, self.lo[d], self.lo[d] + take))
                    self.unused[d] = False
                    self.lo[d] += take
                    room -= take
                    last = d
                    if not room:
                        if self.lo[d] < self.hi[d]:
                            seed = d
                        break
                if room and last == asked:
                    while at < n and not self.unused[at]:
                        at += 1
                    if at == n:
                        break
                    asked = at
                    take = min(room, self.hi[at] - self.lo[at])
                    parts.append((at, self.lo[at], self.lo[at] + take))
                    self.unused[at] = False
                    self.lo[at] += take
                    room -= take
                    if self.lo[at] < self.hi[at]:
                        seed = at
                else:
                    asked = last
            if room:
                yield from powers_of_two(parts)
            else:
                yield parts


def powers_of_two(parts: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The same tokens in the same order as sequences whose sizes are powers of two, the longest first."""
    left, parts = sum(b - a for _, a, b in parts), list(parts)
    while left:
        need = 1 << (left.bit_length() - 1)
        left -= need
        out = []
        while need:
            d, a, b = parts[0]
            take = min(need, b - a)
            out.append((d, a, a + take))
            need -= take
            if a + take == b:
                parts.pop(0)
            else:
                parts[0] = (d, a + take, b)
        yield out


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, start, length, ids, doc_tokens, sequence_id, offset`, a row for each piece of a document.

    A document is the token ids of its whole text (the library's, without
    special tokens around them; `tokenizer` is the path of a `.json` file of
    it), then `end_id`. Every id stands in exactly one piece: `length` ids from
    `start` of its document, at `offset` of its sequence; `ids` has them as
    little-endian numbers of 32 bits. A sequence has `window` ids, or a power
    of two of them.

    Documents are sorted by a sketch of their tokens, so that those alike stand
    together, and dealt out by ranges of it; each stretch of about
    `shard_tokens` tokens has an inverted index of its own. Document
    frequencies and the mean length are those of the whole corpus, and go to
    all workers: a number for each token of the vocabulary. A sketch or text
    that a large part of the documents share is spread over ranges by row.

    A null or empty text has `end_id` alone; repeated rows are documents each;
    a null id stays null; an empty table gives no rows. A very long text is cut
    into windows like any other; a task holds one shard, or one text if that is
    longer. Other columns are not looked at. Sequence ids are unique, not
    gapless.
    """
    if window < 1 or shard_tokens < 1:
        raise ValueError("window and shard_tokens must be positive")
    with open(tokenizer, encoding="utf-8") as f:
        raw = f.read()
    spark = docs.sparkSession
    sent, key = spark.sparkContext.broadcast(raw), sha256(raw.encode()).hexdigest()
    spec = json.loads(raw)
    n_ids = 1 + max(end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]))
    kind = "<u2" if n_ids <= 1 << 16 else "<u4"

    @F.pandas_udf("struct<n:long,sketch:long,ids:binary,seen:binary>")
    def encoded(texts: pd.Series) -> pd.DataFrame:
        encoder, orders, out, seen = _encoder(key, sent.value), _orders(n_ids), [], np.zeros(n_ids, np.int64)
        for part in slices(texts):
            every, cuts = encoder.flat_ids([t or "" for t in part], end_id)
            sizes = np.diff(cuts)
            first = np.arange(len(sizes), dtype=np.int32 if len(sizes) * n_ids < 1 << 31 else np.int64) * n_ids
            cells = np.repeat(first, sizes) + every
            cells.sort()
            held = cells[np.flatnonzero(np.diff(cells, prepend=-1))]
            doc, token = held // n_ids, held % n_ids
            seen += np.bincount(token, minlength=n_ids)
            whole = every.astype(kind, copy=False)
            out += zip(sizes.tolist(), sketches(doc, token, orders).tolist(), (whole[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist())))
        found = pd.DataFrame(out, columns=["n", "sketch", "ids"])
        # in how many documents of the batch each token stands, beside its last row
        some = np.flatnonzero(seen)
        found["seen"] = [None] * (len(found) - 1) + [np.stack([some, seen[some]]).astype("<i8").tobytes()] if len(found) else []
        return found

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), encoded(F.col(text_col)).alias("e"))
    rows = written(rows.select("id", "row", "e.n", "e.sketch", "e.ids", "e.seen"), "tokens")

    def frequencies(batches):
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            for x in batch.column("seen"):
                token, df = np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1)
                total[token] += df
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(total[token])], ["token", "df"])

    # a row for each token of the vocabulary
    found = rows.select("seen").filter("seen is not null").mapInArrow(frequencies, "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).collect()
    total = rows.agg(F.count("*").alias("n"), F.avg(F.col("n") % window).alias("mean")).first()
    df = np.zeros(n_ids)
    df[[r["token"] for r in found]] = [r["df"] for r in found]
    weights = spark.sparkContext.broadcast(np.log1p((total["n"] - df + 0.5) / (df + 0.5)))
    mean = max(total["mean"] or 0.0, 1.0)
    id_type = rows.schema["id"].dataType.simpleString()

    def filled(batches):
        counter = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        size = 0

        def done():
            nonlocal counter
            table = pa.Table.from_batches(held).combine_chunks()
            ids = [np.frombuffer(x.as_buffer(), kind).astype(np.int64) for x in table.column("ids")]
            pieces = []
            for parts in Shard(ids, weights.value, mean, window).sequences():
                offset = 0
                for d, a, b in parts:
                    pieces.append((d, a, b - a, counter, offset))
                    offset += b - a
                counter += 1
            d, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
            for lo in range(0, len(d), 4096):
                k = slice(lo, lo + 4096)
                own = [ids[i][a : a + n].astype("<u4").tobytes() for i, a, n in zip(d[k].tolist(), start[k].tolist(), length[k].tolist())]
                sizes = np.array([len(ids[i]) for i in d[k].tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks().take(pa.array(d[k])), pa.array(start[k]), pa.array(length[k]), pa.array(own, pa.binary()), pa.array(sizes), pa.array(sequence[k]), pa.array(offset[k])], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            n, at = batch.column("n").to_numpy(zero_copy_only=False), 0
            while at < len(n):
                upto = np.cumsum(n[at:])
                more = min(int(np.searchsorted(upto, shard_tokens - size)) + 1, len(upto))
                held.append(batch.slice(at, more))
                size += int(upto[more - 1])
                at += more
                if size >= shard_tokens:
                    yield from done()
                    held, size = [], 0
        if held:
            yield from done()

    dealt = rows.repartitionByRange("sketch", "row").sortWithinPartitions("sketch", "row").select("id", "n", "ids")
    out = dealt.mapInArrow(filled, f"id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
