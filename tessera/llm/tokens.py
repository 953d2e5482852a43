"""Token counts by a tokenizer compiled to finite-state transducers."""

from __future__ import annotations

import json
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Symbols of the word machine; the second eight are the same at the start of a segment.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, LEAD, LONE = range(8)
FIRST, NOTHING = 8, 16
#: Its states: in a run of letters, numbers, others or blanks; after a leading
#: space; one or two letters of a contraction to come; free.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, LED, ONE_LEFT, TWO_LEFT, FREE = range(8)
CHUNK = 64
#: Bytes of a word that the merge machine reads as one chunk, and rounds in which chunks are fitted together all at once.
PIECE, ROUNDS = 32, 8
#: Entries that the caches of a worker hold before they start anew.
MAX_CACHED = {"words": 800_000, "beside": 800_000, "moves": 1_500_000}


def _word_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and words begun, by symbol * 8 + state."""
    go, begun = np.zeros((17, 8), np.uint8), np.zeros((17, 8), np.uint8)
    for state in range(8):
        for symbol in range(8):
            if state in (TWO_LEFT, ONE_LEFT):
                to, new = (ONE_LEFT, 0) if state == TWO_LEFT else (FREE, 0)
            elif symbol in (LETTER, NUMBER, OTHER):
                to = (IN_LETTERS, IN_NUMBERS, IN_OTHERS)[symbol]
                new = state not in (to, LED)
            elif symbol in (SHORT, LONG):
                if state in (IN_OTHERS, LED):
                    to, new = IN_OTHERS, 0
                else:
                    to, new = (ONE_LEFT if symbol == SHORT else TWO_LEFT), 1
            elif symbol == BLANK:
                to, new = IN_BLANKS, state != IN_BLANKS
            else:
                to, new = (LED if symbol == LEAD else FREE), 1
            go[symbol, state], begun[symbol, state] = to, new
    for symbol in range(8):
        go[FIRST + symbol], begun[FIRST + symbol] = go[symbol, FREE], begun[symbol, FREE]
    go[NOTHING] = np.arange(8)
    return go.ravel(), begun.ravel()


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER or OTHER for each code point; BLANK for white space, LEAD for the space."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    at = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for m in regex.finditer(pattern, every):
            table[at[m.start() : m.end()]] = kind
    table[32] = LEAD
    return table


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word machine's symbols; `first` marks where a segment starts."""
    kind = _classes()[points]
    n = len(kind)
    after = np.append(kind[1:], BLANK)
    after[np.flatnonzero(first[1:])] = BLANK  # the end of a segment is like white space
    blank, more = kind >= BLANK, after >= BLANK
    out = np.where(blank, np.where(more, BLANK, np.where(kind == LEAD, LEAD, LONE)), kind).astype(np.uint8)
    for i in np.flatnonzero(points == 39).tolist():  # ' and what makes it a contraction
        if i + 1 < n and not first[i + 1]:
            one = chr(points[i + 1])
            if one in "stmd":
                out[i] = SHORT
            elif i + 2 < n and not first[i + 2] and one + chr(points[i + 2]) in ("re", "ve", "ll"):
                out[i] = LONG
    return out + FIRST * first.astype(np.uint8)


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words start that the byte-pair merges stay within.

    The symbols are cut into chunks. Every chunk is run from all eight states
    at once, which gives its state map; a parallel prefix scan composes the
    maps, so each chunk learns the state that it is entered in, and a second
    run marks the starts.
    """
    go, begun = _word_machine()
    n = len(points)
    symbols = np.full(-(-n // CHUNK) * CHUNK, NOTHING, np.uint8)
    symbols[:n] = _symbols(points, first)
    columns = np.ascontiguousarray(symbols.reshape(-1, CHUNK).T).astype(np.intp) * 8
    maps = np.tile(np.arange(8, dtype=np.uint8), (columns.shape[1], 1))
    for column in columns:
        maps = go[column[:, None] + maps]
    step = 1
    while step < len(maps):  # after each round a map spans twice as many chunks
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.append(np.uint8(FREE), maps[:-1, FREE])
    starts = np.zeros_like(columns, dtype=np.uint8)
    for j, column in enumerate(columns):
        starts[j] = begun[column + state]
        state = go[column + state]
    return np.flatnonzero(starts.T.ravel()[:n])


class MergeMachine:
    """The merges of a byte-pair vocabulary as a deterministic transducer over bytes.

    A prefix of a word ends in exactly one token of its own encoding: the one
    that stands beside the last token of what comes before it just as the
    merges would leave them. A state holds all that later bytes may depend on:
    for each start from which a token could still grow, the place in the tree
    of tokens, the token before that start, and the tokens counted there
    against now. A transition is annotated with the tokens that it adds.
    States are found as texts need them and are kept.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.names = {i: b for b, i in vocabulary.items()}
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        self.single = [vocabulary[bytes([b])] for b in range(256)]
        self.kids: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for name, i in vocabulary.items():
            at = 0
            for b in name:
                if b not in self.kids[at]:
                    self.kids[at][b] = len(self.kids)
                    self.kids.append({})
                    self.token.append(-1)
                at = self.kids[at][b]
            self.token[at] = i
        self.beside: dict[tuple[int, int], bool] = {}
        self.words: dict[str, int] = {}
        self._anew()

    def _anew(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merged(self, raw: bytes) -> list[int]:
        """The tokens of a few bytes by the merges themselves."""
        parts, get = [self.single[b] for b in raw], self.merges.get
        found = [get(p) for p in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, f in enumerate(found):
                if f is not None and (best is None or f < best):
                    best, at = f, i
            if best is None:
                return parts
            parts[at : at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = get((parts[at - 1], parts[at]))
            if at < len(found):
                found[at] = get((parts[at], parts[at + 1]))

    def _fits(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        if (found := self.beside.get((a, b))) is None:
            found = self.beside[a, b] = self.merged(self.names[a] + self.names[b]) == [a, b]
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        open_, token, added = [], -1, 0
        for node, before, count in self.states[state]:
            child = self.kids[node].get(byte)
            if child is None:
                continue
            if token < 0 and self.token[child] >= 0 and self._fits(before, self.token[child]):
                token, added = self.token[child], count + 1
            if self.kids[child]:
                open_.append((child, before, count))
        key = (*((n, b, c - added) for n, b, c in open_), (0, token, 0))
        to = self.number.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        self.moves[state << 8 | byte] = found = (to, added)
        return found

    def _run(self, chunks: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state maps of chunks at the states given: the state that each ends in and the tokens it adds.

        All chunks take a step at once; each pair of state and byte that is new is compiled once.
        """
        state, added = state.copy(), np.zeros(len(sizes), np.int64)
        if len(sizes) < 8:  # too few to gain by
            for i, n in enumerate(sizes.tolist()):
                for byte in chunks[i, :n].tolist():
                    key = int(state[i]) << 8 | byte
                    state[i], more = self.moves.get(key) or self._compile(key >> 8, byte)
                    added[i] += more
            return state, added
        for j in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > j)
            keys, of = np.unique(state[on] << 8 | chunks[on, j], return_inverse=True)
            get, make = self.moves.get, self._compile
            found = np.array([get(k) or make(k >> 8, k & 255) for k in keys.tolist()], np.int64)
            state[on] = found[of, 0]
            added[on] += found[of, 1]
        return state, added

    def walk(self, words: list[bytes]) -> np.ndarray:
        """The tokens of each word.

        Words are cut into chunks. A chunk's state map is found at the states
        that are asked for: at first the one at the start of a word, then, where
        the chunk before ends in another, at that one. Chunks whose maps fit
        together are composed by a prefix scan over twice as many at each round;
        where they do not yet fit the map is found at the other state as well.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        pieces = np.maximum(-(-lengths // PIECE), 1)
        first = np.concatenate([[0], np.cumsum(pieces)])
        n = int(first[-1])
        raw = b"".join(w.ljust(int(k) * PIECE, b"\0") for w, k in zip(words, pieces))
        chunks = np.frombuffer(raw, np.uint8).reshape(n, PIECE).astype(np.int64)
        sizes = np.full(n, PIECE, np.int64)
        sizes[first[1:] - 1] = lengths - (pieces - 1) * PIECE
        follows = np.ones(n, bool)  # its entry state is the end of the chunk before
        follows[first[:-1]] = False
        entry = np.zeros(n, np.int64)
        ends, added = self._run(chunks, sizes, entry)
        place = np.arange(n) - np.repeat(first[:-1], pieces)

        def refit(some: np.ndarray) -> np.ndarray:
            wrong = some[ends[some - 1] != entry[some]]
            if len(wrong):
                entry[wrong] = ends[wrong - 1]
                ends[wrong], added[wrong] = self._run(chunks[wrong], sizes[wrong], entry[wrong])
            return wrong

        # only what does not fit is read again; most states forget what lies a few bytes back
        todo = np.flatnonzero(follows)
        for _ in range(ROUNDS):
            after = refit(todo) + 1
            todo = after[after < n]
            todo = todo[follows[todo]]
        if len(todo):  # long runs without a break: from left to right, each chunk once
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(1, int(place.max()) + 2))
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                refit(order[lo:hi])
        # the composed maps: sums over ever longer stretches of chunks
        sums, step = added.copy(), 1
        while step <= int(place.max(initial=0)):
            far = np.flatnonzero(place >= step)
            sums[far] += sums[far - step]
            step *= 2
        return sums[first[1:] - 1]

    def counts(self, words: list[str]) -> np.ndarray:
        """The tokens of each word; words met before are looked up, the others walked together, each once."""
        for name in ("words", "beside"):
            if len(getattr(self, name)) > MAX_CACHED[name]:
                getattr(self, name).clear()
        if len(self.moves) > MAX_CACHED["moves"]:
            self._anew()
        known, get, new = self.words, self.words.get, {}
        out = np.array([get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(out < 0).tolist()
        for i in missing:
            new.setdefault(words[i], len(new))
        if new:
            found = self.walk([w.encode("utf-8", "surrogatepass") for w in new])
            known.update((w, n) for w, n in zip(new, found.tolist()) if len(w) < 64)
            out[missing] = found[[new[words[i]] for i in missing]]
        return out


class Compiled:
    """A tokenizer file of byte-level byte pairs, compiled."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE is compiled")
        # bytes that print stand for themselves, the rest for code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        own = lambda s: bytes(byte[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match plainly")
        self.machine = MergeMachine({own(s): i for s, i in model["vocab"].items() if s not in self.special}, [(own(a), own(b)) for a, b in pairs])
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def counts(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text; a special string in a text is one token and parts it."""
        total = np.zeros(len(texts), np.int64)
        segments, of = [], []
        for i, t in enumerate(texts):
            parts = self.cut.split(t) if self.cut else [t]
            total[i] += len(parts) - 1
            for p in parts:
                if p:
                    segments.append(p)
                    of.append(i)
        if not segments:
            return total
        whole = "".join(segments)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(points), bool)
        begins = np.cumsum([0, *map(len, segments)])
        first[begins[:-1]] = True
        starts = word_starts(points, first)
        ends = np.append(starts[1:], len(points))
        counted = self.machine.counts([whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        np.add.at(total, np.array(of), np.add.reduceat(counted, np.searchsorted(starts, begins[:-1])))
        return total


@lru_cache(4)
def _compiled(key: str, raw: bytes) -> Compiled:
    return Compiled(raw)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, batch_chars: int = 1 << 21) -> DataFrame:
    """`id_col, n_bytes, n_tokens, over_limit` for every row, over whole texts.

    `tokenizer` is the path of a byte-level BPE file of the tokenizers library;
    the driver reads it and each worker compiles it once. The counts are those
    of the library without begin or end tokens, special strings inside texts
    taken as such. A null or empty text has no bytes and no tokens; repeated
    rows come back each; an empty table gives no rows. Other columns are not
    looked at. Texts are counted about `batch_chars` characters at a time.
    """
    with open(tokenizer, "rb") as f:
        raw = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(raw)  # the size of one vocabulary file
    key = sha256(raw).hexdigest()

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        machine = _compiled(key, sent.value)
        out, held, size = [], [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= batch_chars:
                out.append(machine.counts(held))
                held, size = [], 0
        out.append(machine.counts(held))
        return pd.Series(np.concatenate(out))

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), of(F.col(text_col)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
