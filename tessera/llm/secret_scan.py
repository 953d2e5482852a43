"""Secret scans through layers of encoding."""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

#: What may be an encoded layer.
PERCENT = re.compile(r"[A-Za-z0-9+/_.=~:\"'%-]+")
PERCENT_PART = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPED = re.compile(r"\S+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-](?:(?:\r?\n[ \t]*)?[A-Za-z0-9+/_-]){15,}={0,2}")
#: Stretches of bytes that can hold a secret or a further layer, and starts of compressed streams.
PRINTED = re.compile(rb"[\x09\x0A\x0D\x20-\x7E]{8,}|(?:[\x09\x0A\x0D\x20-\x7E]\x00){8,}")
STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2})|([\"'\\/bfnrt]))")
SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_PLAIN = str.maketrans({"-": "+", "_": "/", "\r": None, "\n": None, " ": None, "\t": None})
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: A compressed layer is unfolded and scanned in pieces of so many bytes, each with the end of the one before.
PIECE, OVERLAP = 16 << 20, 1 << 20
#: A run of base64 in a compressed layer is held up to so many bytes, so that what it holds is read as one; a longer one is read in pieces and reported.
LONGEST = 256 << 20


def base_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """start, end, kind: leftmost and non-overlapping for each kind."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield m.start(), m.end(), "assign"
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield m.start(), m.end(), "access"
    # a run is one match of [0-9a-f]+, so runs of 24 are those matches that pass
    for m in HEX.finditer(text):
        yield m.start(), m.end(), "hex"


def _reads(text: str) -> bool:
    """Whether nine of ten characters print."""
    return bool(text) and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.9 * len(text)


def _as_text(raw: bytes) -> str | None:
    """Text if the bytes read as such, in UTF-8, or in UTF-16 where every other byte of most is zero."""
    try:
        if _reads(text := raw.decode("utf-8")):
            return text
    except UnicodeDecodeError:
        pass
    half = len(raw) // 2
    for name, odd in (("utf-16-le", raw[1::2]), ("utf-16-be", raw[0::2])):
        if half >= 4 and odd.count(0) >= 0.6 * half:
            text = raw[: 2 * half].decode(name, "replace").lstrip("\ufeff")
            if _reads(text):
                return text
    return None


class _Stream:
    """A compressed stream at the start of some bytes: its content some at a time, then what lies behind it in `rest`.

    `rest` is None if the bytes are no stream or break off; `unread` tells that
    memory did not suffice.
    """

    def __init__(self, raw: bytes, bare: bool = False):
        self.raw, self.bare, self.rest, self.unread = raw, bare, None, False

    def __iter__(self) -> Iterator[bytes]:
        raw, limited = self.raw, True
        try:
            if self.bare:
                unfold = zlib.decompressobj(wbits=-15)
            elif raw[:3] == b"BZh":
                unfold, limited = bz2.BZ2Decompressor(), False
            elif raw[:6] == b"\xfd7zXZ\x00":
                unfold, limited = lzma.LZMADecompressor(lzma.FORMAT_XZ), False
            elif raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0):
                unfold = zlib.decompressobj(wbits=47)
            else:
                return
            feed = raw
            while not unfold.eof:
                out = unfold.decompress(feed, PIECE)
                feed = unfold.unconsumed_tail if limited else b""
                if out:
                    yield out
                elif not feed and not unfold.eof:
                    return  # it breaks off
        except MemoryError:
            self.unread = True
            return
        except (zlib.error, lzma.LZMAError, OSError, ValueError, EOFError):
            return
        self.rest = unfold.unused_data


def _open_run(held: bytes, cut: int) -> int:
    """Where the run of base64 begins that reaches over `cut`; `cut` if there is none."""
    at = cut
    if held[cut : cut + 1] not in (b"\r", b"\n") and held[cut] not in _LETTERS:
        return cut
    while True:
        start = len(held[max(0, at - 4096) : at].rstrip(_LETTERS)) + max(0, at - 4096)
        if start == at - 4096 and start > 0:
            at = start
            continue
        line = held[max(0, start - 256) : start].rstrip(b" \t")
        if not line.endswith(b"\n"):
            return start
        before = max(0, start - 256) + len(line) - (2 if line.endswith(b"\r\n") else 1)
        if before == 0 or held[before - 1] not in _LETTERS:
            return start
        at = before


def _unfolded(stream: _Stream) -> Iterator[bytes]:
    """What compressed streams hold, as pieces that overlap: nothing is left out, and about one piece is held at a time.

    Members that follow each other are one content. No piece ends within a run
    of base64, so a further layer in it is read whole.
    """
    held, full = b"", PIECE + OVERLAP
    while True:
        for out in stream:
            held += out
            while len(held) >= full:
                cut = PIECE
                while cut > PIECE - 4 and held[cut] & 0xC0 == 0x80:  # not within a character
                    cut -= 1
                start = _open_run(held, cut)
                if start <= OVERLAP < cut:  # a run fills the piece
                    if len(held) < LONGEST:
                        full = min(2 * full, LONGEST)
                        last = _open_run(held, len(held) - 1)
                        if last <= OVERLAP:
                            continue
                        start = last
                    else:
                        stream.unread, start = True, cut
                yield held[:start]
                held, full = held[start - OVERLAP :], PIECE + OVERLAP
                while held and held[0] & 0xC0 == 0x80:
                    held = held[1:]
        if not stream.rest or not STREAM.match(stream.rest):
            break
        stream.raw, stream.rest, stream.bare = stream.rest, None, False
    if held:
        yield held


def _contents(body: str) -> Iterator[tuple[str, str]]:
    """Name and content of what a run of base64 holds at any of the four places where it may begin.

    Compressed streams are looked for at every place of the bytes, the next one
    behind the end of the last; then what prints of the bytes is given.
    """
    for k in range(4):
        own = body[k:]
        own = own[:-1] if len(own) % 4 == 1 else own
        raw = base64.b64decode(own + "=" * (-len(own) % 4))
        if k == 0 and not STREAM.match(raw) and (out := _as_text(raw)):
            yield "base64", out
            return
        at = 0
        while m := STREAM.search(raw, at):
            stream, some = _Stream(raw[m.start() :]), False
            for plain in _unfolded(stream):
                if out := _as_text(plain) or _printed(plain):
                    some = True
                    yield "gzip", out
            if stream.unread:
                yield "gzip", None
            if k == 0 and m.start() == 0 and some and stream.rest == b"":
                return
            at = len(raw) - len(stream.rest) if some and stream.rest is not None else m.start() + 1
        # deflate without a header
        whole = b""
        stream = _Stream(raw, bare=True)
        for plain in _unfolded(stream):
            if not (out := _as_text(plain)):
                break
            whole = plain
            if len(plain) >= 4 or stream.rest is not None:
                yield "deflate", out
        if k == 0 and whole and stream.rest == b"":
            return
        if out := _printed(raw):
            yield "base64", out


def _printed(raw: bytes) -> str:
    """The printed stretches of bytes that are no text as a whole, in one byte or two for each character."""
    return "\0".join(m.replace(b"\0", b"").decode("ascii") for m in PRINTED.findall(raw))


def _character(e: re.Match) -> str:
    """What an escape stands for; itself if that is no character."""
    if e[5]:
        return SHORT.get(e[5], e[5])
    c = int(next(g for g in e.groups() if g), 16)
    return chr(c) if c < 0x110000 and not 0xD800 <= c < 0xE000 else e[0]


def _spelt(text: str) -> Iterator[tuple[int, int, str, str]]:
    """start, end, name and content of the runs with percent signs or backslashes that spell other characters."""
    if "%" in text:
        for m in PERCENT.finditer(text):
            if PERCENT_PART.search(m[0]) and (out := unquote_to_bytes(m[0]).decode("utf-8", "replace")) != m[0]:
                yield m.start(), m.end(), "url", out
    if "\\" in text:
        for m in ESCAPED.finditer(text):
            if "\\" not in m[0]:
                continue
            out = ESCAPE.sub(_character, m[0])
            if out != m[0]:
                yield m.start(), m.end(), "unicode", out


def _packed(text: str) -> Iterator[tuple[int, int, str, str]]:
    """start, end, name and content of what runs of base64 hold, one after another."""
    for m in BASE64.finditer(text):
        body = m[0].rstrip("=").translate(_PLAIN)
        for name, out in _contents(body):
            yield m.start(), m.end(), name, out


def _beside(text: str, runs: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Spans that reach over the edge of a decoded run, once all runs stand decoded in the text.

    Ends within a run are those of the run.
    """
    parts, starts, at, size = [], [], 0, 0
    for a, b, out in runs:
        parts += [text[at:a], out]
        size += a - at
        starts.append(size)
        size += len(out)
        at = b
    whole = "".join(parts) + text[at:]

    def back(x: int, end: bool) -> tuple[int, int]:
        """The place in `text`, and the run that it lies in or -1."""
        i = bisect_right(starts, x - end) - 1
        if i < 0:
            return x, -1
        a, b, out = runs[i]
        return ((b if end else a), i) if x - end < starts[i] + len(out) else (b + x - starts[i] - len(out), -1)

    for a, b, kind in base_spans(whole):
        (x, i), (y, j) = back(a, False), back(b, True)
        if (i < 0 or i != j) and bisect_right(starts, b - 1) > bisect_right(starts, a) - (i >= 0):
            yield x, y, kind


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text, sorted by start and kind.

    The worklist holds layers whose inner layers are still being unwrapped,
    each with the span of the text that it came from. What a layer unwraps to
    joins the list unless the same content has been seen for that span, so
    cycles end and the list runs dry. The newest layer goes first and contents
    come one at a time, so a layer is held once for each depth. Spans found in
    a layer are mapped to the outermost encoded stretch and named after the
    chain, as in `base64>url>assign`. Compressed layers of any size are read
    to their end, in pieces that overlap; one that memory does not suffice for,
    or with a run of base64 over `LONGEST` in it, also has a span `...>unread`.
    """
    text = text or ""
    found = {(a, b, k) for a, b, k in base_spans(text)}
    todo = [_opened(text, None, "", found)]
    seen: set[tuple[tuple[int, int] | None, bytes]] = {(None, sha256(text.encode("utf-8", "surrogatepass")).digest())}
    while todo:
        item = next(todo[-1], None)
        if item is None:
            todo.pop()
            continue
        span, name, out = item
        if out is None:
            found.add((*span, f"{name}>unread"))
            continue
        mark = (span, sha256(out.encode("utf-8", "surrogatepass")).digest())
        if mark in seen:
            continue
        seen.add(mark)
        found |= {(*span, f"{name}>{kind}") for _, _, kind in base_spans(out)}
        todo.append(_opened(out, span, f"{name}>", found))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[0], order.get(x[2], 9), x[2], x[1]))


def _opened(layer: str, outer: tuple[int, int] | None, before: str, found: set) -> Iterator[tuple[tuple[int, int], str, str | None]]:
    """Span, chain and content of each layer within one; spans over the edges of decoded runs are added to `found`."""
    spelt = list(_spelt(layer))
    for name in ("url", "unicode"):
        if runs := [(a, b, out) for a, b, n, out in spelt if n == name]:
            found |= {(*(outer or (a, b)), f"{before}{name}>{kind}") for a, b, kind in _beside(layer, runs)}
    for a, b, name, out in chain(spelt, _packed(layer)):
        yield outer or (a, b), f"{before}{name}", out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, spans` for every row: an array of (kind, start, end), sorted by start.

    Offsets are code points of the row's own text, end exclusive. Null and
    empty texts have no spans; repeated rows come back each; an empty table
    gives no rows. Other columns are not looked at. One text is one worklist:
    memory is bounded by the text and, for each depth, one piece of a layer or
    its longest run of base64 up to `LONGEST`.
    """

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in scan(t)] for t in texts])

    return docs.select(F.col(id_col), of(F.col(text_col)).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with every span of the text replaced by `mark`; overlapping spans become one."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not t:
                return t
            out, at = [], 0
            for a, b, _ in scan(t):
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, b)
            return "".join(out) + t[at:]

        return pd.Series([one(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, of(F.col(text_col)))
