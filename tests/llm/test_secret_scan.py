import base64
import bz2
import gzip
import lzma
import random
import re
import zlib
from urllib.parse import quote

from tessera.llm.secret_scan import base_spans, find_secrets, redact, scan
from tests.llm.helpers import corpus, docs_of

PATTERNS = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}
KEY = "AKIA" + "Z9" * 8
TEXTS = [
    "", "password=hunter22", 'PassWord" :  "abcdef', "token=abc token=token=abcdef", f"x {KEY} y", "AKIAAKIA" + "A" * 15, "a" * 23 + " " + "b" * 24 + "g" + "0" * 30,
    "api_key: 'xx.yy-zz' apikey=1234567", "ſecret=abcdefg toKen=abcdefg", "é漢😀 secret = /path/to=thing", "secret=\nabcdef", KEY.lower(),
]


def test_base_spans_match_the_patterns():
    for t in TEXTS:
        want = {(m.start(), m.end(), k) for k, (p, ok) in PATTERNS.items() for m in re.finditer(p, t) if ok(m)}
        assert set(base_spans(t)) == want, t
        assert want <= set(scan(t))


def test_layers_are_unwrapped_to_the_last(spark):
    secret = f"key {KEY} end"
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    layers = {
        "base64": b64(secret),
        "url": quote(secret, safe="").replace("AKIA", "%41KIA"),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in secret),
        "gzip": b64(gzip.compress(secret.encode(), mtime=0)),
        "zlib": b64(zlib.compress(secret.encode())),
        "twice": b64(b64(secret)),
        "mixed": quote(b64("".join(f"\\x{ord(c):02x}" for c in secret)), safe="").replace("=", "%3D"),
    }
    for name, wrapped in layers.items():
        text = f"é before {wrapped} after"
        start = text.index(wrapped)
        got = [s for s in scan(text) if s[2].endswith("access")]
        assert any(s[0] == start and s[1] >= start + len(wrapped) - 3 for s in got), (name, scan(text))
    loop = "%25" * 50 + "41"
    scan(loop)  # ends


def test_operator(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [r for r in corpus(8, 12)]
    got = find_secrets(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), str([(k, a, b) for a, b, k in scan(r[1])])) for r in rows)
    assert sorted((str(r.doc_id), str([(s.kind, s.start, s.end) for s in r.spans])) for r in got) == want
    clean = {r.doc_id: r.text for r in redact(docs_of(spark, rows[:5])).collect()}
    assert clean[1] == "[secret]" and clean[4] == "x [secret] y" and clean[0] == ""
    assert find_secrets(docs_of(spark, [])).count() == 0


def test_very_long_texts_take_linear_time():
    scan("x" * 2_000_000 + "=" + "a%" * 200_000 + "\\" * 200_000)


def test_base64_is_read_whatever_its_alphabet_lines_and_place():
    noise = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(420))
    secret = f"{noise[:200]} password=hunter22xyz {noise[200:]}"
    packed = zlib.compress(secret.encode())
    gz = gzip.compress(b"nothing here", mtime=0) + gzip.compress(secret.encode(), mtime=0)
    b64 = base64.b64encode(packed).decode()
    for text in (base64.urlsafe_b64encode(packed).decode(), "\n".join(b64[i : i + 76] for i in range(0, len(b64), 76)), f"https://host/{b64}", f"https://host/a/{b64}", base64.b64encode(gz).decode()):
        assert any(k.endswith("gzip>assign") for _, _, k in scan(text)), text
    assert any(k == "base64>assign" for _, _, k in scan("//host/x/" + base64.b64encode(secret.encode()).decode()))


def test_keys_outside_the_encoded_run_and_bytes_that_are_no_text():
    for text, at, kind in (
        (r'"password": "hu\u006eter22xyz"', 1, "unicode>assign"),
        ("password: hu%6Eter22xyz", 0, "url>assign"),
        ("x%41 é password: hu%6Eter22xyz, b%42", 7, "url>assign"),
    ):
        got = scan(text)
        assert any(a == at and k == kind and b >= text.index("xyz") + 3 for a, b, k in got), (text, got)
    assert any(k == "url>assign" for _, _, k in scan("caf%E9/token%3Dabcdef123"))
    assert any(k == "url>assign" for _, _, k in scan("%01" * 40 + "token%3Dabcdef123"))
    assert not [k for _, _, k in scan("plain password: hunter22xyz and b%42") if k != "assign"]


def test_other_compressed_layers_and_their_members():
    secret = b"nothing here, then password=hunter22xyz"
    for pack in (bz2.compress, lzma.compress, lambda x: bz2.compress(b"first") + bz2.compress(x), lambda x: lzma.compress(b"first") + lzma.compress(x)):
        text = f"see {base64.b64encode(pack(secret)).decode()} there"
        assert any(k == "gzip>assign" and a == 4 for a, _, k in scan(text)), text
    scan(base64.b64encode(bz2.compress(secret)[:30]).decode())  # it breaks off


def test_compressed_layers_of_any_size_are_read_to_the_end():
    from tessera.llm.secret_scan import OVERLAP, PIECE, _Stream, _unfolded

    filler = "lorem ipsum é "
    for at in (70 << 20, PIECE - 10, 2 * PIECE - OVERLAP - 5, 3 * PIECE):
        big = bytearray((filler * (72 * (1 << 20) // len(filler.encode()))).encode())
        big[at : at + 21] = b" password=hunter22xy "
        packed = zlib.compress(bytes(big), 1)
        pieces = list(_unfolded(_Stream(packed)))
        assert len(pieces) > 3 and max(map(len, pieces)) <= PIECE + OVERLAP
        assert any(b"password=hunter22xy" in p for p in pieces)
    spans = scan(f"a {base64.b64encode(packed).decode()} z")
    assert any(k == "gzip>assign" for _, _, k in spans)


SECRET = "password=hunter22xyz"


def kinds(text):
    return {k for _, _, k in scan(text)}


def b64(raw):
    return base64.b64encode(raw).decode()


def test_what_stands_behind_a_compressed_member_is_read():
    gz = gzip.compress(b"nothing of note", mtime=0)
    assert any(k.endswith("assign") for k in kinds(b64(gz + f"\n{SECRET}".encode())))
    assert any(k.endswith("gzip>assign") for k in kinds(b64(gz + b"\0\1\2 between \3" + zlib.compress(SECRET.encode()))))
    assert any(k.endswith("assign") for k in kinds(b64(gz + bz2.compress(b"more")[:-9] + f" then {SECRET}".encode())))


def test_deflate_without_a_header():
    pack = zlib.compressobj(wbits=-15)
    raw = pack.compress(f"some text before {SECRET} and after".encode()) + pack.flush()
    assert "deflate>assign" in kinds(f"x {b64(raw)} y")
    rng = random.Random(3)
    for _ in range(300):
        assert not kinds(b64(rng.randbytes(rng.randrange(12, 400))))


def test_texts_of_two_bytes_a_character():
    for name in ("utf-16", "utf-16-le", "utf-16-be"):
        assert "base64>assign" in kinds(b64(f"é and {SECRET} there".encode(name)))
        assert any(k.endswith("assign") for k in kinds(b64(b"\xff\x00\x81" + SECRET.encode(name) + b"\x99" * 30)))
        assert "gzip>assign" in kinds(b64(gzip.compress(SECRET.encode(name), mtime=0)))


def test_wrapped_lines_that_are_indented():
    lines = b64(f"line after line of words, {SECRET}, and so on to the end".encode() * 3)
    for sep in ("\n  ", "\r\n\t", "\n"):
        assert "base64>assign" in kinds("data:\n" + sep.join(lines[i : i + 40] for i in range(0, len(lines), 40)))


def test_escapes_of_json():
    assert any(a == 0 and k == "unicode>assign" for a, _, k in scan(r'password=\/\/hun\/ter22'))
    assert "unicode>assign" in kinds(r'{"text": "{\"password\": \"hunter22xyz\"}"}')
    assert "unicode>base64>assign" in kinds('{"blob": "' + b64(f"???>>> {SECRET} ???>>>".encode()).replace("/", "\\/") + '"}')


def test_layers_that_need_much_memory_to_unfold():
    filters = [{"id": lzma.FILTER_LZMA2, "preset": 0, "dict_size": 400 << 20}]
    packed = lzma.compress(SECRET.encode(), filters=filters)
    assert "gzip>assign" in kinds(b64(packed))


def test_runs_longer_than_a_piece_within_a_layer(monkeypatch):
    from tessera.llm import secret_scan as S

    monkeypatch.setattr(S, "PIECE", 4096)
    monkeypatch.setattr(S, "OVERLAP", 512)
    monkeypatch.setattr(S, "LONGEST", 1 << 17)
    rng = random.Random(5)
    for size, sep in ((20_000, ""), (70_000, ""), (20_000, "\n"), (3000, "\r\n  ")):
        inner = b64(zlib.compress(rng.randbytes(size // 2) + SECRET.encode() + rng.randbytes(size // 4)))
        inner = sep.join(inner[i : i + 76] for i in range(0, len(inner), 76))
        for lead in (10, 4000, 9000):
            words = " ".join(str(rng.random()) for _ in range(lead // 18))
            outer = gzip.compress(f"{words} {inner} {words}".encode(), mtime=0)
            assert "gzip>gzip>assign" in kinds(b64(outer)), (size, sep, lead)
    long = b64(rng.randbytes(300_000))
    assert "gzip>unread" in kinds(b64(gzip.compress(f"a {long} b {SECRET}".encode(), mtime=0))) and "gzip>assign" in kinds(b64(gzip.compress(f"a {long} b {SECRET}".encode(), mtime=0)))
    assert not any(k.endswith("unread") for k in kinds(b64(gzip.compress(("words and lines\n" * 30_000).encode(), mtime=0))))


def peeled(text, depth=0):
    """All texts within a text, by trying everything everywhere: a slow counterpart for short texts."""
    yield text
    if depth > 4:
        return
    outs = {re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text), re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), text)}
    for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", text):
        for i in range(m.start(), m.end()):
            body = text[i : m.end()].rstrip("=")
            if len(body) < 16:
                break
            raw = base64.b64decode(body[: len(body) - (len(body) % 4 == 1)] + "=" * (-len(body) % 4))
            for out in (raw, *_tried(raw)):
                if out.isascii() and out.decode("ascii").isprintable():
                    outs.add(out.decode("ascii"))
    for out in outs - {text}:
        yield from peeled(out, depth + 1)


def _tried(raw):
    for pack in (gzip.decompress, zlib.decompress, bz2.decompress, lzma.decompress, lambda x: zlib.decompress(x, wbits=-15), lambda x: x.decode("utf-16-le").encode("ascii")):
        try:
            yield pack(raw)
        except Exception:  # noqa: BLE001
            pass


def test_layers_match_a_slow_decoder():
    rng = random.Random(11)
    wraps = [
        lambda t: base64.b64encode(t.encode()).decode(), lambda t: quote(t, safe="").replace("a", "%61"), lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(), lambda t: base64.b64encode(bz2.compress(t.encode())).decode(),
        lambda t: b64(zlib.compress(t.encode(), wbits=-15)), lambda t: b64(t.encode("utf-16-le")),
    ]
    for _ in range(60):
        inner = rng.choice(["token=abcdef123", "plain words only", f"id {KEY}", "x" * 30, "0123456789abcdef" * 2])
        for _ in range(rng.choice([1, 1, 2, 3])):
            inner = rng.choice(wraps)(inner)
        text = f"start {inner} end"
        want = {k for t in peeled(text) for _, _, k in base_spans(t)}
        got = {k.rsplit(">", 1)[-1] for _, _, k in scan(text)}
        assert want == got, (text, want, got)
