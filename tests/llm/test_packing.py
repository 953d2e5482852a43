import json
import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import queries
from tessera.llm.packing import B, K1, QUERY_TERMS, Encoder, Shard, pack, powers_of_two
from tests.llm.helpers import corpus, docs_of

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(lib):
    rng = random.Random(8)
    odd = ["", " ", "It's  A Test x　y\x85z\x1cq", "a\nb\r\n\tc", "ΟΔΟΣ Σ ΣΑ", "é ́x", "<|endoftext|>a <|startoftext|>", "don't DON'T 'S's", "12 345", "漢字 かな", "🙂🙂 x", "İ İ", "a­b", "x" * 5000]
    odd += ["".join(rng.choice("ab 'sS\n\tÉé  .,1٣漢<|>") for _ in range(40)) for _ in range(300)]
    odd += [r[1] for r in corpus() if r[1]]
    with open(PATH, encoding="utf-8") as f:
        own = Encoder(f.read())
    assert own.by_chunk
    want = [e.ids for e in lib.encode_batch(odd, add_special_tokens=False)]
    for _ in range(2):  # then from what is kept
        assert [x.tolist() for x in own.ids(odd)] == want
    for known, parts in ((0, 10**9), (10**9, 0), (50, 90)):  # caches that start anew
        with pytest.MonkeyPatch.context() as m:
            m.setattr("tessera.llm.packing.MAX_CACHED", known)
            m.setattr("tessera.llm.packing.MAX_PARTS", parts)
            assert [x.tolist() for i in range(0, len(odd), 40) for x in own.ids(odd[i : i + 40])] == want
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        whole = Encoder(f.read())
    assert not whole.by_chunk and whole.ids(["a  b"])[0].tolist() == Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode("a  b").ids


def test_words_are_kept_once_whatever_their_case_and_marks(lib):
    rng = random.Random(4)
    with open(PATH, encoding="utf-8") as f:
        own = Encoder(f.read())
    texts = ["Über, ÜBER. (über) \"Über\" über: Über!", "Eau/eau-EAU, (eau) eau? EAU.\nEau: eau", "a\tÉté,été\x85ÉTÉ\xa0été."]
    assert [x.tolist() for x in own.ids(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert sum(map(str.isalpha, own.known)) == 4 and sum(map(str.isalpha, own.parts)) == 4
    assert all(len(s) == 1 for s in own.known if not s.isalpha())
    # every character of Latin-1 beside letters, digits, blanks, marks and itself, and texts of some of them
    odd = [x for c in map(chr, range(256)) for x in (c, f"a{c}B", f"É{c}", f"{c}É", f"1{c}2", f"x {c} y", f",{c}", f"{c}.", c + c, f"{c}'s", f"a'{c}", f"l'{c}a", f"B,{c}e")]
    odd += ["".join(rng.choice("ab' ÀÿßsS\n.,-1ªµ²½\x1c\xad÷×") for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    want = [e.ids for e in lib.encode_batch(odd, add_special_tokens=False)]
    for n in (1, 7, 5000):
        assert [x.tolist() for i in range(0, len(odd), n) for x in own.ids(odd[i : i + n])] == want
    flat, cuts = own.flat_ids(odd, 70_000)  # an end of more than 16 bits
    assert [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [x + [70_000] for x in want]
    # strings whose tokens could not be found are asked for again
    with pytest.MonkeyPatch.context() as m:
        m.setattr(own, "_learn_parts", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            own.ids(["unheard zzyzx"])
    assert own.ids(["zzyzx unheard"])[0].tolist() == lib.encode("zzyzx unheard", add_special_tokens=False).ids


def test_added_words_are_not_taken_apart():
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 49408, "content": "[X]"})
    raw = json.dumps(spec)
    texts = ["a [X] b", "(a)[X]", "x[x]y [X], Hello"]
    assert [x.tolist() for x in Encoder(raw).ids(texts)] == [e.ids for e in Tokenizer.from_str(raw).encode_batch(texts, add_special_tokens=False)]


def check(pieces, want, window):
    """`pieces` as (doc, start, length, ids, doc_tokens, sequence, offset), `want` the ids of each document."""
    docs, sequences = {}, {}
    for d, start, length, ids, total, sequence, offset in pieces:
        assert ids == want[d][start : start + length] and length > 0 and total == len(want[d])
        docs.setdefault(d, []).append((start, length))
        sequences.setdefault(sequence, []).append((offset, length))
    assert set(docs) == set(want)
    for rows, ends in ((docs, {d: len(x) for d, x in want.items()}), (sequences, None)):
        for name, parts in rows.items():
            at = 0
            for a, n in sorted(parts):
                assert a == at
                at += n
            assert at == ends[name] if ends else at == window or at & (at - 1) == 0 and at <= window
    return sequences


def test_every_id_in_one_piece(spark, lib):
    rows = [r for r in corpus() if r[0] is not None]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    want = {r[0]: lib.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows}
    for window, shard in ((2048, 1 << 21), (64, 500), (100, 3000)):
        out = pack(docs_of(spark, rows), PATH, window, shard_tokens=shard).collect()
        check([(r.doc_id, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens, r.sequence_id, r.offset) for r in out], want, window)


def test_odd_rows(spark):
    out = pack(docs_of(spark, [(None, None, None, None), (4, "", None, None), (4, "", None, None)]), PATH).collect()
    assert sorted(str(r.doc_id) for r in out) == ["4", "4", "None"]
    assert all((r.length, r.doc_tokens, r.ids) == (1, 1, b"\1\0\0\0") for r in out)
    assert pack(docs_of(spark, []), PATH).count() == 0
    with pytest.raises(ValueError):
        pack(docs_of(spark, []), PATH, window=0)


def plain_scores(ids, seed, n_docs, df, mean):
    idf = lambda t: math.log1p((n_docs - df[t] + 0.5) / (df[t] + 0.5))
    tf = [{t: x.count(t) for t in set(x)} for x in ids]
    top = sorted(tf[seed], key=lambda t: (-idf(t) * tf[seed][t], t))[:QUERY_TERMS]
    return [sum(idf(t) * f[t] * (K1 + 1) / (f[t] + K1 * (1 - B + B * len(x) / mean)) for t in top if t in f) for f, x in zip(tf, ids)]


def test_neighbours_are_those_of_bm25():
    rng = random.Random(3)
    ids = [[rng.randrange(rng.choice([20, 200])) for _ in range(rng.randrange(5, 60))] for _ in range(80)]
    df = np.bincount([t for x in ids for t in set(x)], minlength=200)
    mean = sum(map(len, ids)) / len(ids)
    shard = Shard([np.array(x) for x in ids], np.log1p((80 - df + 0.5) / (df + 0.5)), mean, 4096)
    shard.unused[[3, 9, 60]] = False
    for seed in range(80):
        score = plain_scores(ids, seed, 80, df, mean)
        got = list(shard.neighbours(seed))
        assert set(got) == {d for d in range(80) if score[d] > 0 and d not in (3, 9, 60)}
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_windows_are_filled_with_neighbours():
    rng = random.Random(5)
    topics = [[t * 100 + i for i in range(100)] for t in range(4)]
    ids = [np.array([rng.choice(topics[k % 4]) for _ in range(30)]) for k in range(80)]
    df = np.bincount([t for x in ids for t in set(x.tolist())], minlength=400)
    mixed = 0
    for parts in Shard(ids, np.log1p((80 - df + 0.5) / (df + 0.5)), 30.0, 120).sequences():
        mixed += len({d % 4 for d, _, _ in parts}) > 1
    assert mixed <= 3  # only where a topic has run out


def test_what_is_left_is_cut_into_powers_of_two():
    got = list(powers_of_two([(0, 0, 5), (1, 2, 10), (2, 0, 0 + 14)]))
    assert [sum(b - a for _, a, b in s) for s in got] == [16, 8, 2, 1]
    assert [x for s in got for d, a, b in s for x in [(d, i) for i in range(a, b)]] == [(d, i) for d, a, b in [(0, 0, 5), (1, 2, 10), (2, 0, 14)] for i in range(a, b)]


def test_query_over_a_whole_table(spark, lib):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op11_bm25_packing(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = out.collect()
    assert all(r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in rows)
    sequences = check([(r.doc_id, r.start, r.length, want[r.doc_id][r.start : r.start + r.length], r.doc_tokens, r.sequence_id, r.offset) for r in rows], want, 2048)
    full = sum(sum(n for _, n in s) == 2048 for s in sequences.values())
    assert full > 0.6 * len(sequences)
