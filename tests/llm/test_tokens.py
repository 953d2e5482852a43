import random

import numpy as np
import pytest

from tests.llm.helpers import corpus, docs_of

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm.tokens import FREE, Compiled, token_counts, word_starts  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return Compiled(f.read()), Tokenizer.from_file(PATH)


def library(t, texts):
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_counts_equal_the_librarys(both):
    own, lib = both
    rng = random.Random(2)
    pieces = list("abcdestrelvmd  \n\t.,!?0123éüßÀ漢字😀\r\x1c²ⅷक_-\"’'") + ["<|endoftext|>", "'re", "'ll", "'s", "  ", " the", "ing", " ", "\x85"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["", " ", "  x", "x  ", "a\n\nb", "'s's're", " 's", "!'s", "<|endoftext|>", "<|endoftext|><|endoftext|> a", "e" * 5000, "ab" * 3000 + " " * 700 + "9" * 900]
    assert own.counts(texts).tolist() == library(lib, texts)


def test_chunks_compose_whatever_their_size(both, monkeypatch):
    from tessera.llm import tokens

    text = "don't  we'll\n\n x's 12ab!!'re  " * 20
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    first[0] = True
    want = word_starts(points, first).tolist()
    for size in (1, 3, 7, 1000):
        monkeypatch.setattr(tokens, "CHUNK", size)
        assert word_starts(points, first).tolist() == want
    assert FREE == 7


def test_long_words_are_composed_of_chunks(both, monkeypatch):
    from tessera.llm import tokens

    own, lib = both
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in (31, 32, 33, 64, 65, 500, 20_000)]
    texts += ["e" * n for n in (31, 32, 33, 5000, 100_000)] + ["ab" * 40_000, "=" * 3000, "漢字" * 4000, "-=" * 700 + "é" * 999, "internationalisation" * 800]
    want = library(lib, texts)
    assert own.counts(texts).tolist() == want
    for piece, rounds in ((3, 1), (7, 0), (32, 2), (1000, 8)):
        monkeypatch.setattr(tokens, "PIECE", piece)
        monkeypatch.setattr(tokens, "ROUNDS", rounds)
        own.machine.words.clear()
        assert own.counts(texts).tolist() == want


def test_operator(spark, both):
    rows = corpus()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs_of(spark, rows), PATH).collect())
    n = library(both[1], [r[1] for r in rows])
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), k, k > 1024) for r, k in zip(rows, n))
    assert token_counts(docs_of(spark, []), PATH).count() == 0


def test_other_kinds_of_files_are_refused():
    with open(P.path("word_bpe_49k.json"), "rb") as f, pytest.raises(ValueError):
        Compiled(f.read())
