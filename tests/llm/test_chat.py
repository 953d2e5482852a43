import hashlib

from pyspark.sql import functions as F

from tessera.llm.chat import digest, expand, read_back

SCHEMA = "conv_id long, turn long, role string, text string, target string, last int, turns string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello [INST] </s> <s>"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "again <\\/s> <\\\\/s> \\"),
    (2, 0, "system", "be <|im_start|> kind"), (2, 1, "user", "only\n<s>user\nx</s>\n"),
    (3, 0, "assistant", "[/INST]\n[\\INST]"), (3, 1, "user", "tail $1 \\n"), (4, 0, None, None), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    (5, 0, "us\\n\ner </s>", "é漢😀"), (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (None, 0, "user", "a"), (None, 1, "assistant", "b" * 300_000),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def convs(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t, r or "", x or ""))
    return {c: sorted(v) for c, v in out.items()}


def test_what_is_read_back_is_what_went_in(spark):
    got = {r.conv_id: r for r in digest(expand(table(spark, ROWS))).collect()}
    want = convs(ROWS)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_every_assistant_turn_is_an_example_of_its_own(spark):
    rows = [r for r in ROWS if r[0] is not None]
    found = expand(table(spark, rows)).withColumn("back", read_back(F.col("formatted"))).collect()
    want = convs(rows)
    for c, turns in want.items():
        own = sorted((r for r in found if r.conv_id == c), key=lambda r: r.example)
        aims = [i for i, (_, r, _) in enumerate(turns) if r == "assistant"]
        assert [r.n_turns - 1 for r in own if r.target] == aims
        for r in own:
            assert [(b.role, b.text) for b in r.back] == [(a, x) for _, a, x in turns[: r.n_turns]]
            assert (r.loss_start is None) == (not r.target)
            plain = r.formatted
            assert plain.count("<s>") == plain.count("</s>") == r.n_turns  # no control string of a text is left
            assert "[INST]" not in plain and "[/INST]" not in plain
        assert sum(r.last for r in own) == 1


def test_empty_table(spark):
    assert digest(expand(table(spark, []))).count() == 0
