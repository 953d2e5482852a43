import random

from pyspark.sql import functions as F

from tessera.llm.langid import identify, learn, subwords
from tests.llm.helpers import docs_of

SYLLABLES = {"aa": ["the", "ing", "and", "wh"], "bb": ["ung", "sch", "ein", "ü"], "cc": ["eau", "que", "é", "les"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_odd_texts(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, text(rng, lang, rng.randint(5, 80)), lang, "s"))
    odd = [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 !? 34", "aa", "s"), (903, text(rng, "bb", 200_000), None, None), (None, text(rng, "cc", 30), "cc", "s"), rows[0]]
    docs = docs_of(spark, [*rows, *odd])
    out = F.col("doc_id") % 3 == 1
    model = learn(docs, ~out)
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "bb" and got[None].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify(docs, model).count() == len(rows) + len(odd)
    again = {r.doc_id: r for r in identify(docs.repartition(5), learn(docs.repartition(5), ~out)).collect()}
    assert all(again[i].lang_pred == got[i].lang_pred and abs(again[i].score - got[i].score) < 1e-6 for i in got)


def test_nothing_to_learn(spark):
    docs = docs_of(spark, [(1, "abc", None, "s")])
    assert learn(docs, F.lit(True)) is None
    assert [tuple(r) for r in identify(docs, None).collect()] == [(1, "und", 0.0, False)]
    assert identify(docs_of(spark, []), None).count() == 0
    assert subwords("").sum() == 0 and subwords("ab").sum() == 1
