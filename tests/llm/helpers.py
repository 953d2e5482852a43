"""Small tables and plain counterparts for the tests of the text operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, size int, spans string, key string, h string, part int, id string, node int, uses int"


def docs_of(spark, rows):
    """Documents of (doc_id, text, lang, source), with columns of clashing names beside them."""
    return spark.createDataFrame([(*r, 1, "x", "y", "z", 2, "i", 3, 4) for r in rows], SCHEMA)


def word(rng, n=4):
    return "".join(rng.choice("abcdefgh") for _ in range(n))


def corpus(seed=3, n=60):
    """Texts with exact and near copies, shared passages, repeats, nulls, blanks and one very long text."""
    rng = random.Random(seed)
    passage = " ".join(word(rng) for _ in range(70))
    rows = []
    for i in range(n):
        w = [word(rng) for _ in range(rng.choice([3, 40, 120, 200]))]
        kind = i % 6
        if kind == 1 and rows:
            w = rows[-1][1].split() if rows[-1][1] else w
        elif kind == 2 and len(w) > 10:
            w = rows[-2][1].split() if rows[-2][1] else w
            if w:
                w[len(w) // 2] = "changed"
        elif kind == 3:
            w = [*w[:20], *passage.split(), *w[20:]]
        elif kind == 4:
            w = ["same"] * rng.choice([60, 130])
        rows.append((i, " ".join(w), "de" if i % 3 else "en", f"s{i % 3}"))
    rows += [(n, None, None, None), (n + 1, "", "en", "s0"), (n + 2, " \t\n ", "de", None), (n + 3, passage, "en", "s1")]
    rows.append((n + 4, " ".join(word(rng, 6) for _ in range(60_000)), "en", "s2"))
    rows += [rows[3], rows[3]]  # repeated rows
    rows.append((None, rows[0][1], "en", "s0"))
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")

