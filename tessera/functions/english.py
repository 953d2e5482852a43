"""English words: the tokens of a text by their types, and the Snowball stemmer (Porter's second)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDS = "cdeghkmnrt"
#: Words with a stem of their own, words that stay, and words that stay once their plural is gone.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
WHOLE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Beginnings behind which the first region starts whatever they hold.
LEADS = ("gener", "commun", "arsen")
#: The suffixes of the second and third step and what takes their place, and those of the fourth.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _suffix(word: str, table) -> str | None:
    """The longest suffix of the word that the table has."""
    return max((s for s in table if word.endswith(s)), key=len, default=None)


def _short_end(w: str) -> bool:
    """Whether a word ends in a short syllable; Y stands for a y that is no vowel."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in "aeiouywxY"


def _regions(w: str) -> tuple[int, int]:
    """Where the two regions begin in which suffixes may go."""
    lead = next((x for x in LEADS if w.startswith(x)), None)
    m = _REGION.search(w)
    first = len(lead) if lead else m.end() if m else len(w)
    m = _REGION.search(w, first)
    return first, m.end() if m else len(w)


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; letters beyond a to z count as consonants."""
    if len(word) < 3:
        return word
    if word in OWN:
        return OWN[word]
    w = word.removeprefix("'")
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in WHOLE:
        return w
    # past and present
    end = _suffix(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # suffixes of other suffixes
    end = _suffix(w, SECOND)
    if end and len(w) - len(end) >= r1:
        base = w[: -len(end)]
        if (end != "ogi" or base.endswith("l")) and (end != "li" or base[-1:] in LI_ENDS and base):
            w = base + SECOND[end]
    end = _suffix(w, THIRD)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + THIRD[end]
    end = _suffix(w, FOURTH)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    # a last e or l
    n = len(w) - 1
    if w.endswith("e") and (n >= r2 or n >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and n >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(words: Column | str) -> Column:
    """The stems of a column of words."""
    return F.pandas_udf(lambda s: s.map(stem, na_action="ignore"), T.StringType())(words)


#: Repeated groups are bounded, as the matcher takes a step of its stack for each: labels of a host, parts of a version or a hyphenated word.
_HOST = r"[\p{L}\p{N}][\p{L}\p{N}-]*+(?:\.[\p{L}\p{N}][\p{L}\p{N}-]*+){0,30}\.\p{L}[\p{L}\p{N}]+"
#: The types of tokens, in the order in which they are tried; tags, entities and protocols are no terms.
TOKEN = (
    r"</?\p{L}[^<>]*>|&(?:#\d+|\p{L}+);|\p{L}[\p{L}\p{N}+]{0,30}://"
    rf"|[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._-]{{0,63}}+@{_HOST}|{_HOST}(?::\d+)?(?:/[^\s<>]*[^\s<>.,;:!?)])?"
    r"|\d+(?:\.\d+){2,30}|[-+]?\d+(?:\.\d+)?[eE][-+]?\d+(?![\p{L}\p{N}])|[-+]?\d+\.\d+(?![\p{L}\p{N}])"
    r"|(?=[\p{L}\p{N}]*\p{L})[\p{L}\p{N}\p{M}]+(?:-[\p{L}\p{N}\p{M}]*\p{L}[\p{L}\p{N}\p{M}]*){1,30}|[\p{L}\p{N}\p{M}]+"
)


def tokens(text: Column) -> Column:
    """The tokens of a text in their order, as an array of (token, word): `word` marks those that have a stem.

    A hyphenated word is a token and so is each of its parts; an address with
    a path is one, and so are its host and its path; mail addresses, hosts,
    versions and numbers with a sign, a point or an exponent are one token
    each, and have no stem, as words with digits have none.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    one = lambda t, word: F.struct(t.alias("token"), word.alias("word"))
    no = F.lit(False)

    def of(t: Column) -> Column:
        letters = t.rlike(r"^[\p{L}\p{M}]+$")
        parts = F.transform(F.split(t, "-"), lambda p: one(p, p.rlike(r"^[\p{L}\p{M}]+$")))
        host, path = F.substring_index(t, "/", 1), F.substr(t, F.instr(t, "/"))
        return (
            F.when(t.rlike(r"^(<|&)|://$"), F.array().cast("array<struct<token:string,word:boolean>>"))
            .when(t.rlike(r"@"), F.array(one(t, no)))
            .when(t.rlike(r"^[^/]+\.\p{L}[^/]*/."), F.array(one(t, no), one(host, no), one(path, no)))
            .when(t.rlike(r"^[\p{L}\p{N}\p{M}]+-[\p{L}\p{N}\p{M}-]+$") & ~t.rlike(r"^\d+e-"), F.concat(F.array(one(t, t.rlike(r"^[\p{L}\p{M}-]+$"))), parts))
            .otherwise(F.array(one(t, letters)))
        )

    return F.flatten(F.transform(found, of))
