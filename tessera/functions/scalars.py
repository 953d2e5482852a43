"""Scalar functions: ranks, casts, names, keywords and values with units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as booleans, besides upper case and blanks around.
TRUE_WORDS = ["t", "tr", "tru", "true", "y", "ye", "yes", "on"]
FALSE_WORDS = ["f", "fa", "fal", "fals", "false", "n", "no", "of", "off"]
#: Units that stand behind a number in a value.
VALUE_UNITS = ["um", "K", "mm", "m", "°C", "A", "keV", "meV", "mA", "g", "k", "mg"]
#: Keys in which a number with a unit is not a measurement.
TEXT_KEYS = r"sampleParameters\.Formula|sample_name|Load|sample\.samplePreparation|sampleName|datasetName|description|keywords|^name$|abstract|proposalid|experimentalSettings\.filters|summary|title|comments"
FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_PARTS = [("-", "-"), ("/", "/"), (r"\.", ".")]


def rrf_score(rank: Column, k: Column | int = 50) -> Column:
    """1 / (rank + k); 0 for rank 0, null for a null rank."""
    k = k if isinstance(k, Column) else F.lit(k)
    return F.when(rank == 0, F.lit(0.0)).otherwise(F.lit(1.0) / (rank + k))


def to_bool(value: Column) -> Column:
    """true or false by the words above, else null; 1 and 0 are numbers, not booleans."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(TRUE_WORDS), F.lit(True)).when(v.isin(FALSE_WORDS), F.lit(False))


def to_double(value: Column) -> Column:
    """A finite number in plain or scientific notation, else null."""
    return F.when(value.rlike(FLOAT), F.trim(value).try_cast("double"))


def to_long(value: Column) -> Column:
    """An integer, else null."""
    return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("long"))


def strict_timestamp(value: Column) -> Column:
    """A date with `-`, `/` or `.` between its parts, with or without HH:mm:ss, else null.

    Months, days and hours may lack their leading zero, as parsers by format
    let them; words like `now` and bare years are no timestamps.
    """
    found = []
    for pattern, mark in DATE_PARTS:
        for time, layout in ((r" \d{1,2}:\d{1,2}:\d{1,2}", " H:m:s"), ("", "")):
            shape = rf"^\d{{4}}{pattern}\d{{1,2}}{pattern}\d{{1,2}}{time}$"
            found.append(F.when(F.trim(value).rlike(shape), F.try_to_timestamp(F.trim(value), F.lit(f"yyyy{mark}M{mark}d{layout}")).cast("timestamp_ntz")))
    return F.coalesce(*found)


def to_ts(value: Column) -> Column:
    """A strict timestamp or ISO 8601, unless the value is a number; else null."""
    iso = F.when(F.trim(value).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"), F.trim(value).try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(to_double(value).isNull(), F.coalesce(strict_timestamp(value), iso))


def norm_key(key: Column) -> Column:
    """`InstrumentDetector02` becomes `instrument detector 02`; `_`, `/` and `.` become spaces."""
    k = F.translate(key, "_/.", "   ")
    k = F.regexp_replace(k, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    k = F.regexp_replace(k, r"(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])", " ")
    return F.lower(F.trim(F.regexp_replace(k, r"\s+", " ")))


def safe_strip(value: Column, boolean: bool = False) -> Column:
    """The value as trimmed text; booleans are spelt True and False."""
    text = F.trim(value.cast("string"))
    return F.initcap(text) if boolean else text


def norm_text(value: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def keyword_terms(keywords: Column) -> Column:
    """The terms of a list of keywords: parted at blanks and pipes, letters and digits alone."""
    parts = F.split(F.concat_ws(" ", keywords), r"[\s|]+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", "")), lambda x: x != "")


def _parts(value: Column, mark: str) -> Column:
    return F.filter(F.transform(F.split(value, mark), lambda p: F.trim(p)), lambda p: p != "")


def split_names(value: Column) -> Column:
    """The names in a value: `;` always parts them.

    Commas part them too, unless there are just two parts of which one has no
    blank: that is "Last, First".
    """
    semi, comma = _parts(value, ";"), _parts(value, ",")
    one = F.filter(F.array(F.trim(value)), lambda p: p != "")
    last_first = (F.size(comma) == 2) & F.exists(comma, lambda p: ~p.contains(" "))
    return F.when(F.size(semi) > 1, semi).when((F.size(comma) < 2) | last_first, one).otherwise(comma)


def split_detail(value: Column, authors: Column) -> Column:
    """The parts of a detail value: of authors only if every part has a blank inside."""
    comma = _parts(value, ",")
    one = F.filter(F.array(F.trim(value)), lambda p: p != "")
    return F.when(authors & ~F.forall(comma, lambda p: p.contains(" ")), one).otherwise(comma)


def value_with_unit(value: Column, key: Column) -> Column:
    """A struct of number text and unit for values like `5 keV`, null for others and for text keys."""
    shape = rf"^(-?\d*\.{{0,1}}\d+)\s?({'|'.join(VALUE_UNITS)})$"
    return F.when(value.rlike(shape) & ~key.rlike(f"(?i){TEXT_KEYS}"), F.struct(F.regexp_extract(value, shape, 1).alias("value"), F.regexp_extract(value, shape, 2).alias("unit")))


def value_range(value: Column) -> Column:
    """The two ends of values like `1-5keV` as an array of (suffix, value, unit); null for others."""
    shape = r"^(-?\d*\.?\d+)-(-?\d*\.?\d+)([a-zA-Z]+)$"
    end = lambda suffix, g: F.struct(F.lit(suffix).alias("suffix"), F.regexp_extract(value, shape, g).alias("value"), F.regexp_extract(value, shape, 3).alias("unit"))
    return F.when(value.rlike(shape), F.array(end(".min", 1), end(".max", 2)))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def is_close(a: Column, b: Column) -> Column:
    """Equal but for a relative 1e-9 or an absolute 1e-12."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of a row's canonical JSON, to compute equal requests once."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cos; null for a vector of length 0."""
    norms = (F.sqrt(dot(a, a)) if norm_a is None else norm_a) * (F.sqrt(dot(b, b)) if norm_b is None else norm_b)
    return F.lit(1.0) - F.when(norms > 0, dot(a, b) / norms)
