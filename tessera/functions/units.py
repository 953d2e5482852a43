"""Units to SI: a table made by rule, the joins that apply it, and a parser of products and powers of its units."""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names with one meaning, (factor, offset, dimension), exact case.
NAMED = {
    **dict.fromkeys(["C", "degC", "°C", "oC", "celsius", "Celsius"], (1.0, 273.15, "K")),
    **dict.fromkeys(["K", "k", "Kelvin", "kelvin"], (1.0, 0.0, "K")),
    **dict.fromkeys(["degF", "°F", "oF", "fahrenheit", "Fahrenheit"], (5 / 9, 273.15 - 32 * 5 / 9, "K")),
    "A": (1.0, 0.0, "A"),
    **dict.fromkeys(["Å", "AA", "Ang", "ang", "Angstrom", "angstrom", "Angström", "angström"], (1e-10, 0.0, "m")),
    **dict.fromkeys(["1/Å²", "1/Å^2", "1/AA^2", "1/Ang^2", "1/ang^2", "1/Angstrom^2", "1/angstrom^2"], (1e20, 0.0, "m^-2")),
    "G": (1e-4, 0.0, "T"),
    "MeV": (1.602176634e-13, 0.0, "J"),
    "meV": (1.602176634e-22, 0.0, "J"),
    "keV": (1.602176634e-16, 0.0, "J"),
    "ueV": (1.602176634e-25, 0.0, "J"),
    "eV": (1.602176634e-19, 0.0, "J"),
    **dict.fromkeys(["mg/ml", "mg/mL", "mg_per_ml", "mg per ml"], (1.0, 0.0, "kg/m^3")),
    **dict.fromkeys(["kDa", "KDa", "kda"], (1.66053906660e-24, 0.0, "kg")),
    "Degree": (0.017453292519943295, 0.0, ""),
    "Bytes": (1.0, 0.0, "B"),
    "Gy": (1.0, 0.0, "J/kg"),
    "kGy": (1e3, 0.0, "J/kg"),
    "Gy/s": (1.0, 0.0, "J/kg/s"),
}
#: Names in any case, tried where the exact ones fail.
ANY_CASE = {
    **dict.fromkeys(["%", "percent", "percentage"], (0.01, 0.0, "")),
    **dict.fromkeys(["ampere", "amp", "amps", "amperes"], (1.0, 0.0, "A")),
    "gauss": (1e-4, 0.0, "T"),
    "mev": (1.602176634e-13, 0.0, "J"),
    "kev": (1.602176634e-16, 0.0, "J"),
    "ev": (1.602176634e-19, 0.0, "J"),
    "uev": (1.602176634e-25, 0.0, "J"),
    **dict.fromkeys(["year", "years", "yr", "yrs"], (31557600.0, 0.0, "s")),
    "hertz": (1.0, 0.0, "s^-1"),
    **dict.fromkeys(["second", "seconds", "sec", "secs"], (1.0, 0.0, "s")),
    "gy": (1.0, 0.0, "J/kg"),
    "kgy": (1e3, 0.0, "J/kg"),
    "gy/s": (1.0, 0.0, "J/kg/s"),
}
#: The prefixes of the SI, with three ways to write micro.
PREFIXES = {
    "": 1.0, "q": 1e-30, "r": 1e-27, "y": 1e-24, "z": 1e-21, "a": 1e-18, "f": 1e-15, "p": 1e-12, "n": 1e-9, "µ": 1e-6, "μ": 1e-6, "u": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1,
    "da": 1e1, "h": 1e2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18, "Z": 1e21, "Y": 1e24, "R": 1e27, "Q": 1e30,
}
#: Units that take a prefix, and units that do not.
BASES = {
    "m": (1.0, "m"), "g": (1e-3, "kg"), "s": (1.0, "s"), "A": (1.0, "A"), "K": (1.0, "K"), "T": (1.0, "T"), "Hz": (1.0, "s^-1"), "J": (1.0, "J"), "W": (1.0, "W"),
    "Pa": (1.0, "Pa"), "bar": (1e5, "Pa"), "V": (1.0, "V"), "N": (1.0, "N"), "B": (1.0, "B"), "rad": (1.0, ""), "deg": (0.017453292519943295, ""), "L": (1e-3, "m^3"), "l": (1e-3, "m^3"), "mol": (1.0, "mol"), "C": (1.0, "C"), "eV": (1.602176634e-19, "J"),
    "F": (1.0, "F"), "ohm": (1.0, "ohm"), "Ω": (1.0, "ohm"), "Ω": (1.0, "ohm"), "S": (1.0, "S"), "Wb": (1.0, "Wb"), "H": (1.0, "H"), "Bq": (1.0, "s^-1"), "Gy": (1.0, "J/kg"), "Sv": (1.0, "J/kg"), "kat": (1.0, "kat"), "cd": (1.0, "cd"), "lm": (1.0, "cd"), "lx": (1.0, "cd/m^2"), "sr": (1.0, ""), "Da": (1.66053906660e-27, "kg"), "t": (1e3, "kg"),
}
PLAIN = {
    "min": (60.0, "s"), "h": (3600.0, "s"), "hour": (3600.0, "s"), "d": (86400.0, "s"), "day": (86400.0, "s"), "in": (0.0254, "m"), "inch": (0.0254, "m"), "inches": (0.0254, "m"), "ft": (0.3048, "m"), "foot": (0.3048, "m"), "feet": (0.3048, "m"), "yd": (0.9144, "m"), "mi": (1609.344, "m"), "mile": (1609.344, "m"), "miles": (1609.344, "m"),
    "nmi": (1852.0, "m"), "au": (149597870700.0, "m"), "ly": (9460730472580800.0, "m"), "lb": (0.45359237, "kg"), "oz": (0.028349523125, "kg"), "lbf": (4.4482216152605, "N"), "psi": (6894.757293168361, "Pa"), "atm": (101325.0, "Pa"), "torr": (101325.0 / 760, "Pa"), "Torr": (101325.0 / 760, "Pa"), "mmHg": (133.322387415, "Pa"),
    "cal": (4.184, "J"), "kcal": (4184.0, "J"), "BTU": (1055.05585262, "J"), "hp": (745.6998715822702, "W"), "gal": (0.003785411784, "m^3"), "ha": (1e4, "m^2"), "b": (1e-28, "m^2"), "barn": (1e-28, "m^2"), "rpm": (1 / 60, "s^-1"), "dyn": (1e-5, "N"), "erg": (1e-7, "J"), "bit": (0.125, "B"), "week": (604800.0, "s"), "arcmin": (0.017453292519943295 / 60, ""), "arcsec": (0.017453292519943295 / 3600, ""),
}


def unit_rows() -> list[tuple[str, bool, float, float, str]]:
    """unit, whether in any case, factor, offset, dimension: named units first, then those without a prefix, then prefix times base."""
    rows = {u: v for u, v in NAMED.items()}
    for unit, (factor, dim) in PLAIN.items():
        rows.setdefault(unit, (factor, 0.0, dim))
    for base, (factor, dim) in BASES.items():
        for prefix, times in PREFIXES.items():
            rows.setdefault(prefix + base, (times * factor, 0.0, dim))
    return [(u, False, *v) for u, v in rows.items()] + [(u, True, *v) for u, v in ANY_CASE.items()]


def unit_table(spark: SparkSession) -> DataFrame:
    """The table of all units; its size is fixed."""
    return spark.createDataFrame(unit_rows(), "unit string, any_case boolean, factor double, offset double, dim string")


#: The dimensions that have names, by powers of the base ones.
POWERS = {
    "": {}, "m": {"m": 1}, "kg": {"kg": 1}, "s": {"s": 1}, "A": {"A": 1}, "K": {"K": 1}, "mol": {"mol": 1}, "B": {"B": 1}, "T": {"kg": 1, "s": -2, "A": -1}, "J": {"kg": 1, "m": 2, "s": -2},
    "W": {"kg": 1, "m": 2, "s": -3}, "Pa": {"kg": 1, "m": -1, "s": -2}, "V": {"kg": 1, "m": 2, "s": -3, "A": -1}, "N": {"kg": 1, "m": 1, "s": -2}, "C": {"A": 1, "s": 1}, "s^-1": {"s": -1}, "m^-2": {"m": -2}, "m^3": {"m": 3},
    "kg/m^3": {"kg": 1, "m": -3}, "J/kg": {"m": 2, "s": -2}, "J/kg/s": {"m": 2, "s": -3},
    "F": {"A": 2, "s": 4, "kg": -1, "m": -2}, "ohm": {"kg": 1, "m": 2, "s": -3, "A": -2}, "S": {"A": 2, "s": 3, "kg": -1, "m": -2}, "Wb": {"kg": 1, "m": 2, "s": -2, "A": -1}, "H": {"kg": 1, "m": 2, "s": -2, "A": -2}, "kat": {"mol": 1, "s": -1}, "cd": {"cd": 1}, "cd/m^2": {"cd": 1, "m": -2}, "m^2": {"m": 2},
}
_NAMES = {tuple(sorted(p.items())): name for name, p in POWERS.items()}
_SIGNS = str.maketrans({"·": "*", "×": "*", "⋅": "*", "²": "2", "³": "3", "⁻": "-", "¹": "1", "⁴": "4"})
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d_]+|[°%Ω]\w*)|(?P<sign>[*/^()-]))")


@lru_cache(1)
def _known() -> tuple[dict, dict]:
    exact = {r[0]: r[2:] for r in unit_rows() if not r[1]}
    return exact, {r[0]: r[2:] for r in unit_rows() if r[1]}


def _single(name: str) -> tuple[float, float, str] | None:
    exact, loose = _known()
    return exact.get(name) or loose.get(name.lower())


@lru_cache(10_000)
def parse_unit(unit: str) -> tuple[float, float, str] | None:
    """(factor, offset, dimension) of a unit: a known one, or products, quotients and powers of known ones; else None.

    `m/s`, `1/cm`, `kg*m^2/s2`, `J per (kg K)`, `cm⁻¹`, `V/Hz^0.5` and `m^(1/2)` are such; a space
    multiplies. Within a product a temperature counts as a difference.
    """
    unit = unit.strip()
    if (found := _single(unit)) or not unit:
        return found
    text = re.sub(r"\bper\b", "/", unit.translate(_SIGNS))
    parts, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            return None
        if m.lastgroup:
            parts.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    parts.append(("end", ""))
    place = 0

    def power() -> Fraction:
        """A power behind a name, a whole number or behind `^` any fraction: with or without a sign and brackets."""
        nonlocal place
        start, raised, closed = place, parts[place] == ("sign", "^"), False
        if raised:
            place += 1
            if parts[place] == ("sign", "("):
                place, closed = place + 1, True
        minus = parts[place] == ("sign", "-")
        place += minus
        if parts[place][0] != "number" or not (raised or parts[place][1].isdigit()):
            if place > start:
                raise ValueError(unit)
            return Fraction(1)
        n = Fraction(parts[place][1])
        place += 1
        if closed:
            if parts[place] == ("sign", "/") and parts[place + 1][0] == "number":
                n /= Fraction(parts[place + 1][1])
                place += 2
            if parts[place] != ("sign", ")"):
                raise ValueError(unit)
            place += 1
        return -n if minus else n

    def factor() -> tuple[float, dict]:
        nonlocal place
        kind, x = parts[place]
        place += 1
        if kind == "number":
            return float(x), {}
        if (kind, x) == ("sign", "("):
            value, powers = product()
            if parts[place] != ("sign", ")"):
                raise ValueError(unit)
            place += 1
        elif kind == "name" and (known := _single(x)):
            value, powers = known[0], POWERS[known[2]]
        else:
            raise ValueError(unit)
        n = power()
        return value ** (int(n) if n.denominator == 1 else float(n)), {k: p * n for k, p in powers.items()}

    def product() -> tuple[float, dict]:
        nonlocal place
        value, powers = factor()
        while parts[place][0] in ("number", "name") or parts[place] in (("sign", "*"), ("sign", "/"), ("sign", "(")):
            sign = 1
            if parts[place][1] in "*/" and parts[place][0] == "sign":
                sign = 1 if parts[place][1] == "*" else -1
                place += 1
            v, p = factor()
            value *= v**sign
            powers = {k: n for k in {*powers, *p} if (n := powers.get(k, 0) + sign * p.get(k, 0))}
        return value, powers

    try:
        value, powers = product()
    except (ValueError, ZeroDivisionError, OverflowError):
        return None
    if parts[place][0] != "end":
        return None
    key = tuple(sorted(powers.items()))
    return value, 0.0, _NAMES.get(key, " ".join(k if n == 1 else f"{k}^{n}" for k, n in key))


@F.pandas_udf(T.StructType([T.StructField("factor", T.DoubleType()), T.StructField("offset", T.DoubleType()), T.StructField("dim", T.StringType())]))
def parsed_units(units: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_unit(u) or (None, None, None) for u in units], columns=["factor", "offset", "dim"])


def to_si(df: DataFrame, value: str, unit: str, out: str = "value_si") -> DataFrame:
    """`df` with `out`, a struct of magnitude in SI and dimension; null for unknown and blank units and `rlu`.

    The fixed table of units is broadcast: names in exact case first, then in
    any. Other units are parsed as products and powers of known ones, each
    distinct one once. All columns and rows of `df` stay.
    """
    table = unit_table(df.sparkSession)
    exact = table.filter("not any_case").select(F.col("unit").alias("__u"), F.struct("factor", "offset", "dim").alias("__exact"))
    loose = table.filter("any_case").select(F.col("unit").alias("__l"), F.struct("factor", "offset", "dim").alias("__loose"))
    known = F.trim(F.col(unit))
    both = df.join(F.broadcast(exact), known == F.col("__u"), "left").join(F.broadcast(loose), F.lower(known) == F.col("__l"), "left")
    u = F.coalesce("__exact", "__loose")
    rest = both.filter(u.isNull() & known.rlike(r"[\d*/^·×⋅²³⁻¹⁴\s]")).select(known.alias("__r")).distinct().select("__r", parsed_units("__r").alias("__parsed")).filter("__parsed.factor is not null")
    both = both.join(rest, F.when(u.isNull(), known) == F.col("__r"), "left")
    u = F.coalesce("__exact", "__loose", "__parsed")
    si = F.when(u.isNotNull() & F.col(value).isNotNull(), F.struct((F.col(value).cast("double") * u["factor"] + u["offset"]).alias("magnitude"), u["dim"].alias("dim")))
    return both.withColumn(out, si).drop("__u", "__l", "__r", "__exact", "__loose", "__parsed")


def literal_si(value: float, unit: str) -> tuple[float, str] | None:
    """A number with a unit as (magnitude, dimension), or None."""
    found = parse_unit(unit)
    return (value * found[0] + found[1], found[2]) if found else None


def si_text(magnitude: Column) -> Column:
    """A magnitude at twelve significant digits, to compare for equality."""
    return F.when(magnitude.isNotNull(), F.format_string("%.11e", magnitude))
