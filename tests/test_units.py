import math
import random
from fractions import Fraction

import pytest

from tessera.functions.units import BASES, PLAIN, POWERS, PREFIXES, parse_unit, to_si, unit_rows


def test_every_prefix_stands_before_every_base():
    for base, (factor, dim) in BASES.items():
        for prefix, times in PREFIXES.items():
            found = parse_unit(prefix + base)
            assert found is not None and found[2] in POWERS
            named = [r for r in unit_rows() if r[0] == prefix + base and not r[1]]
            assert len(named) == 1
    for unit, (factor, dim) in {"hPa": (100, "Pa"), "dm": (0.1, "m"), "daN": (10, "N"), "PHz": (1e15, "s^-1"), "mΩ": (1e-3, "ohm"), "µSv": (1e-6, "J/kg"), "EB": (1e18, "B"), "min": (60, "s"), "cd": (1, "cd"), "ft": (0.3048, "m"), "psi": (6894.757293168361, "Pa"), "T": (1, "T"), "G": (1e-4, "T"), "Pa": (1, "Pa"), "d": (86400, "s"), "h": (3600, "s"), "kcal": (4184, "J")}.items():
        got = parse_unit(unit)
        assert got is not None and math.isclose(got[0], factor, rel_tol=1e-12) and got[1:] == (0.0, dim), unit
    assert parse_unit("degF")[1] + parse_unit("degF")[0] * 212 == pytest.approx(373.15)
    for wrong in ("furlong", "xPa", "m^", "m^(1", "m^(1/0)", "kkm", "m^x", "^2"):
        assert parse_unit(wrong) is None, wrong


def test_products_follow_the_algebra():
    rng = random.Random(4)
    names = [p + b for b in BASES for p in ("", "k", "m", "da")] + list(PLAIN)
    for _ in range(500):
        value, powers, text = 1.0, {}, ""
        for i in range(rng.randrange(1, 4)):
            name, sign = rng.choice(names), rng.choice("*/") if i else "*"
            n = rng.choice([Fraction(1), Fraction(2), Fraction(-1), Fraction(1, 2), Fraction(3, 2), Fraction(-3)])
            mark = "" if n == 1 else rng.choice([f"^({n.numerator}/{n.denominator})", f"^({n.numerator})" if n.denominator == 1 else f"^{float(n)}" if n > 0 else f"^({n.numerator}/{n.denominator})"])
            text += (sign if i else "") + name + mark
            factor, _, dim = parse_unit(name)
            whole = n if sign == "*" else -n
            value *= factor ** float(whole)
            for k, p in POWERS[dim].items():
                powers[k] = powers.get(k, 0) + p * whole
        powers = {k: p for k, p in powers.items() if p}
        got = parse_unit(text)
        assert got is not None, text
        assert math.isclose(got[0], value, rel_tol=1e-9), text
        own = POWERS.get(got[2])
        if own is None:
            own = {part.split("^")[0]: Fraction(part.split("^")[1]) if "^" in part else 1 for part in got[2].split()}
        assert own == powers, (text, got[2])


def test_prefixed_and_rational_units_in_a_table(spark):
    rows = spark.createDataFrame([(1.0, "hPa"), (2.0, "V/Hz^0.5"), (50.0, "degF"), (3.0, "daN m"), (1.0, "nonsense"), (None, "dm"), (4.0, None)], "x double, u string")
    got = {r.u: r.value_si for r in to_si(rows, "x", "u").collect()}
    assert (got["hPa"].magnitude, got["hPa"].dim) == (100.0, "Pa")
    assert got["V/Hz^0.5"].magnitude == 2.0 and "s^-5/2" in got["V/Hz^0.5"].dim
    assert got["degF"].magnitude == pytest.approx(283.15) and got["daN m"].magnitude == pytest.approx(30) and got["daN m"].dim == "J"
    assert got["nonsense"] is None and got["dm"] is None and got[None] is None
