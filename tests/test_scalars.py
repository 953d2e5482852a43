from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions.units import literal_si, to_si, unit_rows


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_keys_become_words(spark):
    got = one(spark, S.norm_key, "InstrumentDetector02Positioners", "a_b/c.d", "instrument.name", "HTTPServer", " x  y ")
    assert got == ["instrument detector 02 positioners", "a b c d", "instrument name", "http server", "x y"]


def test_booleans(spark):
    got = one(spark, S.to_bool, "true", " T ", "YES", "on", "off", "of", "n", "1", "0", "o", "", None, "truth")
    assert got == [True, True, True, True, False, False, False, None, None, None, None, None, None]


def test_numbers(spark):
    got = one(spark, S.to_double, "1", " -2.5e3 ", ".5", "5.", "1d", "1_000", "NaN", "", None, "0x1", "+7")
    assert got == [1.0, -2500.0, 0.5, 5.0, None, None, None, None, None, None, 7.0]
    assert one(spark, S.to_long, "12", "1.0", "-3", "x") == [12, None, -3, None]


def test_timestamps(spark):
    got = one(spark, lambda c: F.date_format(S.strict_timestamp(c), "yyyyMMddHHmmss"), "2023-01-02", "2023/01/02 03:04:05", " 2023.1.2 ", "2023", "now", "2023-02-30", "2023-01/02", None)
    assert got == ["20230102000000", "20230102030405", "20230102000000", None, None, None, None, None]
    assert one(spark, lambda c: S.to_ts(c).isNull(), "2023-01-02T03:04:05Z", "20230102") == [False, True]


def test_keywords(spark):
    df = spark.createDataFrame([(["special-char!", "ok"],), (["a b|c", "", "!"],), ([],), (["Überzug é1"],)], "k array<string>")
    assert [r[0] for r in df.select(S.keyword_terms(F.col("k"))).collect()] == [["specialchar", "ok"], ["a", "b", "c"], [], ["Überzug", "é1"]]


def test_names(spark):
    got = one(spark, S.split_names, "Else Marie Friis, Peter R. Crane", "Last, First", "A; B, C", "One Name", "a, b, c", "", "x y, z", " ; a ;")
    assert got == [["Else Marie Friis", "Peter R. Crane"], ["Last, First"], ["A", "B, C"], ["One Name"], ["a", "b", "c"], [], ["x y, z"], ["; a ;"]]


def test_values_with_units(spark):
    df = spark.createDataFrame([("5 keV", "energy"), ("-.5mm", "x"), ("5 miles", "x"), ("5 K", "Description"), ("5 K", "name"), ("5 K", "names")], "v string, k string")
    got = [r[0] and (r[0]["value"], r[0]["unit"]) for r in df.select(S.value_with_unit(F.col("v"), F.col("k"))).collect()]
    assert got == [("5", "keV"), ("-.5", "mm"), None, None, None, ("5", "K")]
    ends = one(spark, S.value_range, "1-5keV", "-1--0.5mm", "1-5", "a")
    assert [[tuple(x) for x in e] if e else None for e in ends] == [[(".min", "1", "keV"), (".max", "5", "keV")], [(".min", "-1", "mm"), (".max", "-0.5", "mm")], None, None]


def test_units(spark):
    rows = [(1.0, "°C"), (2.0, "MeV"), (2.0, "meV"), (2.0, "mev"), (5.0, "A"), (5.0, "Ang"), (1.0, "mg/ml"), (1.0, "YEARS"), (1.0, "rlu"), (1.0, ""), (1.0, None), (3.0, " cm "), (None, "cm"), (1.0, "GAUSS"), (1.0, "kHz")]
    got = [(r.value_si.magnitude, r.value_si.dim) if r.value_si else None for r in to_si(spark.createDataFrame(rows, "v double, u string"), "v", "u").orderBy(F.monotonically_increasing_id()).collect()]
    want = [(274.15, "K"), (3.204353268e-13, "J"), (3.204353268e-22, "J"), (3.204353268e-13, "J"), (5.0, "A"), (5e-10, "m"), (1.0, "kg/m^3"), (31557600.0, "s"), None, None, None, (0.03, "m"), None, (1e-4, "T"), (1e3, "s^-1")]
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (w is None or abs(g[0] - w[0]) <= 1e-12 * abs(w[0]) and g[1] == w[1])
    assert literal_si(2, "furlong") is None and literal_si(1, "percent") == (0.01, "")
    assert len({(r[0], r[1]) for r in unit_rows()}) == len(unit_rows())
