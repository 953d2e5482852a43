"""Attribute rows: from nested JSON and wide tables, and everything derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import norm_key, split_names, to_bool, to_double, to_ts, value_range, value_with_unit
from tessera.functions.units import to_si
from tessera.operators.flatten import LIST, MAP, Root, flatten_json, node, opened
from tessera.operators.tables import insert_absent

#: The root that marks a publication; what its entries lose: files, hidden parameters, and the XML of their attributes.
PUBLICATION_MARK = "collection"
FILES, PARAMETERS, HIDDEN, ATTRIBUTES, XML = "datafiles", "parameters", "__", "attributes", "xml"
#: Keys that name a beamline.
BEAMLINE_KEYS = ["instrument.name", "instrumentName", "instrumentGroup", "measurement.beamline"]
#: Publishers and the names that stand for them, applied in this order.
PUBLISHERS = [
    ("ESRF", "European Synchrotron Radiation Facility"),
    ("European Synchrotron Radiation Facility", "ESRF"),
    ("PSI", "Paul Scherrer Institute"),
    ("PSI LMU", "Paul Scherrer Institute"),
    ("ILL", "Institut Laue-Langevin"),
    ("ESS", "European Spallation Source"),
    ("MAX IV Laboratory, Lund University", "MAX IV"),
    ("MAXIV", "MAX IV Laboratory"),
    ("MAX IV", "MAX IV Laboratory"),
]
NO_UNITS = ["na", "none", ""]


def unpivot(df: DataFrame, id_col: str, columns: list[str], units: dict[str, str] | None = None) -> DataFrame:
    """`doc_id, key, value, unit`: a row for each of `columns` that is not null."""
    units = units or {}
    pairs = ", ".join(f"'{c}', cast(`{c}` as string), {repr(units[c]) if c in units else 'cast(null as string)'}" for c in columns)
    return df.select(F.col(id_col).alias("doc_id"), F.expr(f"stack({len(columns)}, {pairs}) as (key, value, unit)")).filter("value is not null")


def _open_shown(key: Column, v: Column) -> Column:
    """The nodes of a list of parameters, hidden ones left out; of anything else itself."""
    name = lambda p: F.coalesce(F.try_variant_get(p, "$.name", "string"), F.lit(""))
    items = F.filter(F.try_variant_get(v, "$", LIST), lambda p: ~name(p).startswith(HIDDEN))
    return F.when(items.isNotNull(), F.transform(items, lambda p: node(key, p))).otherwise(F.array(node(key, v)))


def _open_without_xml(key: Column, v: Column) -> Column:
    """The nodes of an object without its XML; of anything else itself."""
    fields = F.map_filter(F.try_variant_get(v, "$", MAP), lambda k, _: k != XML)
    return F.when(fields.isNotNull(), opened(key, fields)).otherwise(F.array(node(key, v)))


#: The roots that hold a standard record's attributes, and a publication's, with the prefix of their keys.
STANDARD_ROOTS = [Root("document"), Root("panosc"), Root("datasets", only_objects=True), Root("datacite"), Root("catalogue")]
PUBLICATION_ROOTS = [
    Root("panosc"), Root("samples", "samples", only_lists=True, without=(FILES,), inner={PARAMETERS: _open_shown}), Root("datasets", only_lists=True, only_objects=True, without=(FILES,), inner={PARAMETERS: _open_shown}),
    Root("datacite", only_lists=True, inner={ATTRIBUTES: _open_without_xml}), Root("users", "users"), Root("reports", "reports"), Root("citations", "citations"), Root("instruments", "instruments"), Root("investigation", "investigation"),
]


def attribute_rows(flat: DataFrame, id_col: str = "doc_id", kind: str = "EXPLICIT") -> DataFrame:
    """`doc_id, key, value, unit, type`: blank keys dropped, equal rows of a document kept once."""
    rows = flat.filter(F.trim(F.coalesce("key", F.lit(""))) != "")
    return rows.select(F.col(id_col).alias("doc_id"), F.trim("key").alias("key"), F.trim("value").alias("value"), F.trim("unit").alias("unit"), F.lit(kind).alias("type")).distinct()


def _marked(doc: Column) -> Column:
    return F.coalesce(F.map_contains_key(F.try_variant_get(doc, "$", MAP), F.lit(PUBLICATION_MARK)), F.lit(False))


def publication_attributes(records: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """Attribute rows of publications: records that have a `collection`."""
    return attribute_rows(flatten_json(records, id_col, raw_col, PUBLICATION_ROOTS, _marked), id_col)


def standard_attributes(records: DataFrame, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """Attribute rows of standard records: those without a `collection`."""
    return attribute_rows(flatten_json(records, id_col, raw_col, STANDARD_ROOTS, lambda doc: ~_marked(doc)), id_col)


def key_registry(attributes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """`name, text`: keys that are not known yet, with the text to embed."""
    new = attributes.select(F.col("key").alias("name")).filter("name is not null").distinct()
    if known is not None:
        new = new.join(known.select("name"), "name", "left_anti")
    return new.select("name", norm_key(F.col("name")).alias("text"))


def derived_publisher(docs: DataFrame, facilities: DataFrame, attributes: DataFrame) -> DataFrame:
    """A derived `publisher`, the facility's name, for each document without one."""
    there = attributes.filter("key = 'publisher' and type = 'DERIVED'").select("doc_id").distinct()
    rows = docs.select("doc_id", "facility_id").join(facilities.select("facility_id", F.col("name").alias("value")), "facility_id")
    return rows.join(there, "doc_id", "left_anti").select("doc_id", F.lit("publisher").alias("key"), "value", F.lit(None).cast("string").alias("unit"), F.lit("DERIVED").alias("type"))


def closure(mapping: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """All (value, derived) pairs that come of the ordered mapping, each step seeing the rows before it."""
    out = []
    for start in dict.fromkeys(k for k, _ in mapping):
        have = [start]
        for k, v in mapping:
            if k in have and v not in have:
                have.append(v)
        out += [(start, v) for v in have[1:]]
    return out


def harmonised_publishers(attributes: DataFrame, mapping: list[tuple[str, str]] | None = None) -> DataFrame:
    """Derived `publisher` rows by the closure of the mapping, those that are there left out."""
    pairs = F.broadcast(attributes.sparkSession.createDataFrame(closure(mapping or PUBLISHERS), "value string, derived string"))
    own = attributes.filter("key = 'publisher'").select("doc_id", "value").distinct()
    new = own.join(pairs, "value").select("doc_id", F.col("derived").alias("value")).distinct().join(own, ["doc_id", "value"], "left_anti")
    return new.select("doc_id", F.lit("publisher").alias("key"), "value", F.lit(None).cast("string").alias("unit"), F.lit("DERIVED").alias("type"))


def derived_beamlines(attributes: DataFrame, docs: DataFrame, facilities: list[str], keys: list[str] | None = None, facility_col: str = "facility") -> DataFrame:
    """Derived `beamline` rows from the instrument keys of the given facilities' documents."""
    of = docs.filter(F.col(facility_col).isin(facilities)).select("doc_id")
    rows = attributes.filter(F.col("key").isin(keys or BEAMLINE_KEYS) & (F.col("value") != "")).join(of, "doc_id", "left_semi")
    there = attributes.filter("key = 'beamline' and type = 'DERIVED'").select("doc_id", "value")
    new = rows.select("doc_id", "value").distinct().join(there, ["doc_id", "value"], "left_anti")
    return new.select("doc_id", F.lit("beamline").alias("key"), "value", F.lit(None).cast("string").alias("unit"), F.lit("DERIVED").alias("type"))


def derived_measurements(attributes: DataFrame) -> DataFrame:
    """Derived rows of values with a unit in them, and of ranges as `<key>.min` and `<key>.max`; one pass, then what is there is left out."""
    one = F.when(value_with_unit(F.col("value"), F.col("key")).isNotNull(), F.array(F.struct(F.lit("").alias("suffix"), value_with_unit(F.col("value"), F.col("key"))["value"].alias("value"), value_with_unit(F.col("value"), F.col("key"))["unit"].alias("unit"))))
    found = attributes.select("doc_id", "key", F.explode(F.coalesce(one, value_range(F.col("value")))).alias("d"))
    new = found.select("doc_id", F.concat("key", "d.suffix").alias("key"), "d.value", "d.unit", F.lit("DERIVED").alias("type")).distinct()
    return insert_absent(new, attributes, ["doc_id", "key", "value", "unit", "type"])


def split_value_rows(attributes: DataFrame, keys: list[str]) -> DataFrame:
    """A derived row for each name of values that hold several; `parts` tells their number."""
    rows = attributes.filter(F.col("key").isin(keys) & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    names = rows.withColumn("names", split_names(F.col("value"))).filter(F.size("names") > 1)
    return names.select("doc_id", "key", F.explode("names").alias("value"), "unit", F.lit("DERIVED").alias("type"), F.size("names").alias("parts")).distinct()


def typed(attributes: DataFrame) -> DataFrame:
    """`attributes` with `value_boolean, value_numeric, value_timestamp, value_si`; null where a value is not of the kind."""
    rows = attributes.withColumns({"value_boolean": to_bool(F.col("value")), "value_numeric": to_double(F.col("value")), "value_timestamp": to_ts(F.col("value"))})
    usable = F.when(~F.lower(F.trim(F.coalesce("unit", F.lit("")))).isin(NO_UNITS), F.col("unit"))
    return to_si(rows.withColumn("__unit", usable), "value_numeric", "__unit").drop("__unit")
