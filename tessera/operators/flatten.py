"""Nested JSON to rows of leaves, in built-in functions over VARIANT."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose content is lifted to the level above.
WRAPPERS = ["metadata", "scientificMetadata", "attributes"]
#: The keys that make an object one leaf: of its value, of its unit, and of its name or none; tried in this order.
SHAPES = [("v", "u", None), ("value", "unit", None), ("value", "units", "name")]
MAP, LIST = "map<string,variant>", "array<variant>"
NODE = "struct<key:string,value:variant,unit:variant,leaf:boolean>"


@dataclass
class Root:
    """A place of a record that holds leaves: its name, the prefix of their keys, and what of it counts.

    With `only_lists` anything but a list is empty; with `only_objects` (which
    takes a single object as a list of one) other entries go; `without` names
    keys of its entries that go, `inner` keys whose own content loses some.
    """

    name: str
    prefix: str = ""
    only_lists: bool = False
    only_objects: bool = False
    without: tuple[str, ...] = ()
    inner: dict[str, Callable[[Column, Column], Column]] | None = None


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _text(v: Column) -> Column:
    return _as(v, "string")


def node(key: Column, value: Column, unit: Column | None = None, leaf: bool = False) -> Column:
    return F.struct(key.cast("string").alias("key"), value.alias("value"), (F.lit(None).cast("variant") if unit is None else unit).alias("unit"), F.lit(leaf).alias("leaf")).cast(NODE)


def _nothing() -> Column:
    return F.array().cast(f"array<{NODE}>")


def _below(at: Column, k: Column) -> Column:
    """The key of what stands under `k` of an object whose own key is `at`."""
    return F.when(k.isin(WRAPPERS), at).when(at == "", k).otherwise(F.concat(at, F.lit("."), k))


def opened(at: Column, fields: Column) -> Column:
    """The nodes of an object, given as a map: one leaf if it has a shape of one, else one for each key."""
    found = F.transform(F.map_entries(fields), lambda e: node(_below(at, e["key"]), e["value"]))
    for value, unit, name in reversed(SHAPES):
        has = F.map_contains_key(fields, F.lit(value)) & F.map_contains_key(fields, F.lit(unit))
        key = at
        if name:
            has = has & F.map_contains_key(fields, F.lit(name))
            key = F.concat(at, F.lit("."), F.coalesce(shown(fields[name]), F.lit("None")))
        found = F.when(has, F.array(node(key, fields[value], fields[unit], True))).otherwise(found)
    return found


def _step(n: Column) -> Column:
    """A node's children; itself if it has none."""
    fields, items = _as(n["value"], MAP), _as(n["value"], LIST)
    deeper = F.when(fields.isNotNull(), opened(n["key"], fields)).when(items.isNotNull(), F.transform(items, lambda x: node(n["key"], x)))
    return F.when(n["leaf"], F.array(n)).otherwise(F.coalesce(deeper, F.array(node(n["key"], n["value"], None, True))))


def depth(raw: Column) -> Column:
    """How deep the brackets of a JSON text stand in each other at most, those inside strings left out."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\\.", ""), r'"[^"]*"', ""), r"[^\[\]{}]", "")
    at = F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, c: _deeper(a, a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)))
    return at["most"]


def _deeper(a: Column, now: Column) -> Column:
    return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))


def shown(v: Column) -> Column:
    """A scalar as text: `True` and `False`, whole numbers by their digits, others in the shortest form, from 1e16 on and under 1e-4 with an exponent; objects and lists as JSON."""
    kind, plain = F.schema_of_variant(v), _text(v)
    # a decimal without places may have been written with some; only digits beyond 64 bits are surely a whole number
    broken = (kind == "DOUBLE") | kind.startswith("DECIMAL") & ~((F.length(plain) > 18) & ~plain.contains("."))
    x = _as(v, "double")
    short, whole = F.format_string("%.15e", x), F.format_string("%.16e", x)
    shortest = F.when(short.cast("double") == x, short).otherwise(whole)
    e = F.substring_index(shortest, "e", -1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(shortest, "e", 1), r"[-.]", ""), r"(?<=.)0+$", "")
    first, rest, n = F.substr(digits, F.lit(1), F.lit(1)), F.substr(digits, F.lit(2)), F.length(digits)
    power = F.concat(first, F.when(n > 1, F.concat(F.lit("."), rest)).otherwise(""), F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    padded = F.rpad(digits, F.greatest(e + 2, n), "0")
    large = F.concat(F.substr(padded, F.lit(1), e + 1), F.lit("."), F.substr(padded, e + 2))
    finite = F.when((e < -4) | (e >= 16), power).when(e < 0, small).otherwise(large)
    number = F.concat(F.when(x < 0, "-").otherwise(""), F.when(F.abs(x) == float("inf"), "inf").otherwise(finite))
    return F.when(kind == "BOOLEAN", F.initcap(plain)).when(broken, number).otherwise(plain)


def _entries(root: Root, v: Column) -> Column:
    """The first nodes of a root: its entries, without what goes."""
    at, items, fields = F.lit(root.prefix), _as(v, LIST), _as(v, MAP)
    single = _nothing() if root.only_lists else F.when(v.isNotNull() & (F.lit(not root.only_objects) | fields.isNotNull()), F.array(node(at, v)))
    if not (root.without or root.inner or root.only_objects):
        return F.coalesce(F.when(items.isNotNull(), F.transform(items, lambda x: node(at, x))).otherwise(single), _nothing())

    def entry(x: Column) -> Column:
        own = F.map_filter(_as(x, MAP), lambda k, _: ~k.isin([*root.without, *(root.inner or {})]))
        found = opened(at, own)
        for key, less in (root.inner or {}).items():
            inner = _as(x, MAP)[key]
            found = F.concat(found, F.when(F.map_contains_key(_as(x, MAP), F.lit(key)), less(_below(at, F.lit(key)), inner)).otherwise(_nothing()))
        # an object that is one leaf has no other parts
        whole = opened(at, F.map_filter(_as(x, MAP), lambda k, _: ~k.isin([*root.without])))
        found = F.when((F.size(whole) == 1) & whole[0]["leaf"], whole).otherwise(found)
        other = _nothing() if root.only_objects else F.array(node(at, x))
        return F.when(_as(x, MAP).isNotNull(), found).otherwise(other)

    each = F.flatten(F.transform(items, entry))
    return F.coalesce(F.when(items.isNotNull(), each).otherwise(single), _nothing())


def leaves(doc: Column, raw: Column, roots: list[Root] | None = None) -> Column:
    """All leaves of a parsed JSON text as an array of nodes: every level is opened once, as often as the text is deep."""
    if roots is None:
        first = F.array(node(F.lit(""), doc))
    else:
        of = _as(doc, MAP)
        first = F.concat(*[_entries(r, of[r.name]) for r in roots])
    return F.aggregate(F.sequence(F.lit(0), depth(raw)), first.cast(f"array<{NODE}>"), lambda nodes, _: F.flatten(F.transform(nodes, _step)))


def flatten_json(df: DataFrame, id_col: str, raw_col: str, roots: list[Root] | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """`id_col, key, value, unit` for every leaf of nested JSON texts, or of those under `roots`.

    `keep`, given the parsed record, says which records count. Elements of a
    list repeat its key; wrapper keys vanish; an object with `v` and `u`, or
    `value` and `unit`, or `name`, `value` and `units` is one leaf with a unit,
    whatever else it holds, the last under its name. Values are trimmed text
    (see `shown`); nulls and blank keys give nothing, nor do null texts and
    those that Spark does not parse: no JSON, an object with one name twice,
    more than a thousand levels. Rows of a null id stay, repeated ones too; an
    empty table gives no rows; other columns are not looked at.
    """
    parsed = df.select(F.col(id_col).alias("__id"), F.col(raw_col).cast("string").alias("raw")).withColumn("doc", F.try_parse_json("raw")).filter("doc is not null")
    if keep is not None:
        parsed = parsed.filter(keep(F.col("doc")))
    each = parsed.select("__id", F.explode(leaves(F.col("doc"), F.col("raw"), roots)).alias("n")).filter("trim(n.key) <> ''")
    rows = each.select(F.col("__id").alias(id_col), F.col("n.key").alias("key"), F.trim(shown(F.col("n.value"))).alias("value"), F.trim(shown(F.col("n.unit"))).alias("unit"))
    return rows.filter("value is not null")
