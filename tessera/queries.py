"""The registered queries of the engine's operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import metrics, scalars
from tessera.functions.embed import STOP_WORDS
from tessera.functions.units import si_text, to_si
from tessera.operators import attributes as A
from tessera.operators import chunks, conditions, evaluate, inferred, postrank, tables, text, vectors
from tessera.plans import hybrid
from tessera.registry import QUERIES, SQL, Query, new_folder, register, table
from tessera.session import written
from tessera.streaming.incremental import ingest, ingested

# ---------------------------------------------------------------- inputs on the given tables

UNITS = ["mm", "keV", "°C", "G", "%", "MeV", "yr", "furlong"]
UNIT_SQL = "case p_size % 8 " + " ".join(f"when {i} then '{u}'" for i, u in enumerate(UNITS)) + " end"
PARTS = f"""parts as (
 select p_partkey as doc_id, 'name' as key, p_name as value, cast(null as varchar) as unit from part
 union all select p_partkey, 'brand', p_brand, null from part
 union all select p_partkey, 'type', p_type, null from part
 union all select p_partkey, 'size', cast(p_size as varchar), {UNIT_SQL} from part
 union all select p_partkey, 'price', cast(p_retailprice as varchar), null from part)"""
ORDERS = """ords as (
 select o_orderkey as doc_id, 'status' as key, case o_orderstatus when 'O' then 'true' when 'F' then 'off' else o_orderstatus end as value from orders
 union all select o_orderkey, 'priority', o_orderpriority from orders
 union all select o_orderkey, 'date', strftime(o_orderdate, '%Y-%m-%d') from orders
 union all select o_orderkey, 'total', cast(o_totalprice as varchar) from orders)"""
#: SI magnitude and dimension of a number x with a unit u, for the units above.
SI_SQL = """case u when 'mm' then x * 0.001 when 'keV' then x * 1.602176634e-16 when '°C' then x + 273.15 when 'G' then x * 0.0001
 when '%' then x * 0.01 when 'MeV' then x * 1.602176634e-13 when 'yr' then x * 31557600.0 end"""
DIM_SQL = "case u when 'mm' then 'm' when 'keV' then 'J' when '°C' then 'K' when 'G' then 'T' when '%' then '' when 'MeV' then 'J' when 'yr' then 's' end"


def part_attributes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    rows = A.unpivot(p.withColumnsRenamed({"p_name": "name", "p_brand": "brand", "p_type": "type", "p_size": "size", "p_retailprice": "price"}), "p_partkey", ["name", "brand", "type", "size", "price"])
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("value").try_cast("int") % 8 + 1))
    return rows.withColumn("unit", F.when(F.col("key") == "size", unit))


def order_attributes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", "true").when(F.col("o_orderstatus") == "F", "off").otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("total"),
    )
    return A.unpivot(o, "o_orderkey", ["status", "priority", "date", "total"])


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("intention_vector"))


def document_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("doc_id"), F.col("embedding").alias("vector"))


DIST = """dist as (
 select q.vec_id as query_id, e.vec_id as vec_id, e.label as label, q.label as wanted,
  round(1 - list_dot_product(cast(q.embedding as double[]), cast(e.embedding as double[])) / (sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[]))) * sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[])))), 6) + 0.0 as distance
 from embeddings q, embeddings e where q.vec_id % 20 = 0)"""
DOC_RANK = "docrank as (select query_id, vec_id as doc_id, distance, dense_rank() over (partition by query_id order by distance) as rank from dist where distance < 0.5)"
CHUNK_RANK = """chunks as (select query_id, vec_id // 4 as doc_id, min(distance) as distance, count(*) as chunk_count from dist where distance < 0.5 group by all),
 chunkrank as (select *, dense_rank() over (partition by query_id order by distance, chunk_count desc) as rank from chunks)"""


# ---------------------------------------------------------------- scalars


@register("select l_orderkey, l_linenumber, case when l_linenumber = 0 then 0.0 else 1.0 / (l_linenumber + 50) end as by_default, case when l_linenumber - 1 = 0 then 0.0 else 1.0 / (l_linenumber - 1 + cast(l_quantity as bigint)) end as by_k from lineitem")
def rrf_score_table(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.rrf_score(n).alias("by_default"), scalars.rrf_score(n - 1, q).alias("by_k"))


@register(f"""with {ORDERS} select doc_id, key, value,
 case when lower(trim(value)) in ('t','tr','tru','true','y','ye','yes','on') then true when lower(trim(value)) in ('f','fa','fal','fals','false','n','no','of','off') then false end as value_boolean,
 case when regexp_matches(value, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') then cast(value as double) end as value_numeric,
 case when key = 'date' then value end as value_day from ords""")
def typed_casts(spark, d):
    v = F.col("value")
    return order_attributes(spark, d).select("doc_id", "key", "value", scalars.to_bool(v).alias("value_boolean"), scalars.to_double(v).alias("value_numeric"), F.date_format(scalars.to_ts(v), "yyyy-MM-dd").alias("value_day"))


@register(f"with {PARTS}, s as (select doc_id, value, unit, cast(value as double) as x, unit as u from parts where key = 'size') select doc_id, value, unit, printf('%.11e', {SI_SQL}) as magnitude, {DIM_SQL} as dim from s")
def unit_normalise(spark, d):
    rows = part_attributes(spark, d).filter("key = 'size'").withColumn("x", scalars.to_double(F.col("value")))
    return to_si(rows, "x", "unit").select("doc_id", "value", "unit", si_text(F.col("value_si.magnitude")).alias("magnitude"), F.col("value_si.dim").alias("dim"))


@register("select p_partkey, lower(trim(regexp_replace(replace(replace(replace(p_brand || '.' || p_type, '_', ' '), '/', ' '), '.', ' '), '([A-Za-z])#?(\\d)', '\\1 \\2', 'g'))) as key from (select p_partkey, regexp_replace(p_brand, '#', '', 'g') as p_brand, p_type from part)")
def normalise_keys(spark, d):
    key = F.concat_ws(".", F.replace("p_brand", F.lit("#"), F.lit("")), "p_type")
    return table(spark, d, "part").select("p_partkey", scalars.norm_key(key).alias("key"))


@register("""with n as (select p_partkey as id, case p_partkey % 3 when 0 then replace(p_name, ' ', '; ') when 1 then replace(p_name, ' ', ', ') else 'de ' || replace(p_name, ' ', ', de ') end as value from part),
 s as (select id, value, list_filter(list_transform(string_split(value, ';'), lambda p: trim(p)), lambda p: p <> '') as by_semi, list_filter(list_transform(string_split(value, ','), lambda p: trim(p)), lambda p: p <> '') as by_comma from n)
 select id, unnest(case when len(by_semi) > 1 then by_semi when len(by_comma) < 2 or (len(by_comma) = 2 and len(list_filter(by_comma, lambda p: not contains(p, ' '))) > 0) then [trim(value)] else by_comma end) as name from s""")
def split_names(spark, d):
    p = table(spark, d, "part")
    value = F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("; "))).when(F.col("p_partkey") % 3 == 1, F.replace("p_name", F.lit(" "), F.lit(", "))).otherwise(F.concat(F.lit("de "), F.replace("p_name", F.lit(" "), F.lit(", de "))))
    return p.select(F.col("p_partkey").alias("id"), F.explode(scalars.split_names(value)).alias("name"))


@register(f"""with v as (select p_partkey as doc_id, case when p_partkey % 7 = 0 then 'sample_name' else 'energy' end as key, p_size || case p_partkey % 4 when 0 then ' keV' when 1 then 'mm' when 2 then '.5 K' else ' miles' end as value from part)
 select doc_id, regexp_extract(value, '^(-?\\d*\\.{{0,1}}\\d+)\\s?(um|K|mm|m|°C|A|keV|meV|mA|g|k|mg)$', 1) as number, regexp_extract(value, '^(-?\\d*\\.{{0,1}}\\d+)\\s?(um|K|mm|m|°C|A|keV|meV|mA|g|k|mg)$', 2) as unit
 from v where key = 'energy' and regexp_matches(value, '^(-?\\d*\\.{{0,1}}\\d+)\\s?(um|K|mm|m|°C|A|keV|meV|mA|g|k|mg)$')""")
def value_unit_regex(spark, d):
    p = F.col("p_partkey")
    ends = F.when(p % 4 == 0, " keV").when(p % 4 == 1, "mm").when(p % 4 == 2, ".5 K").otherwise(" miles")
    rows = table(spark, d, "part").select(p.alias("doc_id"), F.when(p % 7 == 0, "sample_name").otherwise("energy").alias("key"), F.concat(F.col("p_size").cast("string"), ends).alias("value"))
    return rows.select("doc_id", scalars.value_with_unit(F.col("value"), F.col("key")).alias("v")).filter("v is not null").select("doc_id", F.col("v.value").alias("number"), "v.unit")


@register("""with v as (select p_partkey as doc_id, 'range' as key, p_size || '-' || (p_size + 5) || case p_partkey % 3 when 0 then 'keV' when 1 then 'mm' else '' end as value from part)
 select doc_id, key || unnest(['.min', '.max']) as key, unnest([regexp_extract(value, '^(-?\\d*\\.?\\d+)-', 1), regexp_extract(value, '-(-?\\d*\\.?\\d+)[a-zA-Z]+$', 1)]) as value, regexp_extract(value, '[a-zA-Z]+$') as unit from v where regexp_matches(value, '[a-zA-Z]$')""")
def range_regex(spark, d):
    p = F.col("p_partkey")
    ends = F.when(p % 3 == 0, "keV").when(p % 3 == 1, "mm").otherwise("")
    rows = table(spark, d, "part").select(p.alias("doc_id"), F.lit("range").alias("key"), F.concat_ws("-", F.col("p_size").cast("string"), F.concat((F.col("p_size") + 5).cast("string"), ends)).alias("value"))
    return rows.select("doc_id", "key", F.explode(scalars.value_range(F.col("value"))).alias("r")).select("doc_id", F.concat("key", "r.suffix").alias("key"), "r.value", "r.unit")


# ---------------------------------------------------------------- attributes and tables


@register(f"with {PARTS} select doc_id, key, value, unit from parts")
def unpivot_attributes(spark, d):
    return part_attributes(spark, d)


@register("select event_id, 'k' as key, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null")
def flatten_event_props(spark, d):
    return A.flatten_json(table(spark, d, "events"), "event_id", "props").select("event_id", "key", "value")


@register("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n = 1")
def first_wins_dedupe(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return tables.first_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@register("select d.doc_id, d.source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def anti_join_worklist(spark, d):
    return tables.unprocessed(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"))


@register(f"""with {PARTS}, old as (select * from parts where doc_id % 2 = 0) select p.doc_id, p.key, p.value, p.unit from parts p
 where not exists (select 1 from old o where o.doc_id = p.doc_id and o.key = p.key and o.value = p.value and o.unit is not distinct from p.unit)""")
def null_safe_insert_absent(spark, d):
    rows = part_attributes(spark, d)
    return tables.insert_absent(rows, rows.filter("doc_id % 2 = 0"), ["doc_id", "key", "value", "unit"])


@register("""with k as (select distinct 'catalogue.' || replace(p_brand, '#', '.') as key from part union select distinct p_type from part),
 ds as (select distinct p_type as key, 'a ' || p_type as description from part union select distinct regexp_extract(p_brand, '\\d+$'), 'brand ' || p_brand from part)
 select distinct k.key, ds.description from k join ds on k.key = ds.key or string_split(k.key, '.')[-1] = ds.key""")
def suffix_key_match(spark, d):
    p = table(spark, d, "part")
    keys = p.select(F.concat(F.lit("catalogue."), F.replace("p_brand", F.lit("#"), F.lit("."))).alias("key")).union(p.select("p_type"))
    said = p.select(F.col("p_type").alias("key"), F.concat(F.lit("a "), "p_type").alias("description")).union(p.select(F.regexp_extract("p_brand", r"\d+$", 0), F.concat(F.lit("brand "), "p_brand")))
    return tables.suffix_matches(keys, said)


@register("""with a as (select o_orderkey as doc_id, case o_orderkey % 5 when 0 then 'ESRF' when 1 then 'MAX IV Laboratory, Lund University' when 2 then 'MAXIV' when 3 then 'PSI LMU' else 'elsewhere' end as value from orders),
 m as (select * from (values ('ESRF','European Synchrotron Radiation Facility'), ('MAX IV Laboratory, Lund University','MAX IV'), ('MAX IV Laboratory, Lund University','MAX IV Laboratory'), ('MAXIV','MAX IV Laboratory'), ('PSI LMU','Paul Scherrer Institute')) t(value, derived))
 select a.doc_id, m.derived as value from a join m on a.value = m.value""")
def publisher_harmonise(spark, d):
    k = F.col("o_orderkey") % 5
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("publisher").alias("key"), F.when(k == 0, "ESRF").when(k == 1, "MAX IV Laboratory, Lund University").when(k == 2, "MAXIV").when(k == 3, "PSI LMU").otherwise("elsewhere").alias("value"))
    return A.harmonised_publishers(rows).select("doc_id", "value")


@register("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def feedback_latest_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return tables.latest_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@register("""with k as (select row_number() over (order by source) as id, source as name from (select distinct source from documents where source is not null)) select id, name from k""")
def get_or_create_dimension(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("name"))
    return tables.get_or_create(docs, spark.createDataFrame([], "id long, name string"))


# ---------------------------------------------------------------- conditions


def flags(spark: SparkSession, rows: DataFrame, leaves: dict[str, dict]) -> DataFrame:
    c = conditions.Conditions({"logic": "OR", "conditions": list(leaves.values())})
    found = c.flags(rows)
    return found.select("doc_id", *[F.col(f"has_condition_{i + 1}").alias(n) for i, n in enumerate(leaves)])


def flag_sql(source: str, rows: str, **cases: str) -> str:
    sums = ", ".join(f"max(case when {c} else 0 end) as {n}" for n, c in cases.items())
    return f"with {source}, f as (select doc_id, {sums} from {rows} group by doc_id) select * from f where greatest({', '.join(cases)}, 0) > 0"


@register(flag_sql(PARTS, "parts", starts="key = 'type' and value ilike 'standard%' then 2 when key = 'type' and value ilike '%standard%' then 1", inside="key = 'name' and value ilike 'a%' then 2 when key = 'name' and value ilike '%a%' then 1", wild="key = 'brand' and value ilike 'B%1%' then 2 when key = 'brand' and value ilike '%B%1%' then 1"))
def cond_text_prefix_contains(spark, d):
    leaf = lambda n, o, v: {"name": n, "operator": o, "value": v}
    return flags(spark, part_attributes(spark, d), {"starts": leaf("type", "=", "Standard"), "inside": leaf("name", "LIKE", "A"), "wild": leaf(["brand"], "ILIKE", "B%1")})


@register(flag_sql(PARTS, "parts", differs="key = 'type' and not (value ilike '%STANDARD%') then 1", other="key in ('name', 'brand') and not (value ilike '%brand%') then 1"))
def cond_text_negative(spark, d):
    leaf = lambda n, o, v: {"name": n, "operator": o, "value": v}
    return flags(spark, part_attributes(spark, d), {"differs": leaf("type", "!=", "STANDARD"), "other": leaf(["name", "brand"], "NOT LIKE", "brand")})


@register(flag_sql(PARTS + ", t as (select *, case when regexp_matches(value, '^[0-9.]+$') then cast(value as double) end as x from parts)", "t", of="key = 'brand' and value in ('Brand#11', 'Brand#23', 'Brand#5') then 1", other="key = 'brand' and value not in ('Brand#11', 'Brand#5') then 1", sizes="key = 'size' and x in (1, 7, 49) then 1", rest="key = 'size' and x not in (1, 7) then 1"))
def cond_in_not_in(spark, d):
    leaf = lambda n, o, v: {"name": n, "operator": o, "value": v}
    rows = A.typed(part_attributes(spark, d))
    return flags(spark, rows, {"of": leaf("brand", "IN", ["Brand#11", "Brand#23", "Brand#5"]), "other": leaf("brand", "NOT IN", ["Brand#11", "Brand#5"]), "sizes": leaf("size", "IN", [1, 7, 49]), "rest": leaf("size", "NOT IN", [1, 7])})


@register(flag_sql(PARTS + ", t as (select *, case when regexp_matches(value, '^[0-9.]+$') then cast(value as double) end as x from parts)", "t", above="key = 'size' and x > 40 then 1", equal="key = 'size' and x = 7 then 1", between="key = 'price' and x between 1000 and 1200 then 1", outside="key = 'price' and not (x between 950 and 1800) then 1"))
def cond_numeric(spark, d):
    leaf = lambda n, o, v: {"name": n, "operator": o, "value": v}
    return flags(spark, A.typed(part_attributes(spark, d)), {"above": leaf("size", ">", 40), "equal": leaf("size", "=", 7), "between": leaf("price", "BETWEEN", [1000, 1200]), "outside": leaf("price", "NOT BETWEEN", [950, 1800])})


@register(flag_sql(PARTS + f", s as (select *, cast(value as double) as x, unit as u from parts where key = 'size'), t as (select *, {SI_SQL} as si, {DIM_SQL} as dim from s)", "t", longer="si is not null and dim = 'm' and si > 0.02 or si is null and x > 2 then 1", hot="si is not null and dim = 'K' and si between 283.15 and 303.15 or si is null and x between 10 and 30 then 1", same="si is not null and dim = 'J' and abs(si - 9 * 1.602176634e-16) < 1e-24 or si is null and x = 9 then 1"))
def cond_unit(spark, d):
    leaf = lambda o, v, u: {"name": "size", "operator": o, "value": v, "unit": u}
    return flags(spark, A.typed(part_attributes(spark, d)), {"longer": leaf(">", 2, "cm"), "hot": leaf("BETWEEN", [10, 30], "°C"), "same": leaf("=", 9, "keV")})


@register(flag_sql(ORDERS + ", t as (select *, case when key = 'date' then cast(value as date) end as day from ords)", "t", upto="key = 'date' and day <= date '1995-06-17' then 1", on_day="key = 'date' and day = date '1996-01-02' then 1", within="key = 'date' and day between date '1994-01-01' and date '1994-12-31' then 1"))
def cond_timestamp_day(spark, d):
    leaf = lambda o, v: {"name": "date", "operator": o, "value": v}
    return flags(spark, A.typed(order_attributes(spark, d).withColumn("unit", F.lit(None).cast("string"))), {"upto": leaf("<=", "1995/06/17"), "on_day": leaf("=", "1996-01-02"), "within": leaf("BETWEEN", ["1994.01.01", "1994-12-31 12:00:00"])})


@register(flag_sql(ORDERS, "ords", open="key = 'status' and value = 'true' then 1", closed="key = 'status' and value = 'off' then 1"))
def cond_boolean(spark, d):
    leaf = lambda o, v: {"name": "status", "operator": o, "value": v}
    return flags(spark, A.typed(order_attributes(spark, d)), {"open": leaf("=", True), "closed": leaf("!=", True)})


@register(flag_sql(ORDERS + ", t as (select doc_id, key, case when value = 'P' or value like '1-%' then null else value end as value from ords)", "t", missing="key in ('status', 'priority') and value is null then 1", there="key = 'priority' and value is not null then 1"))
def cond_null(spark, d):
    rows = order_attributes(spark, d).withColumn("value", F.when((F.col("value") == "P") | F.col("value").startswith("1-"), None).otherwise(F.col("value")))
    leaf = lambda n, o: {"name": n, "operator": o, "value": None}
    return flags(spark, rows, {"missing": leaf(["status", "priority"], "IS NULL"), "there": leaf("priority", "IS NOT NULL")})


TREE = {
    "logic": "AND",
    "conditions": [
        {"name": "type", "operator": "=", "value": "Standard"},
        {"logic": "OR", "conditions": [{"name": "size", "operator": ">", "value": 30}, {"name": "brand", "operator": "IN", "value": ["Brand#11", "Brand#23"]}]},
        {"name": "type", "operator": ">", "value": "not a date"},
    ],
}
TREE_SQL = f"""{PARTS}, f as (select doc_id, max(case when key = 'type' and value ilike 'Standard%' then 2 when key = 'type' and value ilike '%Standard%' then 1 else 0 end) as a,
 max(case when key = 'size' and try_cast(value as double) > 30 then 1 else 0 end) as b, max(case when key = 'brand' and value in ('Brand#11', 'Brand#23') then 1 else 0 end) as c from parts group by doc_id),
 tree as (select doc_id, case when a > 0 and (b > 0 or c > 0) then 1 else 0 end as full_match, a + b + c as partial_match_count, dense_rank() over (order by a + b + c desc) as partial_rank from f where a + b + c > 0)"""


@register(f"with {TREE_SQL} select * from tree")
def cond_tree_partial_rank(spark, d):
    return conditions.rank_conditions(A.typed(part_attributes(spark, d)), TREE)


# ---------------------------------------------------------------- vectors


@register(f"with {DIST}, {DOC_RANK} select query_id, doc_id, distance, rank from docrank")
def doc_vector_rank(spark, d):
    return vectors.rank_documents(vector_queries(spark, d), document_vectors(spark, d)).select("query_id", "doc_id", "distance", "rank")


@register(f"with {DIST}, {CHUNK_RANK} select query_id, doc_id, distance, chunk_count, rank from chunkrank")
def chunk_vector_rank(spark, d):
    return vectors.rank_chunks(vector_queries(spark, d), chunk_vectors(spark, d)).select("query_id", "doc_id", "distance", "chunk_count", "rank")


@register("""with m as (select label, i, avg(x) as x from (select label, unnest(cast(embedding as double[])) as x, unnest(range(len(embedding))) as i from embeddings) group by all)
 select label, i as at, round(x, 6) + 0.0 as x from m""")
def mean_condition_vector(spark, d):
    means = conditions.condition_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("vector").alias("at", "x")).select("label", F.col("at").cast("long").alias("at"), (F.round("x", 6) + 0.0).alias("x"))


@register("""with m as (select label, i, avg(x) as x from (select label, unnest(cast(embedding as double[])) as x, unnest(range(len(embedding))) as i from embeddings) group by all),
 c as (select list(x order by i) as v from m where label = (select min(label) from embeddings)),
 e as (select vec_id, round(1 - list_dot_product(cast(embedding as double[]), v) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product(v, v))), 6) as d from embeddings, c)
 select vec_id as doc_id, case when d < 0.3 then 1 else 0 end as near, case when d > 0.3 then 1 else 0 end as far from e where d <> 0.3""")
def value_vector_condition(spark, d):
    e = table(spark, d, "embeddings")
    own = e.filter(F.col("label") == e.agg(F.min("label")).first()[0])
    vector = conditions.condition_vectors(own, "label", "embedding").first()["vector"]
    rows = e.select(F.col("vec_id").alias("doc_id"), F.lit("creator").alias("key"), F.lit("someone").alias("value"), F.col("embedding").alias("value_vector"))
    near, far = {"name": "creator", "operator": "=", "value": "nobody of this name"}, {"name": "creator", "operator": "NOT IN", "value": ["someone"]}
    found = conditions.Conditions({"logic": "OR", "conditions": [near, far]}, {id(near): vector, id(far): vector}).flags(rows)
    return found.select("doc_id", F.col("has_condition_1").alias("near"), F.col("has_condition_2").alias("far"))


@register(f"""with {DIST}, near as (select query_id, 'v' || vec_id as key, distance from dist), hits as (select * from near where distance < 0.35), n as (select query_id, count(*) as n from hits group by all),
 rest as (select r.query_id, r.key, row_number() over (partition by r.query_id order by distance, r.key) as place, coalesce(n, 0) as n from near r left join n using (query_id) where distance >= 0.35)
 select 'q' || query_id as name, key from hits union all select 'q' || query_id, key from rest where place <= greatest(0, 4 - n)""")
def name_resolution_padded(spark, d):
    names = vector_queries(spark, d).select(F.concat(F.lit("q"), "query_id").alias("name"), F.col("intention_vector").alias("vector"))
    keys = document_vectors(spark, d).select(F.concat(F.lit("v"), "doc_id").alias("key"), "vector")
    return vectors.resolve_names(names, keys, threshold=0.35)


@register(f"""with {DIST}, near as (select query_id, 'v' || vec_id as key, distance from dist where query_id <> vec_id), r as (select *, row_number() over (partition by query_id order by distance, key) as n from near),
 two as (select query_id, max(case when n = 1 then key end) as key, max(case when n = 1 then distance end) as a, max(case when n = 2 then distance end) as b from r where n <= 2 group by all)
 select 'q' || query_id as name, case when a <= 0.35 and (b is null or round(b - a, 9) >= 0.01) then key else 'q ' || query_id end as key, not (a <= 0.35 and (b is null or round(b - a, 9) >= 0.01)) as is_new from two""")
def key_resolution_gap(spark, d):
    # a query's own vector is no key of its own
    names = vector_queries(spark, d).select(F.concat(F.lit("q"), "query_id").alias("name"), F.col("intention_vector").alias("vector"))
    keys = document_vectors(spark, d).select(F.concat(F.lit("v"), "doc_id").alias("key"), "vector")
    return resolved_without_self(names, keys)


def resolved_without_self(names: DataFrame, keys: DataFrame) -> DataFrame:
    own = F.concat(F.lit("v"), F.substring("name", 2, 20))
    # three nearest of each block, as a name's own key is none
    near = vectors.similar(names, keys, -1.0, "name", "vector", "vector", nearest=3).filter(F.col("key") != own)
    return inferred.nearest_or_new(names.select("name"), near, 0.35, 0.01)


# ---------------------------------------------------------------- full text

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
POSTINGS = f"""w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) as term, generate_subscripts(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), 1) as place from documents),
 post as (select doc_id, term, count(*) as tf, min(place) as first_at, max(place) as last_at from w where term not in ({_STOP}) group by all)"""
TERMS = f"""terms as (select distinct item_id as query_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[\\s|]+'), lambda x: lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g'))), lambda x: x <> '')) as term from benchmark)"""
KEYWORD_RANK = f"keyrank as (select query_id, doc_id, sum(tf) as places, dense_rank() over (partition by query_id order by sum(tf) desc) as rank from terms join post using (term) where term not in ({_STOP}) group by query_id, doc_id)"


@register(f"with {POSTINGS} select doc_id, term, tf, first_at, last_at from post")
def postings(spark, d):
    p = text.postings(table(spark, d, "documents"), stem=False)
    return p.select("doc_id", "term", "tf", F.element_at("positions", 1).cast("long").alias("first_at"), F.element_at("positions", -1).cast("long").alias("last_at"))


def keyword_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), scalars.keyword_terms(F.array("text")).alias("terms"))


@register(f"with {POSTINGS}, {TERMS}, {KEYWORD_RANK} select query_id, doc_id, round(places * 0.1, 6) as score, rank from keyrank")
def keyword_rank(spark, d):
    asked = keyword_queries(spark, d)
    counts = text.term_counts(table(spark, d, "documents"), text.asked_terms(asked, stem=False), stem=False)
    return text.rank_keywords(asked, counts, stem=False).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# ---------------------------------------------------------------- hybrid search

BRANCHES = f"""{DIST}, {DOC_RANK}, {CHUNK_RANK}, {TREE_SQL}, qs as (select distinct query_id from dist),
 allranks as (select query_id, doc_id, rank as r1, null as r2, null as r3, null as r4 from docrank union all select query_id, doc_id, null, rank, null, null from chunkrank
  union all select query_id, doc_id, null, null, full_match, partial_rank from tree, qs)"""
FUSED = f"""{BRANCHES}, sums as (select query_id, doc_id, sum(coalesce(1.0 / (r1 + 6), 0)) as document_score, sum(coalesce(1.0 / (r2 + 6), 0)) as chunk_score,
  sum(coalesce(case when r3 = 0 then 0.0 else 1.0 / (r3 + 6) end, 0)) as conditions_full_score, sum(coalesce(1.0 / (r4 + 6), 0)) as conditions_partial_score from allranks group by all),
 fused as (select *, document_score + chunk_score + conditions_full_score + conditions_partial_score as overall_score from sums),
 top as (select *, row_number() over (partition by query_id order by round(overall_score, 9) desc, round(document_score, 9) desc, round(chunk_score, 9) desc, round(conditions_full_score, 9) desc, round(conditions_partial_score, 9) desc, doc_id) as position from fused qualify position <= 20)"""
#: With intention and conditions, without keywords.
NORMAL = f"""{FUSED}, norm as (select query_id, doc_id, overall_score / (4.0 / 7) as overall_score, document_score * 7 as document_score, chunk_score * 7 as chunk_score, conditions_full_score * 7 as conditions_full_score, conditions_partial_score * 7 as conditions_partial_score from top)"""
KNEE = f"""{NORMAL}, k0 as (select query_id, doc_id, overall_score as s, row_number() over w - 1 as i, count(*) over (partition by query_id) as n, first_value(overall_score) over (partition by query_id order by overall_score desc, doc_id rows between unbounded preceding and unbounded following) as s0, last_value(overall_score) over (partition by query_id order by overall_score desc, doc_id rows between unbounded preceding and unbounded following) as s1 from norm window w as (partition by query_id order by overall_score desc, doc_id)),
 k1 as (select *, abs((s1 - s0) * i - (n - 1) * s + (n - 1) * s0) / case when sqrt((n - 1) * (n - 1) + (s1 - s0) * (s1 - s0)) = 0 then 1 else sqrt((n - 1) * (n - 1) + (s1 - s0) * (s1 - s0)) end as off from k0),
 k2 as (select *, max(off) over (partition by query_id) as max_distance from k1), k3 as (select *, min(case when off = max_distance then i end) over (partition by query_id) as knee_index from k2),
 k4 as (select *, max(case when i = knee_index then s end) over (partition by query_id) as knee_score from k3), k5 as (select *, abs(s - knee_score) <= greatest(1e-9 * greatest(abs(s), abs(knee_score)), 1e-12) as flat from k4),
 k6 as (select *, sum(case when flat then 1 else 0 end) over (partition by query_id) as nf, max(case when flat then i end) over (partition by query_id) as e from k5),
 knee as (select *, case when s0 < 0.25 then 0 when n < 3 or max_distance < 0.02 then n when nf > 1 then e + 1 else knee_index end as keep_count from k6)"""


def ranks(spark: SparkSession, d: str) -> DataFrame:
    q = vector_queries(spark, d)
    near = written(hybrid.branches(vectors.rank_documents(q, document_vectors(spark, d)), vectors.rank_chunks(q, chunk_vectors(spark, d))), "near")
    trees = written(conditions.rank_condition_trees(A.typed(part_attributes(spark, d)), {"standard": TREE}), "trees")
    met = hybrid.condition_branch(trees, q.select("query_id", F.lit("standard").alias("tree_id")), near)
    return near.unionByName(hybrid.branches(conditions=met))


def active(spark: SparkSession, d: str) -> DataFrame:
    return vector_queries(spark, d).select("query_id", F.lit(True).alias("has_intention"), F.lit(True).alias("has_conditions"), F.lit(False).alias("has_keywords"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


PARTS_OF_SCORE = ("overall_score", "document_score", "chunk_score", "conditions_full_score", "conditions_partial_score")
ROUNDED = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in PARTS_OF_SCORE)


@register(f"with {FUSED} select query_id, doc_id, position, {ROUNDED} from top")
def hybrid_search_topk(spark, d):
    top = hybrid.top_results(hybrid.fuse(ranks(spark, d)))
    return rounded(top.select("query_id", "doc_id", "position", *PARTS_OF_SCORE), *PARTS_OF_SCORE)


@register(f"with {NORMAL} select query_id, doc_id, {ROUNDED} from norm")
def hybrid_search_normalised(spark, d):
    top = hybrid.top_results(hybrid.fuse(ranks(spark, d)))
    scored = postrank.normalise_scores(top.join(F.broadcast(active(spark, d)), "query_id"))
    return rounded(scored.select("query_id", "doc_id", *PARTS_OF_SCORE), *PARTS_OF_SCORE)


@register(f"with {KNEE} select query_id, doc_id, i as position, i < keep_count as kept, keep_count, knee_index, round(max_distance, 6) + 0.0 as max_distance from knee")
def knee_cut(spark, d):
    found = hybrid.search(ranks(spark, d), active(spark, d))
    return found.select("query_id", "doc_id", "position", "kept", "keep_count", "knee_index", (F.round("max_distance", 6) + 0.0).alias("max_distance"))


@register(f"with {KNEE} select query_id, bucket, count(*) as n from (select query_id, case when i < keep_count and s >= 0.95 then 'matched' when i < keep_count then 'relevant' else 'suggested' end as bucket from knee) group by all")
def relevance_buckets(spark, d):
    return hybrid.search(ranks(spark, d), active(spark, d)).groupBy("query_id", "bucket").agg(F.count("*").alias("n"))


@register("""with v as (select p_partkey as doc_id, p_brand as facility, p_name as name, p_type as type from part),
 parts as (select doc_id, facility, 0 as pr, unnest(list_filter(list_transform(string_split(name, ' '), lambda p: trim(p)), lambda p: p <> '')) as part, generate_subscripts(string_split(name, ' '), 1) as place from v union all select doc_id, facility, 1, type, 1 from v),
 f as (select doc_id, facility, lower(part) as low, min(struct_pack(a := pr, b := place, c := part)) as p from parts where facility <> 'Brand#11' group by all)
 select v.doc_id, v.facility, x.text as words from v left join (select doc_id, string_agg(p.c, ' - ' order by p) as text from f group by doc_id) x using (doc_id)""")
def document_details(spark, d):
    p = table(spark, d, "part")
    docs = p.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("facility"))
    rows = A.unpivot(p.withColumn("name", F.replace("p_name", F.lit(" "), F.lit(","))).withColumnRenamed("p_type", "type"), "p_partkey", ["name", "type"]).withColumn("attr_id", F.when(F.col("key") == "name", 0).otherwise(1))
    names = [r[0] for r in p.select("p_brand").distinct().filter("p_brand <> 'Brand#11'").collect()]
    return postrank.document_details(docs, rows, {"words": {n: ["name", "type"] for n in names}})


# ---------------------------------------------------------------- inference


@register("""with c as (select p.p_partkey % 97 as doc_id, p.p_brand as key, p.p_type as value, cast(p.p_size % 3 as varchar) as ekey, cast(p.p_size % 7 as varchar) as evalue, p.p_size % 5 as cluster from part p),
 s as (select doc_id, key, value, count(distinct ekey || '|' || evalue) as evidence, count(distinct cluster) as clusters from c group by all),
 r as (select *, rank() over (partition by doc_id, key order by evidence desc, clusters desc) as r from s)
 select doc_id, key, min(value) as value, min(evidence) as evidence, min(clusters) as clusters from r where r = 1 group by doc_id, key having count(*) = 1""")
def candidate_voting(spark, d):
    p = table(spark, d, "part")
    rows = p.select((F.col("p_partkey") % 97).alias("doc_id"), F.col("p_brand").alias("key"), F.col("p_type").alias("value"), F.lit(None).cast("string").alias("unit"), (F.col("p_size") % 3).cast("string").alias("ekey"), (F.col("p_size") % 7).cast("string").alias("evalue"), (F.col("p_size") % 5).alias("cluster"))
    return inferred.vote(rows).drop("unit")


# ---------------------------------------------------------------- metrics and evaluation

METRIC_SQL = {
    "CP": "1.0 / r", "RR": "1.0 / r", "Ps": "1.0", "lzp": "1.0 - (r - 1.0) / k", "ezp": "(exp((k - r + 1) / 3.0) - 1) / (exp(k / 3.0) - 1)", "lep": "1.0 - abs(e - r) * 1.0 / k",
    "eep": "(exp((k - abs(e - r)) / 3.0) - 1) / (exp(k / 3.0) - 1)", "znDCG": "1.0 / log2(r + 1)", "enDCG": "log2(e + 1) / log2(r + 1)",
}
TESTS = "t as (select l_orderkey, l_linenumber, cast(l_quantity as int) % 26 as r, 20 as k, case when l_linenumber - 2 <= 0 then 1 else l_linenumber - 2 end as e, l_returnflag as source from lineitem)"
_METRICS = ", ".join(f"round(case when r > 0 and r <= k then {v} else 0.0 end, 6) + 0.0 as {n}" for n, v in METRIC_SQL.items())


@register(f"with {TESTS} select l_orderkey, l_linenumber, {_METRICS}, case when r > 0 and r <= k then 0.0 else 1.0 end as NP, greatest(0.0, case when r > 0 then 1.0 - greatest(0, r - 1 - 3) / 20.0 else 0.0 end) as min_position from t")
def rank_metrics_single(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 26).alias("r"), F.lit(20).alias("k"), (F.col("l_linenumber") - 2).alias("e"))
    found = {n: (F.round(v, 6) + 0.0) for n, v in metrics.pointwise(F.col("r"), F.col("k"), F.col("e")).items()}
    return rows.select("l_orderkey", "l_linenumber", *[v.alias(n) for n, v in found.items()], metrics.min_position(F.col("r"), F.lit(3)).alias("min_position"))


@register("""with p as (select l_orderkey, l_linenumber, cast(l_quantity as int) % 23 as a, lead(cast(l_quantity as int) % 23) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as b from lineitem),
 g as (select l_orderkey, case when a between 1 and 20 and b between 1 and 20 and a < b then 1 else 0 end as good from p where b is not null)
 select l_orderkey, round(avg(good), 6) as CRP, case when min(good) = 1 then 1.0 else 0.0 end as CAP from g group by all""")
def rank_metrics_pairs(spark, d):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity").cast("int") % 23).alias("r"))
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["r"]).alias("ranks"))
    found = lists.select("l_orderkey", F.round(metrics.crp(F.col("ranks"), F.lit(20)), 6).alias("CRP"), metrics.cap(F.col("ranks"), F.lit(20)).alias("CAP"))
    return found.filter("CRP is not null")


@register("""with t as (select l_orderkey, l_linenumber, case l_returnflag when 'A' then 'HR' when 'N' then 'LR' else 'NP' end as a, case l_linenumber % 3 when 0 then 'HR' when 1 then 'LR' else 'NP' end as e from lineitem)
 select l_orderkey, l_linenumber, case when a = e then 1.0 when a <> 'NP' and e <> 'NP' then 0.6 else 0.0 end as EP from t""")
def extended_presence(spark, d):
    f, n = F.col("l_returnflag"), F.col("l_linenumber") % 3
    actual = F.when(f == "A", "HR").when(f == "N", "LR").otherwise("NP")
    wanted = F.when(n == 0, "HR").when(n == 1, "LR").otherwise("NP")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", metrics.extended_presence(actual, wanted).alias("EP"))


@register("""with v as (select o_orderkey % 7 as run_id, o_orderkey as tpid, cast(floor(o_totalprice) as bigint) % 30 as r, case o_orderstatus when 'O' then 'synthetic' else 'expert' end as source, case when o_orderpriority like '5%' then 'negative' else 'positive' end as type from orders),
 m as (select *, case when type = 'positive' then 'RR' else 'NP' end as metric, case when type = 'positive' then case when r between 1 and 20 then 1.0 / r else 0.0 end else case when r between 1 and 20 then 0.0 else 1.0 end end as value from v)
 select run_id, 'c' || metric as metric, round(avg(value), 6) as value from m group by all union all select run_id, left(source, 1) || metric, round(avg(value), 6) from m where type = 'positive' group by all""")
def run_metrics_by_set(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 7).alias("run_id"), F.col("o_orderkey").alias("tpid"), F.col("o_orderkey").alias("test_id"), (F.floor("o_totalprice") % 30).cast("int").alias("rank"), F.when(F.col("o_orderstatus") == "O", "synthetic").otherwise("expert").alias("source"), F.when(F.col("o_orderpriority").startswith("5"), "negative").otherwise("positive").alias("type"))
    tests = o.select("*", F.array().cast("array<int>").alias("ranks"), F.lit(20).alias("k"), F.lit(1).alias("expected_rank"), F.lit(None).cast("string").alias("actual_group"), F.lit(None).cast("string").alias("expected_group"))
    values = evaluate.test_metrics(tests).filter("metric = 'RR' or metric = 'NP' and right(metric, 2) = 'NP'")
    values = values.join(o.select("test_id", "type"), "test_id").filter("metric = 'RR' or type = 'negative'").drop("type")
    return evaluate.run_metrics(values, o, o).select("run_id", "metric", F.round("value", 6).alias("value"))


CONFIGS = [("MatchFocus", True, 8, 8, 1, 1, 10), ("SimilarityFocus", True, 1, 1, 6, 6, 10), ("6_6_3_3_10", False, 6, 6, 3, 3, 10), ("LessKeyword", False, 6, 6, 6, 6, 10)]
CONFIG_SCHEMA = "test_name string, disabled boolean, rrf_k_document int, rrf_k_chunk int, rrf_k_conditions_full int, rrf_k_conditions_partial int, rrf_k_keywords int"
SWEEP = f"""{BRANCHES}, cfg as (select * from (values ('6_6_3_3_10', 6, 6, 3, 3), ('LessKeyword', 6, 6, 6, 6)) t(test_name, k1, k2, k3, k4)),
 csum as (select test_name, query_id, doc_id, sum(coalesce(1.0 / (r1 + k1), 0)) as s1, sum(coalesce(1.0 / (r2 + k2), 0)) as s2, sum(coalesce(case when r3 = 0 then 0.0 else 1.0 / (r3 + k3) end, 0)) as s3, sum(coalesce(1.0 / (r4 + k4), 0)) as s4 from allranks, cfg group by all),
 ctop as (select *, row_number() over (partition by test_name, query_id order by round(s1 + s2 + s3 + s4, 9) desc, round(s1, 9) desc, round(s2, 9) desc, round(s3, 9) desc, round(s4, 9) desc, doc_id) as position from csum qualify position <= 20),
 tg as (select query_id, query_id + 1 as target_id from qs), sw as (select test_name, query_id, target_id, coalesce(position, 0) as rank from (select * from tg, (select test_name from cfg) c) x left join ctop t on t.test_name = x.test_name and t.query_id = x.query_id and t.doc_id = x.target_id),
 sweep as (select test_name, query_id, rank, case when rank > 0 then greatest(0.0, 1.0 - greatest(0, rank - 1 - 2) / 20.0) else 0.0 end as score from sw)"""
SWEEP = SWEEP.replace("select test_name, query_id, target_id, coalesce(position, 0)", "select x.test_name, x.query_id, x.target_id, coalesce(position, 0)")


def sweep(spark: SparkSession, d: str) -> DataFrame:
    configs = spark.createDataFrame(CONFIGS, CONFIG_SCHEMA)
    targets = vector_queries(spark, d).select("query_id", (F.col("query_id") + 1).alias("target_id"), F.lit(2).alias("min_position"))
    return evaluate.config_sweep(ranks(spark, d), configs, targets)


@register(f"with {SWEEP} select test_name, query_id, rank, score from sweep")
def config_sweep(spark, d):
    return sweep(spark, d).select("test_name", "query_id", "rank", "score")


@register(f"""with {SWEEP}, named as (select *, 'set' || query_id % 3 as dataset_name from sweep)
 select test_name, dataset_name, round(avg(score), 4) as avg_score, round(avg(score) * 100, 2) as avg_score_percent, count(*) as queries from named group by grouping sets ((test_name, dataset_name), (test_name))""")
def sweep_averages(spark, d):
    named = sweep(spark, d).withColumn("dataset_name", F.concat(F.lit("set"), (F.col("query_id") % 3).cast("string")))
    return evaluate.sweep_summary(named)


@register("""with s as (select l_returnflag as dataset_name, l_linestatus as test_name, round(avg(l_discount), 6) as avg_score from lineitem group by all)
 select dataset_name, max(case when test_name = 'F' then avg_score end) as "F", max(case when test_name = 'O' then avg_score end) as "O" from s group by dataset_name""")
def score_pivot(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("dataset_name"), F.col("l_linestatus").alias("test_name")).agg(F.round(F.avg("l_discount"), 6).alias("avg_score"))
    return evaluate.score_pivot(s, names=["F", "O"])


@register("""with b as (select l_orderkey % 2 as config, l_orderkey // 2 as query_index, max(l_discount) as o, max(l_tax) as n, min(l_shipdate) as x from lineitem group by all),
 e as (select query_index, case when abs(n - o) < 1e-12 then 0.0 else n - o end as delta from b),
 s as (select query_index, round(avg(delta), 6) + 0.0 as average_delta, round(min(delta), 6) + 0.0 as worst_delta, round(max(delta), 6) + 0.0 as best_delta, max(delta) > 0 as up, min(delta) < 0 as down from e group by all)
 select query_index, average_delta, worst_delta, best_delta, case when up and down then 'mixed' when up then 'better' when down then 'worse' else 'unchanged' end as direction, false as changed from s""")
def run_compare(spark, d):
    runs = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 2).alias("config"), F.floor(F.col("l_orderkey") / 2).cast("long").alias("query_index")).agg(F.max("l_discount").alias("o"), F.max("l_tax").alias("n"))
    old, new = (runs.select("config", "query_index", F.col(c).alias("score"), F.lit('{"a": 1}').alias("query")) for c in "on")
    return rounded(evaluate.compare_runs(old, new), "average_delta", "worst_delta", "best_delta")


@register("""with q as (select l_returnflag as test_name, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as median, quantile_cont(l_extendedprice, 0.75) as q3, count(*) as n from lineitem group by all)
 select test_name, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3, min(l_extendedprice) as low, max(l_extendedprice) as high, n from q join lineitem on l_returnflag = test_name where l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by all""")
def score_distribution(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("test_name"), F.col("l_extendedprice").alias("score"))
    return evaluate.score_distribution(s).withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@register(f"""with {NORMAL}, tg as (select query_id, query_id + 1 as target_id from qs) select tg.query_id, target_id, {", ".join(f"round(coalesce({c}, 0), 6) + 0.0 as {c}" for c in PARTS_OF_SCORE)} from tg left join norm on norm.query_id = tg.query_id and doc_id = target_id""")
def component_breakdown(spark, d):
    top = hybrid.top_results(hybrid.fuse(ranks(spark, d)))
    scored = postrank.normalise_scores(top.join(F.broadcast(active(spark, d)), "query_id"))
    targets = vector_queries(spark, d).select("query_id", (F.col("query_id") + 1).alias("target_id"))
    found = evaluate.component_breakdown(scored, targets)
    return rounded(found.select("query_id", "target_id", *PARTS_OF_SCORE), *PARTS_OF_SCORE)


# ---------------------------------------------------------------- streams


@register("select source, doc_id, lang from (select *, row_number() over (partition by source order by doc_id) as n from documents) where n = 1")
def incremental_ingest(spark, d):
    path = new_folder(spark, "ingest")
    rows = table(spark, d, "documents").select("source", "doc_id", "lang")
    rows.write.parquet(f"{path}/drop")
    schema = rows.schema
    ingest(spark, f"{path}/drop", schema, f"{path}/table", f"{path}/offsets", "source", ["doc_id"]).awaitTermination()
    return ingested(spark, f"{path}/table", schema, "source")


# ---------------------------------------------------------------- rows only


@register()
def semantic_chunks(spark, d):
    return chunks.semantic_chunks(table(spark, d, "documents"))


@register()
def document_summaries(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text")
    return chunks.summaries(docs)


def queries() -> dict[str, Query]:
    from tessera import queries_evaluation, queries_records, queries_search, queries_trees  # noqa: F401  (they register themselves)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
