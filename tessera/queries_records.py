"""Queries over records: files in and out, and the extraction of attribute rows.

The records are nested JSON that Spark builds from the given tables and writes
as files of a few hundred records each; the SQL beside each query says from the
tables alone what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.functions.embed import embed_distinct
from tessera.operators import attributes as A
from tessera.operators import inferred, tables
from tessera.registry import new_folder, register, table
from tessera.session import written
from tessera.sources import readers, writers
from tessera.streaming import incremental

#: Records that one file holds.
PER_FILE = 500


def json_files(rows: DataFrame, number: str, value: str, name: str) -> str:
    """Writes JSON arrays of `PER_FILE` of the rows' texts, a file each; gives their pattern."""
    path = new_folder(rows.sparkSession, name)
    batch = F.floor(F.col(number) / PER_FILE).alias("batch")
    one = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(number, value))), lambda x: x[value]), ","), F.lit("]"))
    rows.groupBy(batch).agg(one.alias("value")).write.partitionBy("batch").text(path)
    return f"{path}/*/*.txt"


def standard_json(spark: SparkSession, d: str) -> DataFrame:
    """`n, json`: a standard record for each part; every tenth is a publication, every seventeenth has no doi."""
    n, size = F.col("p_partkey"), F.col("p_size")
    document = F.struct(
        F.when(n % 17 != 0, F.concat(F.lit(" 10.1/"), n, F.lit(" "))).otherwise("").alias("doi"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.col("p_brand").alias("brand"),
        F.struct(size.alias("value"), F.lit("mm").alias("unit")).alias("gap"), F.struct(F.col("p_retailprice").alias("v"), F.lit("keV").alias("u"), F.lit("x").alias("note")).alias("energy"),
        F.struct(F.struct(F.col("p_type").alias("beamline")).alias("measurement")).alias("scientificMetadata"), F.array("p_brand", "p_name").alias("tags"),
        F.struct(F.concat(F.lit("m"), size % 3).alias("name"), size.alias("value"), F.lit("um").alias("units")).alias("motor"), (size % 2 == 0).alias("odd"), F.concat(size, F.lit("-"), size + 5, F.lit("mm")).alias("span"), F.concat(size, F.lit(" keV")).alias("range"),
    )
    sets = F.array(F.struct(F.concat(F.lit("set "), n % 7).alias("name"), F.struct((n % 5).alias("cells")).alias("metadata")))
    record = F.struct(n.alias("id"), document.alias("document"), sets.alias("datasets"), F.struct(F.col("p_name").alias("hidden")).alias("other"), F.when(n % 10 == 0, F.struct(n.alias("id"))).alias("collection"))
    return table(spark, d, "part").select(n.alias("n"), F.to_json(record).alias("json"))


def standard_records(spark: SparkSession, d: str) -> DataFrame:
    return readers.records(spark, json_files(standard_json(spark, d), "n", "json", "standard"), "ESRF")


def publication_json(spark: SparkSession, d: str) -> DataFrame:
    """`n, json`: publications of customers; the first datacite entry is nested, flat, or not there."""
    n = F.col("c_custkey")
    doi, titles = F.concat(F.lit(" 10.2/ab"), n), F.array(F.struct(F.col("c_name").alias("title")))
    texts = F.array(F.struct(F.lit("no").alias("description"), F.lit("Other").alias("descriptionType")), F.struct(F.col("c_mktsegment").alias("description"), F.when(n % 4 == 0, "Methods").otherwise("Abstract").alias("descriptionType")))
    own = [doi.alias("doi"), titles.alias("titles"), texts.alias("descriptions")]
    parameters = F.array(F.struct(F.lit("__hidden").alias("name"), n.alias("value"), F.lit("m").alias("units")), F.struct(F.lit("temp").alias("name"), (n % 300).alias("value"), F.lit("K").alias("units")))
    samples = F.array(F.struct(F.lit("f").alias("datafiles"), parameters.alias("parameters"), (n % 11).alias("id")))
    rest = [F.struct(n.alias("id")).alias("collection"), F.array(F.struct(F.concat(F.lit("user "), n % 50).alias("name"))).alias("users"), samples.alias("samples"), F.struct(F.lit(1).alias("y")).alias("elsewhere")]
    nested, flat = F.to_json(F.struct(F.array(F.struct(F.struct(*own, F.lit("<x/>").alias("xml")).alias("attributes"))).alias("datacite"), *rest)), F.to_json(F.struct(F.array(F.struct(*own)).alias("datacite"), *rest))
    return table(spark, d, "customer").select(n.alias("n"), F.when(n % 3 == 0, nested).when(n % 3 == 1, flat).otherwise(F.to_json(F.struct(*rest))).alias("json"))


def publication_records(spark: SparkSession, d: str) -> DataFrame:
    return readers.records(spark, json_files(publication_json(spark, d), "n", "json", "publications"), "ILL")


def standard_documents(spark: SparkSession, d: str) -> DataFrame:
    """The standard documents, numbered by their doi."""
    docs = readers.standard_documents(standard_records(spark, d))
    return docs.select(F.substring_index("doi", "/", -1).cast("long").alias("doc_id"), *docs.columns)


# ---------------------------------------------------------------- records in


@register("select p_partkey as n, p_name as title, 'ESRF' as facility from part")
def record_scan(spark, d):
    return standard_records(spark, d).select(F.get_json_object("raw", "$.id").cast("long").alias("n"), F.get_json_object("raw", "$.document.title").alias("title"), "facility")


@register("select '10.1/' || p_partkey as doi, p_name as title, p_type as text, 'ESRF' as facility from part where p_partkey % 17 <> 0")
def standard_extract(spark, d):
    return readers.standard_documents(standard_records(spark, d)).drop("raw")


@register("select '10.2/AB' || c_custkey as doi, c_name as title, case when c_custkey % 4 = 0 then '' else c_mktsegment end as text, 'ILL' as facility from customer where c_custkey % 3 < 2")
def publication_extract(spark, d):
    return readers.publication_documents(publication_records(spark, d)).drop("raw")


@register("select '10.1/1' as doi, p_name as title, 1 as id from part where p_partkey = 1")
def raw_record_of_doi(spark, d):
    found = readers.raw_record(readers.standard_documents(standard_records(spark, d)), "10.1/1")
    return found.select("doi", F.get_json_object("raw", "$.document.title").alias("title"), F.get_json_object("raw", "$.id").cast("int").alias("id"))


STANDARD = """s as (select * from part where p_partkey % 10 <> 0 and p_partkey % 17 <> 0),
 attrs as (select p_partkey as doc_id, unnest(['doi', 'title', 'summary', 'brand', 'gap', 'energy', 'measurement.beamline', 'tags', 'tags', 'motor.m' || (p_size % 3), 'odd', 'span', 'range', 'name', 'cells']) as key,
  unnest(['10.1/' || p_partkey, p_name, p_type, p_brand, cast(p_size as varchar), cast(p_retailprice as varchar), p_type, p_brand, p_name, cast(p_size as varchar), case when p_size % 2 = 0 then 'True' else 'False' end, p_size || '-' || (p_size + 5) || 'mm', p_size || ' keV', 'set ' || (p_partkey % 7), cast(p_partkey % 5 as varchar)]) as value,
  unnest([null, null, null, null, 'mm', 'keV', null, null, null, 'um', null, null, null, null, null]) as unit from s)"""


def standard_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.standard_attributes(standard_documents(spark, d))


@register(f"with {STANDARD} select *, 'EXPLICIT' as type from attrs")
def standard_attribute_rows(spark, d):
    return standard_rows(spark, d)


@register("""select distinct doc_id, key, value, unit, 'EXPLICIT' as type from (select c_custkey as doc_id, unnest(['users.name', 'samples.id', 'samples.parameters.temp']) as key, unnest(['user ' || (c_custkey % 50), cast(c_custkey % 11 as varchar), cast(c_custkey % 300 as varchar)]) as value, unnest([null, null, 'K']) as unit from customer
 union all select c_custkey, unnest(['doi', 'titles.title', 'descriptions.description', 'descriptions.description', 'descriptions.descriptionType', 'descriptions.descriptionType']),
  unnest(['10.2/ab' || c_custkey, c_name, 'no', c_mktsegment, 'Other', case when c_custkey % 4 = 0 then 'Methods' else 'Abstract' end]), null from customer where c_custkey % 3 < 2)""")
def publication_attribute_rows(spark, d):
    raw = publication_records(spark, d)
    return A.publication_attributes(raw.select(F.get_json_object("raw", "$.collection.id").cast("long").alias("doc_id"), "raw"))


@register(f"with {STANDARD} select distinct key as name, case key when 'measurement.beamline' then 'measurement beamline' when 'motor.m0' then 'motor m 0' when 'motor.m1' then 'motor m 1' when 'motor.m2' then 'motor m 2' else key end as text from attrs where key not in ('doi', 'tags')")
def key_registry(spark, d):
    known = spark.createDataFrame([("doi",), ("tags",), ("unused",)], "name string")
    return A.key_registry(standard_rows(spark, d), known)


@register("""with f as (select * from (values (0, 'ESRF'), (1, 'PSI'), (2, 'MAX IV')) t(id, name)) select p_partkey as doc_id, 'publisher' as key, name as value, cast(null as varchar) as unit, 'DERIVED' as type from part join f on p_partkey % 4 = id where p_partkey % 5 <> 0""")
def derived_publisher(spark, d):
    p = table(spark, d, "part")
    there = p.filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("doc_id"), F.lit("publisher").alias("key"), F.lit("DERIVED").alias("type"))
    facilities = spark.createDataFrame([(0, "ESRF"), (1, "PSI"), (2, "MAX IV")], "facility_id long, name string")
    return A.derived_publisher(p.select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 4).alias("facility_id")), facilities, there)


@register("select p_partkey as doc_id, 'beamline' as key, p_type as value, cast(null as varchar) as unit, 'DERIVED' as type from part where p_partkey % 10 <> 0 and p_partkey % 17 <> 0 and p_partkey % 2 = 0")
def derived_beamlines(spark, d):
    docs = standard_documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "ESRF").otherwise("PSI").alias("facility"))
    return A.derived_beamlines(standard_rows(spark, d), docs, ["ESRF"])


@register(f"""with {STANDARD} select doc_id, 'span' || unnest(['.min', '.max']) as key, unnest([regexp_extract(value, '^\\d+'), regexp_extract(value, '-(\\d+)', 1)]) as value, 'mm' as unit, 'DERIVED' as type from attrs where key = 'span'
 union all select doc_id, key, regexp_extract(value, '^\\d+'), 'keV', 'DERIVED' from attrs where key = 'range'""")
def derived_measurements(spark, d):
    return A.derived_measurements(standard_rows(spark, d))


@register("""with v as (select p_partkey as doc_id, 'creator' as key, case p_partkey % 3 when 0 then 'A ' || p_brand || '; B ' || p_type when 1 then 'A ' || p_brand || ', B ' || p_type else p_brand end as value from part)
 select doc_id, key, unnest([split_part(value, case when value like '%;%' then ';' else ',' end, 1), trim(split_part(value, case when value like '%;%' then ';' else ',' end, 2))]) as value, 2 as parts, 'DERIVED' as type from v where value like '%;%' or value like '%,%'""")
def name_rows(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey") % 3
    value = F.when(k == 0, F.concat(F.lit("A "), "p_brand", F.lit("; B "), "p_type")).when(k == 1, F.concat(F.lit("A "), "p_brand", F.lit(", B "), "p_type")).otherwise(F.col("p_brand"))
    rows = p.select(F.col("p_partkey").alias("doc_id"), F.lit("creator").alias("key"), value.alias("value"), F.lit(None).cast("string").alias("unit"))
    return A.split_value_rows(rows, ["creator"]).drop("unit")


@register(f"""with {STANDARD}, own as (select *, 'EXPLICIT' as type from attrs union all select doc_id, 'span' || unnest(['.min', '.max']), unnest([regexp_extract(value, '^\\d+'), regexp_extract(value, '-(\\d+)', 1)]), 'mm', 'DERIVED' from attrs where key = 'span'
  union all select doc_id, key, regexp_extract(value, '^\\d+'), 'keV', 'DERIVED' from attrs where key = 'range' union all select doc_id, 'beamline', value, null, 'DERIVED' from attrs where key = 'measurement.beamline' union all select doc_id, 'publisher', 'ESRF', null, 'DERIVED' from (select distinct doc_id from attrs)
  union all select doc_id, 'publisher', 'European Synchrotron Radiation Facility', null, 'DERIVED' from (select distinct doc_id from attrs)),
 t as (select *, try_cast(value as double) as x from own)
 select key, type, count(*) as n, count(distinct doc_id) as docs, count(x) as numbers, round(sum(x), 4) as total, cast(sum(case when x is not null and unit is not null then 1 else 0 end) as bigint) as with_si,
  round(sum(case unit when 'mm' then x * 0.001 when 'um' then x * 1e-6 end), 8) as meters, cast(sum(case when lower(value) in ('true', 'false') then 1 else 0 end) as bigint) as booleans from t group by key, type""")
def extraction_chain(spark, d):
    """Records to documents to attribute rows, derived rows and typed rows, summed by key."""
    # written, as six branches read them: records are parsed once
    docs = written(standard_documents(spark, d).select("doc_id", "facility", "raw"), "documents")
    rows = written(A.standard_attributes(docs), "attributes")
    of = docs.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "facility", F.lit(1).alias("facility_id"))
    publishers = A.derived_publisher(of, spark.createDataFrame([(1, "ESRF")], "facility_id int, name string"), rows)
    names = A.harmonised_publishers(rows.unionByName(publishers))
    derived = A.derived_measurements(rows).unionByName(publishers).unionByName(names).unionByName(A.derived_beamlines(rows, of, ["ESRF"]))
    t = A.typed(rows.unionByName(derived))
    meters = F.when(F.col("value_si.dim") == "m", F.col("value_si.magnitude"))
    return t.groupBy("key", "type").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.count("value_numeric").alias("numbers"), F.round(F.sum("value_numeric"), 4).alias("total"), F.count("value_si").alias("with_si"), F.round(F.sum(meters), 8).alias("meters"), F.count("value_boolean").alias("booleans")
    )


@register("select distinct p_type as key, 'what ' || p_brand as description from part where p_partkey % 3 <> 0 and p_partkey % 3 <> 1")
def key_description_csv(spark, d):
    path, k = new_folder(spark, "descriptions"), F.col("p_partkey") % 3
    rows = table(spark, d, "part").select(F.concat(F.lit(" "), F.when(k == 0, "").otherwise(F.col("p_type")), F.lit(" ")).alias("key"), F.when(k != 1, F.concat(F.lit("what "), "p_brand", F.lit("  "))).alias("description"))
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.key_descriptions(spark, path).distinct()


@register(f"""select (o_orderkey % {PER_FILE}) as doc_index, l_linenumber - min(l_linenumber) over (partition by l_orderkey) as query_index, 'o' || o_orderkey as doi, 'q ' || l_partkey as query, case when l_linenumber % 2 = 0 then l_linenumber else 0 end as min_position
 from orders join (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as l_linenumber, l_partkey from lineitem) on l_orderkey = o_orderkey""")
def query_set_scan(spark, d):
    number = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x, i: F.struct(F.concat(F.lit("q "), x["l_partkey"]).alias("query"), F.when((i + 1) % 2 == 0, i + 1).alias("min_position")))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(number.alias("queries"))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("n")).join(lines, F.col("n") == F.col("l_orderkey"), "left")
    rows = docs.select("n", F.to_json(F.struct(F.concat(F.lit("o"), "n").alias("doi"), F.coalesce("queries", F.array().cast(lines.schema["queries"].dataType)).alias("queries"))).alias("json"))
    return readers.query_sets(spark, json_files(rows, "n", "json", "sets")).drop("dataset")


@register("""select case when o_orderkey % 4 = 1 then 'in ' || o_orderkey else 'ask ' || o_orderkey end as query, case when o_orderkey % 5 = 0 then '' else 'a' || o_orderkey || ',b' end as targets, case when o_orderkey % 2 = 0 then 'positive' else 'comparative' end as type, o_orderstatus as target_group, o_orderpriority as expert, 'expert' as source
 from orders where o_orderkey % 4 <> 3 and o_orderkey % 7 <> 0""")
def test_pair_scan(spark, d):
    n = F.col("o_orderkey")
    query = F.when(n % 7 == 0, " ").when(n % 4 == 1, F.to_json(F.struct(F.concat(F.lit("in "), n).alias("query")))).when(n % 4 == 3, "{}").otherwise(F.concat(F.lit(" ask "), n))
    pair = F.struct(query.alias("query"), F.when(n % 5 == 0, " , ").otherwise(F.concat(F.lit("a"), n, F.lit(" , b"))).alias("doi"), F.when(n % 2 == 1, "comparative").alias("type"), F.col("o_orderstatus").alias("group"), F.col("o_orderpriority").alias("expert"), n.cast("string").alias("id"))
    rows = table(spark, d, "orders").select(n.alias("n"), F.to_json(pair).alias("json"))
    return readers.test_pairs(spark, json_files(rows, "n", "json", "pairs")).drop("tpid", "group_id").withColumn("targets", F.array_join("targets", ","))


# ---------------------------------------------------------------- files out and in again

RESULTS = """r as (select run, o_orderstatus as test_name, o_orderpriority as dataset_name, avg((o_totalprice + run) / 1000000) as s from orders, (values (1), (2)) t(run) group by all)"""


@register(f"with {RESULTS} select case run when 1 then '2026-01-01 00:00:00' else '2026-01-02 10:20:30' end as at, test_name, dataset_name, round(s, 4) as avg_score, round(s * 100, 2) as avg_score_percent from r")
def results_csv_over_runs(spark, d):
    path = new_folder(spark, "runs")
    for run, stamp in ((1, "20260101_000000"), (2, "20260102_102030")):
        scores = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("test_name"), F.col("o_orderpriority").alias("dataset_name")).agg(F.avg((F.col("o_totalprice") + run) / 1000000).alias("avg_score"))
        writers.write_results(scores.withColumn("avg_score_percent", F.col("avg_score") * 100), f"{path}/results_{stamp}.csv")
    found = readers.results_over_runs(spark, f"{path}/results_*.csv")
    return found.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "test_name", "dataset_name", "avg_score", "avg_score_percent")


@register("select o_orderpriority as config, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as query_index, o_totalprice as score from orders")
def raw_score_round_trip(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("config"), F.col("o_orderkey").alias("query_index"), F.col("o_totalprice").alias("score"))
    path = new_folder(spark, "scores")
    one = writers.raw_score_json(o).select("config", F.concat(F.lit("{"), F.to_json(F.array("config")).substr(F.lit(2), F.length(F.to_json(F.array("config"))) - 2), F.lit(": "), "json", F.lit("}")).alias("value"))
    one.withColumnRenamed("config", "c").write.partitionBy("c").text(path)
    return readers.raw_scores(spark, f"{path}/*/*.txt")


@register("""select 'd' || p_partkey as "DOI", p_name || ', "' || p_type || '"' as "Title", p_brand as "Facility", case when p_size > 25 then 'matched' else 'suggested' end as "Relevance", p_retailprice as "Overall Score" from part""")
def result_export(spark, d):
    p, path = table(spark, d, "part"), new_folder(spark, "export")
    rows = p.select(F.concat(F.lit("d"), "p_partkey").alias("doi"), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("title"), F.col("p_brand").alias("facility"), F.when(F.col("p_size") > 25, "matched").otherwise("suggested").alias("bucket"), F.col("p_retailprice").alias("overall_score"))
    writers.export_results(rows, path)
    return spark.read.schema("DOI string, Title string, Facility string, Relevance string, `Overall Score` double").csv(path, header=True, escape='"')


LOG = """l as (select l_orderkey as q, l_linenumber as doc_id, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) - 1 as position, l_discount as s from lineitem), k as (select *, position < 2 as kept from l)"""


def search_log(spark: SparkSession, d: str) -> DataFrame:
    """A logged search for every order: its lines are the results, the first two of them relevant."""
    from pyspark.sql import Window as W

    lines = table(spark, d, "lineitem")
    position = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")) - 1
    results = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("doc_id"), position.alias("position"), F.col("l_discount").alias("overall_score")).withColumn("kept", F.col("position") < 2).withColumn("knee_score", F.lit(0.5))
    queries = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("search_query"), F.to_json(F.struct(F.col("o_orderstatus").alias("intention"))).alias("structured_data"), F.lit(None).cast("string").alias("modified_query_id"), F.col("o_orderdate").alias("created_at"))
    path = new_folder(spark, "log")
    writers.append_log(writers.log_rows(results, queries), path)
    return spark.read.parquet(path)


@register(f"""with {LOG} select sha256(o_orderkey || '|' || o_orderpriority) as id, o_orderpriority as search_query, coalesce(a.n, 0) as relevant, coalesce(a.m, 0) as weakly_relevant, coalesce(a.best, -1) as best
 from orders left join (select q, count(*) filter (kept) as n, count(*) filter (not kept) as m, max(case when position = 0 then doc_id end) as best from k group by q) a on a.q = o_orderkey""")
def search_log_append(spark, d):
    log = search_log(spark, d)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return log.select("id", "search_query", F.greatest(size("results.relevant"), F.lit(0)).cast("long").alias("relevant"), F.greatest(size("results.weakly_relevant"), F.lit(0)).cast("long").alias("weakly_relevant"), F.coalesce(F.get("results.relevant", F.lit(0))["doc_id"], F.lit(-1).cast("long")).alias("best"))


@register("""select e.o_orderkey as edit, sha256(p.o_orderkey || '|' || p.o_orderpriority) as modified_query_id, '{"intention":"' || p.o_orderstatus || '"}' as parent_data from orders e join orders p on p.o_orderkey + 1 = e.o_orderkey where e.o_orderkey % 5 = 1""")
def log_replay(spark, d):
    o = table(spark, d, "orders")
    parents = o.select((F.col("o_orderkey") + 1).alias("edit"), F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority"), 256).alias("modified_query_id"))
    edits = o.filter("o_orderkey % 5 = 1").select(F.col("o_orderkey").alias("edit")).join(parents, "edit")
    return tables.with_replay(search_log(spark, d), edits)


@register("""select sha256(l_orderkey || '|' || o_orderpriority) as statistic_id, cast(l_linenumber as bigint) as doc_id, case l_linenumber % 4 when 0 then 'Match' when 1 then 'Relevant' else 'Suggested' end as feedback_type from lineitem join orders on l_orderkey = o_orderkey where l_linenumber % 4 <> 3 and l_quantity < 25""")
def feedback_on_shown_results(spark, d):
    lines, n = table(spark, d, "lineitem"), F.col("l_linenumber") % 4
    label = F.when(n == 0, "Match").when(n == 1, "Relevant").when(n == 2, "Suggested").otherwise("Nonsense")
    # half of the feedback names documents that the search did not return
    doc = F.when(F.col("l_quantity") < 25, F.col("l_linenumber")).otherwise(F.col("l_linenumber") + 1000).cast("long")
    lines = lines.join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    feedback = lines.select(F.sha2(F.concat_ws("|", F.col("l_orderkey").cast("string"), "o_orderpriority"), 256).alias("statistic_id"), doc.alias("doc_id"), label.alias("feedback_type"))
    return incremental.valid_feedback(feedback, search_log(spark, d))


# ---------------------------------------------------------------- inference


@register("""with c as (select p_partkey // 14 as reply, (p_partkey // 14) % 13 as doc_id, p_partkey, p_brand as key, p_type as value, p_size from part),
 u as (select *, row_number() over (partition by reply order by p_partkey) as place from c where p_size % 11 <> 0),
 e as (select doc_id, key, value, reply, unnest(range(p_size % 15 + 1)) as row from u where place <= 12),
 s as (select doc_id, key, value, count(distinct row) as evidence, count(distinct reply) as clusters from e group by all),
 r as (select *, rank() over (partition by doc_id, key order by evidence desc, clusters desc) as r from s)
 select doc_id, key, min(value) as value, min(evidence) as evidence, min(clusters) as clusters from r where r = 1 group by doc_id, key having count(*) = 1""")
def votes_from_replies(spark, d):
    """Replies with fourteen candidates, some without a description, and up to fifteen evidence rows each."""
    p = table(spark, d, "part")
    one = F.struct(F.col("p_brand").alias("name"), F.when(F.col("p_size") % 11 == 0, "  ").otherwise("said").alias("description"), F.col("p_type").alias("value"), F.lit("").alias("unit"), F.concat(F.array(F.lit("bad"), F.lit("-1")), F.sequence(F.lit(0), F.col("p_size") % 15).cast("array<string>")).alias("evidence_indices"))
    reply = F.floor(F.col("p_partkey") / 14).cast("long").alias("reply")
    replies = p.select(reply, F.struct("p_partkey", one.alias("c")).alias("x")).groupBy("reply").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]).alias("filters"))).alias("json"))
    found = inferred.parse_candidates(replies.withColumn("doc_id", F.col("reply") % 13))
    rows = found.select("doc_id", F.col("name").alias("key"), "value", "unit", F.lit("row").alias("ekey"), F.explode("evidence_indices").alias("row"), F.col("reply").alias("cluster"))
    return inferred.vote(rows.withColumn("evalue", F.col("row").cast("string"))).drop("unit")


PACKED = """rows_ as (select distinct p_partkey % 97 as doc_id, unnest(['name', 'brand', 'type', 'size', 'price']) as key, unnest([p_name, p_brand, p_type, cast(p_size as varchar), cast(p_retailprice as varchar)]) as value from part),
 n as (select *, row_number() over (partition by doc_id order by key) as place from (select doc_id, key, count(*) as n from rows_ group by all))"""
PACK_SQL = f"""with recursive {PACKED},
 f as (select doc_id, cast(0 as bigint) as place, cast(-1 as bigint) as nxt, cast(0 as bigint) as room, cast(null as varchar) as key, cast(0 as bigint) as first from (select distinct doc_id from n)
  union all select n.doc_id, n.place, case when n.n > 10 then f.nxt + (n.n + 9) // 10 when n.n > f.room then f.nxt + 1 else f.nxt end, case when n.n > 10 then 0 when n.n > f.room then 10 - n.n else f.room - n.n end, n.key, case when n.n > 10 or n.n > f.room then f.nxt + 1 else f.nxt end from f join n on n.doc_id = f.doc_id and n.place = f.place + 1)
 select r.doc_id, r.key, value, cast(first + (row_number() over (partition by r.doc_id, r.key order by value) - 1) // 10 as int) as cluster from rows_ r join f on f.doc_id = r.doc_id and f.key = r.key"""


@register(PACK_SQL)
def pack_evidence(spark, d):
    p = table(spark, d, "part")
    rows = A.unpivot(p.withColumnsRenamed({"p_name": "name", "p_brand": "brand", "p_type": "type", "p_size": "size", "p_retailprice": "price"}), "p_partkey", ["name", "brand", "type", "size", "price"])
    return inferred.pack_rows(rows.select((F.col("doc_id") % 97).alias("doc_id"), "key", "value"))


@register("""with old as (select p_partkey as doc_id, 'size' as key, cast(p_size as varchar) as value, case when p_partkey % 2 = 0 then 'INFERRED' else 'EXPLICIT' end as type from part),
 new as (select p_partkey as doc_id, unnest(['size', 'type']) as key, unnest([cast(p_size as varchar), p_type]) as value from part where p_partkey % 3 = 0),
 keep as (select * from old where not (type = 'INFERRED' and doc_id % 3 = 0))
 select * from keep union all select n.*, 'INFERRED' from new n where not exists (select 1 from keep k where k.doc_id = n.doc_id and k.key = n.key and k.value = n.value and k.type <> 'INFERRED')""")
def inferred_replaced(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_size", "p_type")
    none = F.lit(None).cast("string").alias("unit")
    old = p.select("doc_id", F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value"), none, F.when(F.col("doc_id") % 2 == 0, "INFERRED").otherwise("EXPLICIT").alias("type"))
    some = p.filter("doc_id % 3 = 0")
    new = some.select("doc_id", F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value"), none).unionByName(some.select("doc_id", F.lit("type").alias("key"), F.col("p_type").alias("value"), none))
    return inferred.replace_inferred(old, new, some).drop("unit")


@register("""select o_orderkey, sha256('{"a":' || o_custkey || ',"b":"' || o_orderpriority || '"}') as mark, lower(trim(regexp_replace('  A  ' || o_orderpriority || ' b', '\\s+', ' ', 'g'))) as text from orders""")
def request_fingerprints(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", scalars.fingerprint(F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("b")).alias("mark"), scalars.norm_text(F.concat(F.lit("  A  "), "o_orderpriority", F.lit(" b"))).alias("text"))


@register("select count(*) as rows, count(distinct p_type) as texts, count(distinct p_type) as vectors, 384 as width, count(*) - count(p_type) as missing from part")
def memoised_embedding(spark, d):
    coded = embed_distinct(table(spark, d, "part").select("p_type"), "p_type", "v")
    return coded.agg(F.count("*").alias("rows"), F.count_distinct("p_type").alias("texts"), F.count_distinct("v").alias("vectors"), F.max(F.size("v")).alias("width"), F.sum(F.col("v").isNull().cast("long")).alias("missing"))
