"""Readers of records, descriptions, query sets, results and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DATACITE = "datacite array<struct<doi:string,attributes:struct<doi:string,titles:array<struct<title:string>>,descriptions:array<struct<description:string,descriptionType:string>>>,titles:array<struct<title:string>>,descriptions:array<struct<description:string,descriptionType:string>>>>"


def records(spark: SparkSession, path: str, facility: str | None = None) -> DataFrame:
    """`raw, facility, source_file`: each element of JSON array files as a text.

    A file is one array; the facility is that given or the file's name.
    """
    files = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_name").alias("source_file"))
    each = files.select("source_file", F.explode(F.from_json("value", "array<string>")).alias("raw"))
    name = F.lit(facility) if facility else F.regexp_extract("source_file", r"^([^.]+)", 1)
    return each.select("raw", name.alias("facility"), "source_file")


def standard_documents(raw: DataFrame, record_key: str = "document", text_field: str = "summary") -> DataFrame:
    """`doi, title, text, raw, facility`: the record's sub-object; blank dois are dropped."""
    get = lambda field: F.get_json_object("raw", f"$.{record_key}.{field}")
    rows = raw.select(F.trim(get("doi")).alias("doi"), get("title").alias("title"), get(text_field).alias("text"), "raw", "facility")
    return rows.filter(F.col("doi") != "")


def publication_documents(raw: DataFrame) -> DataFrame:
    """`doi, title, text, raw, facility`: title and abstract of the first datacite entry, the doi in upper case; rows without one are dropped."""
    first = F.get(F.from_json("raw", _DATACITE)["datacite"], F.lit(0))
    pick = lambda name: F.coalesce(first["attributes"][name], first[name])
    abstract = F.get(F.filter(pick("descriptions"), lambda d: d["descriptionType"] == "Abstract"), F.lit(0))["description"]
    rows = raw.withColumn("__d", first).filter("__d is not null")
    return rows.select(F.upper(F.trim(pick("doi"))).alias("doi"), F.get(pick("titles"), F.lit(0))["title"].alias("title"), F.coalesce(abstract, F.lit("")).alias("text"), "raw", "facility").filter(F.col("doi") != "")


def raw_record(docs: DataFrame, doi: str) -> DataFrame:
    """The stored record of a doi, canonical if it parses; an unknown doi is an error."""
    found = docs.filter(F.col("doi") == doi).select("doi", F.coalesce(F.to_json(F.try_parse_json("raw")), F.col("raw")).alias("raw"))
    if found.isEmpty():
        raise KeyError(doi)
    return found


def key_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """`key, description` of CSV files with a header, both trimmed and not empty."""
    rows = spark.read.schema("key string, description string").csv(path, header=True)
    return rows.select(F.trim("key").alias("key"), F.trim("description").alias("description")).filter("key <> '' and description <> ''")


def query_sets(spark: SparkSession, path: str) -> DataFrame:
    """`dataset, doc_index, query_index, doi, query, min_position` of nested JSON files, in file order."""
    kind = "array<struct<doi:string,queries:array<struct<query:string,min_position:int>>>>"
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("dataset"), F.from_json("value", kind).alias("docs"))
    docs = files.select("dataset", F.posexplode("docs").alias("doc_index", "d"))
    each = docs.select("dataset", "doc_index", "d.doi", F.posexplode("d.queries").alias("query_index", "q"))
    return each.select("dataset", "doc_index", "query_index", "doi", "q.query", F.coalesce("q.min_position", F.lit(0)).alias("min_position"))


def test_pairs(spark: SparkSession, path: str, source: str = "expert") -> DataFrame:
    """`tpid, query, targets, type, target_group, expert, source, group_id` of flat JSON files.

    Empty queries are skipped; a query that is itself JSON gives its `query`
    and is skipped without one; the type is positive unless told; targets are
    a comma list; the group is the file's name.
    """
    kind = "array<struct<type:string,expert:string,doi:string,query:string,id:string,group:string>>"
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("group_id"), F.from_json("value", kind).alias("p"))
    each = files.select("group_id", F.explode("p").alias("p")).select("group_id", "p.*")
    own = F.trim("query")
    query = F.when(own.startswith("{"), F.trim(F.get_json_object("query", "$.query"))).otherwise(own)
    rows = each.withColumn("query", query).filter(F.col("query") != "")
    targets = F.filter(F.transform(F.split(F.coalesce("doi", F.lit("")), ","), lambda d: F.trim(d)), lambda d: d != "")
    return rows.select(F.sha2(F.concat_ws("|", "group_id", "id", "query"), 256).alias("tpid"), "query", targets.alias("targets"), F.coalesce("type", F.lit("positive")).alias("type"), F.col("group").alias("target_group"), "expert", F.lit(source).alias("source"), "group_id")


def results_over_runs(spark: SparkSession, path: str) -> DataFrame:
    """`timestamp, test_name, dataset_name, avg_score, avg_score_percent` of `results_*.csv` files or folders, the time from the name."""
    rows = spark.read.schema("test_name string, dataset_name string, avg_score double, avg_score_percent double").csv(path, header=True, enforceSchema=False)
    stamp = F.regexp_extract(F.col("_metadata.file_path"), r"results_(\d{8}_\d{6})[^/]*(?:/[^/]*)?$", 1)
    return rows.select(F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss")).alias("timestamp"), "test_name", "dataset_name", "avg_score", "avg_score_percent")


def raw_scores(spark: SparkSession, path: str) -> DataFrame:
    """`config, query_index, score` of JSON files that map configurations to lists of scores."""
    files = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,array<double>>").alias("m"))
    return files.select(F.explode("m").alias("config", "scores")).select("config", F.posexplode("scores").alias("query_index", "score"))
