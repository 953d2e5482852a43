"""Queries whose conditions differ from query to query: trees as rows, and searches in one call."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import attributes as A
from tessera.operators import condition_rows
from tessera.plans import hybrid
from tessera.plans import search as S
from tessera.queries import CHUNK_RANK, DIST, PARTS, POSTINGS, SI_SQL, chunk_vectors, document_vectors, flags, part_attributes, rounded, vector_queries
from tessera.registry import register, table

#: Trees that are unlike each other.
TREES = 60
WORDS = ["Standard", "Large", "Economy"]


class Rule:
    """The tree of number t, as conditions and as SQL over `parts` rows; `names` says how a key is called and found."""

    def __init__(self, t: int, named=lambda key: key, sql_of=lambda key: f"key = '{key}'"):
        self.named, self.sql_of, self.flags = named, sql_of, []
        text = self.leaf("type", "=", WORDS[t % 3], f"case when value ilike '{WORDS[t % 3]}%' then 2 when value ilike '%{WORDS[t % 3]}%' then 1 else 0 end")
        size = self.leaf("size", ">", t % 45, f"case when value is not null and x > {t % 45} then 1 else 0 end")
        brand = self.leaf("brand", "IN", [f"Brand#{11 + t % 15}", "Brand#23"], f"case when value in ('Brand#{11 + t % 15}', 'Brand#23') then 1 else 0 end")
        letter = "abcdefgh"[t % 8]
        name = self.leaf("name", "LIKE", letter, f"case when value ilike '{letter}%' then 2 when value ilike '%{letter}%' then 1 else 0 end")
        price = self.leaf("price", "BETWEEN", [900 + t, 1100 + 5 * t], f"case when x between {900 + t} and {1100 + 5 * t} then 1 else 0 end")
        other = self.leaf("type", "NOT LIKE", WORDS[(t + 1) % 3], f"case when not (value ilike '%{WORDS[(t + 1) % 3]}%') then 1 else 0 end")
        wide = self.leaf("size", ">=", t % 9, f"case when case when si is null then x >= {t % 9} else u = 'mm' and si >= {t % 9} * 0.001 end then 1 else 0 end", unit="mm")
        both, either = (lambda *p: self.node("AND", p)), (lambda *p: self.node("OR", p))
        shapes = [lambda: both(text, either(size, brand)), lambda: either(name, both(price, size)), lambda: both(other, either(brand, name, price), wide), lambda: either(both(either(text, name), brand), both(wide, price, other)), lambda: both(wide)]
        self.tree, self.truth, self.used = shapes[t % 5]()

    def leaf(self, key, op, value, sql, **more):
        n = len(self.flags)
        self.flags.append(f"max(case when {self.sql_of(key)} then {sql} else 0 end) as f{n}")
        return {"name": self.named(key), "operator": op, "value": value, **more}, f"f{n} > 0", [n]

    def node(self, logic, parts):
        return {"logic": logic, "conditions": [p[0] for p in parts]}, "(" + f" {logic} ".join(p[1] for p in parts) + ")", sorted({n for p in parts for n in p[2]})

    def sql(self, t: int) -> str:
        total = " + ".join(f"f{n}" for n in self.used)
        return f"select {t} as tree, doc_id, case when {self.truth} then 1 else 0 end as full_match, {total} as partial_match_count, dense_rank() over (order by {total} desc) as partial_rank from (select doc_id, {', '.join(self.flags[n] for n in self.used)} from t group by doc_id) where {total} > 0"


ROWS = f"{PARTS}, s as (select *, try_cast(value as double) as x, unit as u from parts), t as (select *, {SI_SQL} as si from s)"


def asked_trees(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(t, json.dumps(r.tree)) for t, r in enumerate(rules)], "query_id long, filters string")


@register(f"with {ROWS} " + " union all ".join(Rule(t).sql(t) for t in range(TREES)))
def cond_trees_as_rows(spark, d):
    leaves, trees = condition_rows.condition_rows(asked_trees(spark, [Rule(t) for t in range(TREES)]))
    ranked, of = condition_rows.rank_trees(part_attributes(spark, d), leaves, trees, typing=A.typed)
    return ranked.join(of, "tree_id").select(F.col("query_id").alias("tree"), "doc_id", "full_match", "partial_match_count", "partial_rank")


SLASHED = {"prefix": ("=", "C:\\bRand"), "pair": ("=", "d:\\\\brand"), "any": ("=", "%\\\\brand#1"), "not": ("!=", "\\1"), "literal": ("LIKE", "100\\%"), "open": ("LIKE", "#2\\")}
#: A backslash before anything but a wildcard and itself vanishes; here each is written out as it then reads.
SLASHED_SQL = {"prefix": "case when value ilike 'C:brand%' then 2 when value ilike '%C:brand%' then 1 else 0 end", "pair": "case when starts_with(lower(value), 'd:' || chr(92) || 'brand') then 2 when contains(lower(value), 'd:' || chr(92) || 'brand') then 1 else 0 end", "any": "case when contains(lower(value), chr(92) || 'brand#1') then 2 else 0 end", "not": "case when not contains(value, '1') then 1 else 0 end", "literal": "case when starts_with(value, '100%') then 2 when contains(value, '100%') then 1 else 0 end", "open": "case when value = '#2%' then 2 when ends_with(value, '#2%') then 1 else 0 end"}
_PATHS = "paths as (select p_partkey as doc_id, 'path' as key, case p_partkey % 5 when 0 then 'C:' || p_brand when 1 then 'D:' || chr(92) || p_brand when 2 then '100%' || p_brand when 3 then p_type || '#2%' else '100' || p_brand end as value from part)"


@register(f"with {_PATHS}, f as (select doc_id, " + ", ".join(f"max({c}) as \"{n}\"" for n, c in SLASHED_SQL.items()) + " from paths group by doc_id) select * from f where greatest(" + ", ".join(f'"{n}"' for n in SLASHED) + ") > 0")
def cond_text_backslash(spark, d):
    n = F.col("p_partkey") % 5
    value = F.when(n == 0, F.concat(F.lit("C:"), "p_brand")).when(n == 1, F.concat(F.lit("D:\\"), "p_brand")).when(n == 2, F.concat(F.lit("100%"), "p_brand")).when(n == 3, F.concat("p_type", F.lit("#2%"))).otherwise(F.concat(F.lit("100"), "p_brand"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("path").alias("key"), value.alias("value"))
    return flags(spark, rows, {k: {"name": "path", "operator": o, "value": v} for k, (o, v) in SLASHED.items()})


# ---------------------------------------------------------------- one call

#: Inner numbers of documents lie so far behind their ids.
INNER = 1_000_000
KEYS = ["name", "brand", "type", "size", "price"]
NAME_THRESHOLD = 0.9
#: Raw names: each key is asked for as `n` and a number, whose vector is that of a query; keys have the vectors after the first.
_NAMED = {k: f"n{i}" for i, k in enumerate(KEYS)}
RESOLVED = f"""kv as (select query_id // 20 as n, ([{', '.join(repr(k) for k in KEYS)}])[vec_id] as key, distance from dist where query_id < 100 and vec_id between 1 and {len(KEYS)}),
 kh as (select n, key from kv where distance < {NAME_THRESHOLD}), kn as (select n, count(*) as hits from kh group by n),
 kr as (select kv.n, key, row_number() over (partition by kv.n order by distance, key) as place, coalesce(hits, 0) as hits from kv left join kn on kn.n = kv.n where distance >= {NAME_THRESHOLD}),
 rk as (select n, key from kh union all select n, key from kr where place <= greatest(0, 2 - hits))"""


def one_call_rule(t: int) -> Rule:
    return Rule(t, lambda key: _NAMED[key], lambda key: f"key in (select key from rk where n = {KEYS.index(key)})")


ONE_CALL = f"""{ROWS}, {DIST}, {RESOLVED}, {POSTINGS},
 ds as (select query_id, vec_id as doc_id, dense_rank() over (partition by query_id order by distance) as rank from dist where distance < 0.5 and vec_id in (select doc_id from documents)), {CHUNK_RANK},
 qs as (select distinct query_id, query_id // 20 % {TREES} as tree, query_id // 20 % 4 <> 0 as has_tree, query_id // 20 % 3 = 0 as has_words from dist),
 ws as (select query_id, 'the' || query_id % 7 as term from qs where has_words union all select query_id, lower(lang) from qs, (select distinct lang from documents) where has_words),
 kw as (select query_id, doc_id, dense_rank() over (partition by query_id order by sum(tf) desc) as rank from ws join post using (term) group by query_id, doc_id),
 tr as ({' union all '.join(one_call_rule(t).sql(t) for t in range(TREES))}),
 ar as (select query_id, doc_id, rank as r1, null as r2, null as r3, null as r4, null as r5 from ds union all select query_id, doc_id, null, rank, null, null, null from chunkrank union all select query_id, doc_id, null, null, full_match, partial_rank, null from tr join qs using (tree) where has_tree
  union all select query_id, doc_id, null, null, null, null, rank from kw),
 sm as (select query_id, doc_id, sum(coalesce(1.0 / (r1 + 6), 0)) as s1, sum(coalesce(1.0 / (r2 + 6), 0)) as s2, sum(coalesce(case when r3 = 0 then 0.0 else 1.0 / (r3 + 6) end, 0)) as s3, sum(coalesce(1.0 / (r4 + 6), 0)) as s4, sum(coalesce(1.0 / (r5 + 10), 0)) as s5 from ar where doc_id in (select doc_id from documents) group by all),
 tp as (select *, s1 + s2 + s3 + s4 + s5 as s0 from sm qualify row_number() over (partition by query_id order by round(s1 + s2 + s3 + s4 + s5, 9) desc, round(s1, 9) desc, round(s2, 9) desc, round(s3, 9) desc, round(s4, 9) desc, round(s5, 9) desc, doc_id) <= 20)"""


@register(f"""with {ONE_CALL} select tp.query_id, tp.doc_id, d.source, round(s0 / (2.0 / 7 + case when has_tree then 2.0 / 7 else 0 end + case when has_words then 1.0 / 11 else 0 end), 6) + 0.0 as overall_score, round(s1 * 7, 6) + 0.0 as document_score, round(s2 * 7, 6) + 0.0 as chunk_score, round(s3 * 7, 6) + 0.0 as conditions_full_score, round(s4 * 7, 6) + 0.0 as conditions_partial_score, round(s5 * 11, 6) + 0.0 as keywords_score
 from tp join qs using (query_id) join documents d on d.doc_id = tp.doc_id""")
def search_in_one_call(spark, d):
    """Queries with own filters over raw names, keyed by inner numbers: resolved, ranked, fused and described in one call."""
    docs = table(spark, d, "documents")
    n = F.col("query_id").cast("long") / 20
    at = F.floor(n).cast("long")
    trees = asked_trees(spark, [one_call_rule(t) for t in range(TREES)]).withColumnRenamed("query_id", "tree")
    words = docs.select("lang").filter("lang is not null").distinct().agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    q = vector_queries(spark, d).withColumn("at", at).withColumn("tree", F.when(F.col("at") % 4 != 0, F.col("at") % TREES)).join(trees, "tree", "left").crossJoin(F.broadcast(words))
    none = F.array().cast("array<string>")
    q = q.select("query_id", "intention_vector", F.lit("").alias("intention"), F.when(F.col("at") % 3 == 0, F.concat(F.array(F.concat(F.lit("the"), (F.col("query_id") % 7).cast("string"))), "langs")).otherwise(none).alias("keywords"), "filters")
    inner = lambda df, c: df.withColumn("document_id", F.col(c) + INNER).drop(c)
    e = table(spark, d, "embeddings")
    corpus = S.Corpus(
        documents=docs.select("doc_id", "source").join(document_vectors(spark, d), "doc_id", "left").withColumn("document_id", F.col("doc_id") + INNER),
        chunks=inner(chunk_vectors(spark, d), "doc_id"), attributes=inner(part_attributes(spark, d), "doc_id"), typing=A.typed, texts=docs.select("doc_id", "text"), stem=False,
        keys=e.filter(f"vec_id between 1 and {len(KEYS)}").select(F.element_at(F.array(*map(F.lit, KEYS)), F.col("vec_id").cast("int")).alias("key"), F.col("embedding").alias("vector")),
    )
    names = e.filter(f"vec_id % 20 = 0 and vec_id < {20 * len(KEYS)}").select(F.concat(F.lit("n"), F.floor(F.col("vec_id") / 20)).alias("name"), F.col("embedding").alias("vector"))
    leaves, of = condition_rows.condition_rows(q)
    found = S.search(q, S.Conditions(leaves, of, names), corpus, name_threshold=NAME_THRESHOLD, least_names=2)
    return rounded(found.select("query_id", "doc_id", "source", *hybrid.SCORES), *hybrid.SCORES)
