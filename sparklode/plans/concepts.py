"""A dictionary of concepts in texts, and rows that share most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.functions import text as T
from sparklode.operators import concepts
from sparklode.plans.registry import Registry
from sparklode.plans.texts import TOKENS
from sparklode.sources import load
from sparklode.sources.scratch import Scratch

register = Registry()

#: Signs that are concepts of their own; fixed values of this query.
SYMBOLS = ["%%%", "***", "&&&", "$$$", "###", " | "]

NAMES = f"""
b as (select item_id, {TOKENS} as w from benchmark),
names as (select distinct unnest([w[2], array_to_string(w[3:4], ' '), array_to_string(w[5:7], '-')]) as name from b where len(w) >= 7),
keys as (select distinct name, unnest([array_to_string(regexp_extract_all(lower(name), '{T.WORD}', 0), ' '), array_to_string(regexp_extract_all(lower(name), '[a-z0-9à-ÿ]+', 0), ' ')]) as gram from names),
r as (select doc_id as id, unnest([{TOKENS}, regexp_extract_all(lower(text), '[a-z0-9à-ÿ]+', 0)]) as w from documents),
g as (select distinct id, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) as gram from r),
signs as (select unnest([{", ".join(f"'{s}'" for s in SYMBOLS)}]) as name),
found as (select distinct id, name as concept from g join keys using (gram) union select doc_id, name from documents, signs where contains(text, name))
"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one to three words taken from the benchmark, the longest with hyphens, in all documents."""
    words = load(spark, sf_dir, "benchmark").select(T.tokens(F.col("text")).alias("w")).where(F.size("w") >= 7)
    forms = F.array(F.element_at("w", 2), F.array_join(F.slice("w", 3, 2), " "), F.array_join(F.slice("w", 5, 3), "-"))
    names = words.select(F.explode(forms).alias("name"))
    texts = load(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")
    return concepts.concepts_of(texts, names, SYMBOLS)


@register(f"with {NAMES} select id, concept from found")
def concept_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names and signs of the dictionary in every document."""
    return _found(spark, sf_dir)


@register(f"""
with {NAMES}, tags as (select doc_id as id, unnest([lang, source]) as tag from documents),
m as (select id, 'c:' || concept as term, 2 as w from found union all select id, 't:' || tag, 1 from tags),
s as (select q.id as query_id, d.id as id, sum(d.w)::bigint as score from m q join m d using (term) where q.id % 100 = 0 and q.id <> d.id group by 1, 2)
select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from s qualify rank <= 10
""")
def concept_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that share most concepts and tags with every hundredth document."""
    docs = load(spark, sf_dir, "documents", "doc_id", "lang", "source")
    found = Scratch(spark, "concepts").keep(_found(spark, sf_dir), "found")
    tags = docs.select(F.col("doc_id").alias("id"), F.explode(F.array("lang", "source")).alias("tag"))
    return concepts.overlap_top(docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id")), found, tags, 10)


@register("""
with dict as (select lower(trim(regexp_replace(p_type, '[ \\t]+', ' ', 'g'))) as key, min(p_type) as name from part where p_partkey % 2 = 0 group by 1),
given as (select p_partkey // 10 as id, p_partkey as position, case when p_partkey % 3 = 0 then '  ' || upper(p_type) || ' ' else p_type end as raw from part),
m as (select id, position, coalesce(name, raw) as concept, name is not null as known from given left join dict on lower(trim(regexp_replace(raw, '[ \\t]+', ' ', 'g'))) = key)
select id, concept, known, min(position) as position from m group by 1, 2, 3
""")
def concept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a model gave them, in its order, against a dictionary of types: known ones once each, others as they are."""
    parts = load(spark, sf_dir, "part", "p_partkey", "p_type")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.upper("p_type"), F.lit(" "))).otherwise(F.col("p_type"))
    given = parts.select(F.floor(F.col("p_partkey") / 10).alias("id"), F.col("p_partkey").alias("position"), raw.alias("raw"))
    return concepts.matched(given, parts.where("p_partkey % 2 = 0").select(F.col("p_type").alias("name"))).select("id", "concept", "known", "position")
