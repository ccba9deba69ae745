"""Audits of what edits have changed, and of how items are marked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.operators import staleness
from sparklode.plans.registry import Registry
from sparklode.sources import load

register = Registry()

FLAT = r"trim(regexp_replace(lower({}), '[ \t\n\r\f\v]+', ' ', 'g'))"
#: Items are documents: the first line is the title, the second the statement, each further one a part. The first journal is a backup
#: of every sixth one as it was, the second a log of edits, some of one place twice.
JOURNALS = """
l as (select doc_id as id, string_split(text, chr(10)) as l from documents),
items as (select id, l[1] as title, coalesce(l[2], '') as statement, l from l),
parts as (select id, unnest(range(1, len(l) - 1)) as part, unnest(l[3:]) as value from l where len(l) > 2),
slots as (select id, '0' as slot, title as value from items union all select id, '1', statement from items union all select id, 'part-' || lpad(part::varchar, 9, '0'), value from parts),
backup as (select 0 as seq, id, 'title' as field, 0 as part, case when id % 12 = 0 then translate(title, 'abcdef', 'ABCDEF') else title end as old from items where id % 6 = 0
  union all select 0, id, 'statement', 0, case when id % 18 = 0 then statement || ' before' else statement end from items where id % 6 = 0
  union all select 0, id, 'part', part, case when id % 30 = 0 and part = 1 then value || '  ' when id % 42 = 0 and part = 2 then 'other' else value end from parts where id % 6 = 0
  union all select 0, id, 'part', 1000000, 'gone' from items where id % 6 = 0),
log as (select 1 as seq, id, 'statement' as field, 0 as part, 'at first' as old from items where id % 10 = 0
  union all select 2, id, 'statement', 0, case when id % 20 = 0 then statement else 'then' end from items where id % 10 = 0
  union all select 3, id, 'solution', 0, 'outside' from items where id % 15 = 0
  union all select 4, id, 'title', 0, 'A title' from items where id % 35 = 0)
"""


def _places(name: str) -> str:
    flat = lambda c: FLAT.format(f"string_agg({c}, ' ' || chr(10) || ' ' order by slot)")
    return f"""
{name}_o as (select id, slot, arg_max(old, seq) as old from (select id, seq, old, case field when 'title' then '0' when 'statement' then '1' when 'part' then 'part-' || lpad(part::varchar, 9, '0') end as slot from {name}) where slot is not null group by 1, 2),
{name}_c as (select id, slot, old from {name}_o join slots using (id, slot) where old <> value),
{name}_t as (select id, sha1({flat("value")}) <> sha1({flat("coalesce(old, value)")}) as stale from slots left join {name}_c using (id, slot) where id in (select id from {name}_c) group by id)"""


@register(f"""
with {JOURNALS}, {_places("backup")}, {_places("log")},
b as (select id, count(*) as n from (select id from backup_t where stale union all select id from log_t where stale) group by id)
select 'backup' as journal, (select count(*) from backup) as entries, (select count(*) from backup_t) as touched, (select count(*) from backup_t where stale) as stale
union all select 'log', (select count(*) from log), (select count(*) from log_t), (select count(*) from log_t where stale)
union all select 'union', null, null, (select count(*) from b) union all select 'intersection', null, null, (select count(*) from b where n = 2)
""")
def fingerprint_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items two journals touched, how many fingerprints those edits changed, and both together."""
    lines = load(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), F.split("text", "\n", -1).alias("l"))
    items = lines.select("id", F.get("l", F.lit(0)).alias("title"), F.coalesce(F.get("l", F.lit(1)), F.lit("")).alias("statement"))
    tail = F.when(F.size("l") > 2, F.slice("l", F.lit(3), F.greatest(F.size("l") - 2, F.lit(1))))
    parts = lines.select("id", F.posexplode(tail).alias("at", "value")).select("id", (F.col("at") + 1).alias("part"), "value")
    k = F.col("id")

    def entries(rows: DataFrame, seq: int, field: str, old, every: int, part=None) -> DataFrame:
        return rows.where(k % every == 0).select(F.lit(seq).alias("seq"), "id", F.lit(field).alias("field"), (F.lit(0) if part is None else part).cast("int").alias("part"), old.alias("old"))

    was = F.when((k % 30 == 0) & (F.col("part") == 1), F.concat("value", F.lit("  "))).when((k % 42 == 0) & (F.col("part") == 2), F.lit("other")).otherwise(F.col("value"))
    backup = (
        entries(items, 0, "title", F.when(k % 12 == 0, F.translate("title", "abcdef", "ABCDEF")).otherwise(F.col("title")), 6)
        .unionByName(entries(items, 0, "statement", F.when(k % 18 == 0, F.concat("statement", F.lit(" before"))).otherwise(F.col("statement")), 6))
        .unionByName(entries(parts, 0, "part", was, 6, F.col("part")))
        .unionByName(entries(items, 0, "part", F.lit("gone"), 6, F.lit(1_000_000)))
    )
    log = (
        entries(items, 1, "statement", F.lit("at first"), 10)
        .unionByName(entries(items, 2, "statement", F.when(k % 20 == 0, F.col("statement")).otherwise(F.lit("then")), 10))
        .unionByName(entries(items, 3, "solution", F.lit("outside"), 15))
        .unionByName(entries(items, 4, "title", F.lit("A title"), 35))
    )
    return staleness.audit(staleness.slots(items, parts), {"backup": backup, "log": log})
