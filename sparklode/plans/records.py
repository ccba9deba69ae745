"""Loads and their dry runs, kept tables, records in other formats, exam items, experience and goals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklode.functions import dates, scoring
from sparklode.operators import ranking, snapshot
from sparklode.plans.registry import Registry
from sparklode.plans.snapshots import NEW_SQL, _versions
from sparklode.sources import formats, load
from sparklode.sources.kept import data_fingerprint, kept
from sparklode.sources.scratch import Scratch

register = Registry()


@register(f"""
with n as ({NEW_SQL}), j as (select o.p_partkey, o.p_brand as ob, n.p_brand as nb, o.p_size::varchar as os, n.p_size::varchar as ns from part o join n using (p_partkey))
select p_partkey, 'p_brand' as field, ob as old, nb as new from j where ob is distinct from nb union all select p_partkey, 'p_size', os, ns from j where os is distinct from ns
""")
def changed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every changed field with its old and new value."""
    return snapshot.changed_values(*_versions(spark, sf_dir), "p_partkey", ["p_brand", "p_size"])


@register(f"""
with n as ({NEW_SQL}), d as (select coalesce(o.p_partkey, n.p_partkey) as k, case when o.p_partkey is null then 'create' when n.p_partkey is null then 'delete' when o.p_brand is distinct from n.p_brand or o.p_size is distinct from n.p_size then 'update' else 'same' end as action
 from part o full join n on o.p_partkey = n.p_partkey)
select 'dry run' as run, action, count(*) as n from d group by action union all select 'again', 'same', count(*) from n
union all select 'with attempts', 'refused', count(*) from d
""")
def load_with_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load's plan before it is done, after it is done, and where line items name rows that would go."""
    old, new = _versions(spark, sf_dir)
    columns = ["p_brand", "p_size"]
    used = load(spark, sf_dir, "lineitem", "l_partkey").select(F.col("l_partkey").alias("p_partkey"))
    free = used.where("false")
    plan = snapshot.load_plan(old, new, "p_partkey", columns, free)
    now = Scratch(spark, "load").keep(snapshot.applied(old, new, plan, "p_partkey"), "version")
    runs = {"dry run": plan, "again": snapshot.load_plan(now, new, "p_partkey", columns, free), "with attempts": snapshot.load_plan(old, new, "p_partkey", columns, used)}
    one, two, three = [p.groupBy("action").agg(F.count("*").alias("n")).select(F.lit(name).alias("run"), "action", "n") for name, p in runs.items()]
    return one.unionByName(two).unionByName(three)


@register(f"""
with n as ({NEW_SQL}) select coalesce(o.p_brand, n.p_brand) as p_brand, coalesce(o.n, 0) as before, coalesce(n.n, 0) as after
from (select p_brand, count(*) as n from part group by 1) o full join (select p_brand, count(*) as n from n group by 1) n on o.p_brand = n.p_brand
""")
def two_versions_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older version and the present one, both read-only tables, counted in one query."""
    old, new = _versions(spark, sf_dir)
    count = lambda df, name: df.groupBy("p_brand").agg(F.count("*").alias(name))
    both = count(old, "before").join(count(new, "after"), "p_brand", "full")
    return both.select("p_brand", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


@register("""
with t as (select p_partkey, unnest(list_distinct(string_split(p_name, ' '))) as term from part) select term, count(*) as df, true as built_first, false as built_again, true as built_after_change from t group by 1
""")
def kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies, built once for a fingerprint of the data, read again while it holds, and built anew after a change."""
    parts = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    root = Scratch(spark, "kept").root

    def index(rows: DataFrame) -> tuple[DataFrame, bool]:
        terms = rows.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("term"))
        return kept(spark, "terms", 1, data_fingerprint(rows, "p_partkey", "p_size"), lambda: terms.groupBy("term").agg(F.count("*").alias("df")), root, ["term"])

    first, built = index(parts)
    (_, again), (_, changed) = index(parts), index(parts.where("p_partkey > 1"))
    return first.select("term", "df", F.lit(built).alias("built_first"), F.lit(again).alias("built_again"), F.lit(changed).alias("built_after_change"))


@register("select s_suppkey, s_name, s_nationkey from supplier")
def json_portions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table dumped as JSON lines in portions and read back."""
    path = Scratch(spark, "portions").path("dump")
    formats.write_json_portions(load(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey"), path, 5)
    return formats.read_json_lines(spark, path, "s_suppkey bigint, s_name string, s_nationkey int")


KEYED = "'# part' || chr(10) || 'key: ' || p_partkey || chr(10) || 'name: ' || p_name || case when p_partkey % 3 = 0 then chr(10) || 'name: again' else '' end || case when p_partkey % 4 = 0 then chr(10) || 'no colon here' else '' end || chr(10)"


@register("""
select p_partkey, p_name as name, array_to_string(list_filter([case when p_partkey % 3 = 0 then 'line 4: name again' end,
 case when p_partkey % 4 = 0 then 'line ' || (case when p_partkey % 3 = 0 then 5 else 4 end) || ': no key' end], lambda x: x is not null), '; ') as errors from part
""")
def key_value_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of keys and values with all errors of each, not the first alone."""
    parsed = formats.key_values(load(spark, sf_dir, "part", "p_partkey", "p_name").select(F.expr(KEYED).alias("text")))
    return parsed.select(F.col("fields")["key"].cast("long").alias("p_partkey"), F.col("fields")["name"].alias("name"), F.array_join("errors", "; ").alias("errors"))


@register("""
with d as (select p_partkey, p_size % 5 + 1 as old, case when p_partkey % 8 <> 1 then (p_partkey % 5 + 1)::int end as new, p_brand in ('Brand#11', 'Brand#22') as flat from part where p_partkey % 6 <> 2)
select case when new is null then 'none' when flat then 'overwrite' else 'keep' end as what, case when new is not null then old || '->' || new else '' end as cell, count(*) as n from d group by all
""")
def overwrite_or_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new difficulty of the rows that have an old one; overwritten where the native label is one of the flat ones, else kept."""
    rows = load(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").where("p_partkey % 6 <> 2")
    new = F.when(F.col("p_partkey") % 8 != 1, F.col("p_partkey") % 5 + 1)
    what = F.when(new.isNull(), "none").when(F.col("p_brand").isin("Brand#11", "Brand#22"), "overwrite").otherwise("keep")
    cell = F.coalesce(F.concat((F.col("p_size") % 5 + 1).cast("string"), F.lit("->"), new.cast("string")), F.lit(""))
    return rows.groupBy(what.alias("what"), cell.alias("cell")).agg(F.count("*").alias("n"))


@register("""
with w as (select user_id, cast(date_trunc('week', cast(ts + interval 3 hour as timestamp)) as date) as week, count(*) as n from events where event_type <> 'error' group by all),
t as (select max(week) as now from w), g as (select user_id, (now - week)::int / 7 as back from w, t where n >= 2 and week < now),
r as (select user_id, back, row_number() over (partition by user_id order by back) as k from g where back <= 52)
select user_id, count(*) filter (where back = k) as weeks from r group by user_id
""")
def goal_weeks_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks in a row, from the last full one back and at most 52, in which the goal of two was met."""
    rows = load(spark, sf_dir, "events", "user_id", "ts", "event_type").where("event_type <> 'error'")
    weeks = rows.groupBy("user_id", dates.week_start("ts").alias("week")).agg(F.count("*").alias("n"))
    now = F.lit(weeks.agg(F.max("week")).first()[0])
    met = weeks.where((F.col("n") >= 2) & (F.col("week") < now)).select("user_id", (F.datediff(now, "week") / 7).cast("int").alias("back")).where("back <= 52")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("back"))
    return met.withColumn("k", place).groupBy("user_id").agg(F.count_if(F.col("back") == F.col("k")).alias("weeks"))


@register("""
with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as age, avg(value) over (partition by user_id) as mean_all from events)
select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as position, round(mean_all, 6) as mean_all from r where age <= 20
""")
def run_history_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 runs of each user, numbered from the oldest of them, with the mean of all."""
    last = ranking.latest_n(load(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20)
    position = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return last.select("user_id", "event_id", position.alias("position"), F.round("mean_all", 6).alias("mean_all"))


@register("""
with k as (select event_id, event_type, (case event_type when 'purchase' then 50 when 'signup' then 30 when 'click' then 10 when 'view' then 5 else 0 end)::int as base,
 row_number() over (partition by user_id, cast(ts + interval 3 hour as date), event_type = 'view' order by ts, event_id) - 1 as earlier from events)
select event_id, round_even(base * case when event_type <> 'view' or earlier < 5 then 1.0 when earlier < 15 then 0.5 else 0.1 end * case when event_id % 4 = 0 then 1.5 else 1.0 end, 0)::bigint as xp from k
""")
def experience_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experience of each event: easy ones count less through the day, exams half as much again, halves to even."""
    rows = load(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").withColumn("easy", F.col("event_type") == "view")
    earlier = F.row_number().over(W.partitionBy("user_id", dates.local_day("ts"), "easy").orderBy("ts", "event_id")) - 1
    ranked = rows.withColumn("earlier", earlier)
    decay = F.when(F.col("easy"), scoring.easy_decay(F.col("earlier"))).otherwise(1.0)
    exam = F.when(F.col("event_id") % 4 == 0, 1.5).otherwise(1.0)
    return ranked.select("event_id", F.bround(scoring.xp_by_type(F.col("event_type")) * decay * exam).cast("long").alias("xp"))


@register("""
with r as (select user_id, count(*) filter (where event_type in ('purchase', 'click')) as good, count(*) filter (where event_type = 'error') as bad from events group by 1)
select user_id, round(case when good + bad = 0 then 1 else 0.3 + 0.7 * greatest(0, least(1, (good / (good + bad)::double - 0.5) / 0.35)) end, 9)::double as multiplier, greatest(0, least(floor(30 * case when good % 3 = 0 then 0.2 when good % 3 = 1 then 0.5 else 1.0 end + 0.5), greatest(0, 600 - 100 * bad)))::bigint as seconds from r
""")
def run_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run's accuracy makes of its points, and the seconds that its next right answer adds."""
    rows = load(spark, sf_dir, "events", "user_id", "event_type")
    runs = rows.groupBy("user_id").agg(F.count_if(F.col("event_type").isin("purchase", "click")).alias("good"), F.count_if(F.col("event_type") == "error").alias("bad"))
    scale = F.element_at(F.array(F.lit(0.2), F.lit(0.5), F.lit(1.0)), (F.col("good") % 3 + 1).cast("int"))
    seconds = scoring.time_bonus(F.lit(30), scale, F.lit(600), 100 * F.col("bad"))
    return runs.select("user_id", F.round(scoring.accuracy_multiplier(F.col("good"), F.col("bad")), 9).alias("multiplier"), seconds.cast("long").alias("seconds"))


ITEMS = {
    "kind": "case p_partkey % 5 when 0 then 'short_text' when 1 then 'single' when 2 then 'multi' when 3 then 'match' else 'number' end",
    "given": "case p_size % 4 when 0 then '' when 1 then ' ' || upper(p_brand) || ' ' when 2 then '7' else 'other' end",
}
MARKED = "case when p_size % 11 = 0 then array() else filter(sequence(1, 6), x -> shiftright(p_size, x - 1) % 2 = 1) end"


@register(f"""
with i as (select p_partkey, p_size, p_brand, {ITEMS['kind']} as kind, {ITEMS['given']} as given, case when p_size % 11 = 0 then [] else list_filter([1, 2, 3, 4, 5, 6], lambda x: (p_size >> (x - 1)) % 2 = 1) end as marked, p_partkey % 2 = 0 as penalised from part),
c as (select *, len(list_filter(marked, lambda x: x in (1, 3, 4))) as good, len(list_filter(marked, lambda x: x in (2, 5))) as bad,
  (p_size % 3 = 1)::int + (p_size % 5 = 2)::int + (p_size % 7 = 3)::int as pairs from i),
s as (select *, case kind when 'short_text' then trim(given) = '' when 'number' then trim(given) = '' when 'match' then false else len(marked) = 0 end as blank,
  case kind when 'short_text' then lower(trim(given)) = lower(p_brand) when 'single' then len(marked) = 1 and good = 1 when 'multi' then good = 3 and (bad = 0 or not penalised) when 'match' then pairs = 3 else given = '7' end as full_marks from c)
select p_partkey, case when blank then 0 when kind in ('short_text', 'single') then case when full_marks then 250 else -50 end when kind = 'number' then case when full_marks then 250 else 0 end
 when kind = 'match' then floor(250 * pairs / 3.0 + 0.5) when penalised then floor(250 * greatest(good * 2 - bad * 3, 0) / 6.0 + 0.5) else floor(250 * good / 3.0 + 0.5) end::bigint as cents, case when not blank then full_marks end as is_correct from s
""")
def exam_item_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in hundredths and verdict of all five kinds of exam items."""
    rows = load(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").withColumns({n: F.expr(e) for n, e in ITEMS.items()}).withColumn("marked", F.expr(MARKED))
    correct = F.when(F.col("kind") == "number", F.array(F.lit(7))).otherwise(F.array(*map(F.lit, (1, 3, 4))))
    answers, truth = F.array(*[F.col("p_size") % m for m in (3, 5, 7)]), F.array(*map(F.lit, (1, 2, 3)))
    got = scoring.item_result(
        F.col("kind"), F.col("given"), F.array("p_brand"), F.col("marked"), correct, F.array(*map(F.lit, range(1, 6))), answers, truth, F.lit(250), F.lit(50), F.col("p_partkey") % 2 == 0
    )
    return rows.select("p_partkey", got.alias("x")).select("p_partkey", "x.*")


NESTED = (
    "'id: ' || o_orderkey || chr(10) || 'buyer:' || chr(10) || '  key: ' || o_custkey || chr(10) || '  note: \"a: b\"' || chr(10) || 'price: ' || round(o_totalprice, 2) || chr(10) || 'tags:' || chr(10) || '  - ' || o_orderstatus || chr(10) || '  - ' || o_orderpriority "
    "|| case when o_orderkey % 5 = 0 then chr(10) || '    deep: x' else '' end || case when o_orderkey % 7 = 0 then chr(10) || 'id: 3' else '' end || case when o_orderkey % 11 = 0 then chr(10) || chr(9) || 'x: y' else '' end"
)


@register("""
select o_orderkey, o_custkey as buyer, 'a: b' as note, o_orderpriority as second_tag,
 array_to_string(list_filter([case when o_orderkey % 5 = 0 then 'line 9: below a value' end, case when o_orderkey % 7 = 0 then 'line ' || (9 + (o_orderkey % 5 = 0)::int) || ': id again' end,
  case when o_orderkey % 11 = 0 then 'line ' || (9 + (o_orderkey % 5 = 0)::int + (o_orderkey % 7 = 0)::int) || ': tab' end], lambda x: x is not null), '; ') as errors from orders
""")
def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with nested keys, lists and quoted values, all errors of each told."""
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    parsed = formats.key_values(rows.select(F.expr(NESTED).alias("text")))
    of = lambda path: F.col("fields")[path]
    return parsed.select(of("id").cast("long").alias("o_orderkey"), of("buyer.key").cast("long").alias("buyer"), of("buyer.note").alias("note"), of("tags[1]").alias("second_tag"), F.array_join("errors", "; ").alias("errors"))
