"""Visibility, roles, quotas, classifications and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.functions import checks, scoring
from sparklode.functions import text as T
from sparklode.operators import ranking, rules
from sparklode.plans.registry import Registry
from sparklode.plans.texts import TOKENS
from sparklode.sources import load

register = Registry()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, null where there are none."""
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")


SHOWN = "n_chars is not null and source is not null and coalesce(toxic, 0) <> 1 and length(text) >= 50"


@register(f"""
with d as (select * from documents left join labels using (doc_id))
select 'catalog' as gate, doc_id from d where {SHOWN} and coalesce(quality, 1) = 1 union all select 'review', doc_id from d where {SHOWN}
""")
def visible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published, not flagged, long enough; the catalogue's gate also hides low quality."""
    rows = _documents(spark, sf_dir)
    marks = (F.col("source").isNotNull() & F.col("n_chars").isNotNull(), F.col("toxic") == 1, F.length("text") >= 50, F.col("quality") == 0)
    both = [rules.visible(rows, gate, *marks).select(F.lit(gate).alias("gate"), "doc_id") for gate in ("catalog", "review")]
    return both[0].unionByName(both[1])


@register("""
with d as (select * from documents left join labels using (doc_id))
select 'strict' as mode, count(*) as n from d where quality is not null union all select 'lenient', count(*) from d union all select 'inactive', count(*) from d
""")
def reviewed_when_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a review are hidden only when the filter is on and strict."""
    rows, out = _documents(spark, sf_dir), None
    for mode, strict, active in (("strict", True, True), ("lenient", False, True), ("inactive", True, False)):
        part = rules.reviewed_only(rows, strict, active, F.col("quality").isNotNull()).agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = part if out is None else out.unionByName(part)
    return out


VIEWERS = (("guest", 0, -1), ("student", 7, -1), ("tutor", 7, 3), ("superuser", 0, -1), ("stranger", 7, 3))


@register(
    "with o as (select o_orderkey, o_custkey, o_orderstatus, c_nationkey from orders join customer on o_custkey = c_custkey) "
    + " union all ".join(
        f"select '{role}' as role, o_orderkey from o where "
        + {"guest": "o_orderstatus = 'F'", "student": f"o_orderstatus = 'F' or o_custkey = {me}", "tutor": f"o_orderstatus = 'F' or o_custkey = {me} or c_nationkey = {group}", "superuser": "true"}.get(role, "false")
        for role, me, group in VIEWERS
    )
)
def rows_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that a guest, a student, a tutor and a superuser may see."""
    owners = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    rows, out = load(spark, sf_dir, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")), None
    for role, me, group in VIEWERS:
        sees = rules.seen_by_role(role, F.col("o_orderstatus") == "F", F.col("o_custkey") == me, F.col("c_nationkey") == group)
        part = rows.where(sees).select(F.lit(role).alias("role"), "o_orderkey")
        out = part if out is None else out.unionByName(part)
    return out


@register(f"""
select doc_id, array_to_string(list_filter(list_filter(w, lambda x: x in ('the', 'de', 'la', 'key', 'of')), lambda x, i: list_position(list_filter(w, lambda y: y in ('the', 'de', 'la', 'key', 'of')), x) = i), ',') as known
from (select doc_id, {TOKENS} as w from documents)
""")
def known_values_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and unknown values go, the others keep their order."""
    words = load(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.array_join(checks.known_values(F.col("w"), ["the", "de", "la", "key", "of"]), ",").alias("known"))


@register("""
with r as (select * from events where ts >= (select max(ts) from events) - interval 7 day)
select user_id, event_type, max(value) as best, count(*) as n from r group by all
""")
def board_last_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's best value of the last seven days; the newest event is now."""
    events = load(spark, sf_dir, "events", "ts", "user_id", "event_type", "value")
    now = events.agg(F.max("ts").alias("now"))
    recent = events.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("interval 7 days"))
    return recent.groupBy("user_id", "event_type").agg(F.max("value").alias("best"), F.count("*").alias("n"))


@register("select p_partkey, q.term from part, (values ('RED'), ('Ring'), ('wid')) q(term) where contains(lower(p_name), lower(q.term))")
def any_case_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a term in whatever case it is written."""
    part = load(spark, sf_dir, "part", "p_partkey", "p_name")
    terms = F.array(*[F.when(F.contains(F.lower("p_name"), F.lit(t.lower())), t) for t in ("RED", "Ring", "wid")])
    return part.select("p_partkey", F.explode(F.array_compact(terms)).alias("term"))


@register("""
with k as (select doc_id, n_chars % 8 as given, case doc_id % 3 when 0 then 'open' when 1 then 'choice' else 'number' end as kind, length(text) as n from documents),
b as (select *, case kind when 'open' then 3 when 'choice' then 2 else 1 end + case when n > 2000 then 2 when n > 500 then 1 else 0 end as guess from k)
select doc_id, case when given between 1 and 5 then given else least(guess, 5) end as difficulty from b
""")
def derived_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "open").when(F.col("doc_id") % 3 == 1, "choice").otherwise("number")
    rows = load(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    return rows.select("doc_id", checks.derived_difficulty(F.col("n_chars") % 8, kind, F.length("text")).alias("difficulty"))


@register("select user_id, case when event_type in ('view', 'click') then 'browse' when event_type in ('purchase', 'signup') then 'act' else 'other' end as kind, count(*) as n from events group by all")
def counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of raw values rolled up to coarser kinds."""
    kind = F.when(F.col("event_type").isin("view", "click"), "browse").when(F.col("event_type").isin("purchase", "signup"), "act").otherwise("other")
    return load(spark, sf_dir, "events", "user_id", "event_type").groupBy("user_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@register("""
select doc_id, (coalesce(length(text), 0) >= 200)::int + (lang is not null)::int + (source is not null)::int + (quality is not null)::int + coalesce(quality = 1, false)::int + coalesce(contains(text, chr(10)), false)::int as score
from documents left join labels using (doc_id)
""")
def completeness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six signs of a complete row, one point each."""
    signs = [F.length("text") >= 200, F.col("lang").isNotNull(), F.col("source").isNotNull(), F.col("quality").isNotNull(), F.col("quality") == 1, F.contains("text", F.lit("\n"))]
    total = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signs), F.lit(0))
    return _documents(spark, sf_dir).select("doc_id", total.alias("score"))


@register(f"""
with s as (select conv_id, turn, list_distinct({TOKENS}) as w from conversations),
p as (select a.conv_id, a.turn, len(list_intersect(a.w, b.w)) / sqrt(len(a.w)::double * len(b.w)) as c from s a join s b on a.conv_id = b.conv_id and a.turn <> b.turn where len(a.w) > 0 and len(b.w) > 0),
r as (select conv_id, turn, median(c) as m from p group by all) select conv_id, round(median(m), 6) as similarity from r group by conv_id
""")
def median_turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation the median over its turns of a turn's median set cosine with the others."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"))).alias("w")).where(F.size("w") > 0)
    other = turns.select("conv_id", F.col("turn").alias("turn_"), F.col("w").alias("w_"))
    pairs = turns.join(other, "conv_id").where("turn <> turn_")
    cosine = F.size(F.array_intersect("w", "w_")) / F.sqrt(F.size("w").cast("double") * F.size("w_"))
    rows = pairs.groupBy("conv_id", "turn").agg(F.median(cosine).alias("m"))
    return rows.groupBy("conv_id").agg(F.round(F.median("m"), 6).alias("similarity"))


@register("""
with t as (select p_brand, unnest(string_split(p_name, ' ')) as topic from part), c as (select p_brand, topic, count(*) as n from t where topic not in ('large') group by all),
r as (select *, row_number() over (partition by p_brand order by n desc, topic) as place from c) select p_brand, topic, n, place from r where place <= 3
""")
def top_topics_per_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent words of each brand's names, without those that are no topic; ties by name."""
    words = load(spark, sf_dir, "part", "p_brand", "p_name").select("p_brand", F.explode_outer(F.split("p_name", " ")).alias("topic")).where("topic <> 'large'")
    counts = words.groupBy("p_brand", "topic").agg(F.count("*").alias("n"))
    return ranking.top_k_per_group(counts, ["p_brand"], [F.desc("n"), F.asc("topic")], 3).withColumnRenamed("rank_in_group", "place")


@register("""
with g as (select l_orderkey, list_distinct(list(l_returnflag)) as given from lineitem group by 1), r as (select *, case when l_orderkey % 2 = 0 then ['A', 'R'] else ['N'] end as wanted from g)
select l_orderkey, list_sort(given) = wanted as equal, len(list_intersect(given, wanted)) as hit, len(list_filter(wanted, lambda x: not list_contains(given, x))) as missed, len(list_filter(given, lambda x: not list_contains(wanted, x))) as wrong from r
""")
def answer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-or-nothing and partial marks of a set of answers."""
    given = load(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("given"))
    wanted = F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("A"), F.lit("R"))).otherwise(F.array(F.lit("N")))
    rows = given.withColumn("wanted", wanted)
    return rows.select("l_orderkey", *[c.alias(n) for n, c in checks.set_marks(F.col("given"), F.col("wanted")).items()])


@register(f"""
select doc_id, md5(translate(text, '{T.DASHES}', '-------')) as dashes, md5(translate(lower(trim(text)), 'ё{T.LATIN}', 'е{T.CYRILLIC}')) as label from documents
""")
def folded_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashes made one, and look-alike letters."""
    text = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.plain_dashes(text)).alias("dashes"), F.md5(T.label_form(text)).alias("label"))


@register("""
select p_partkey, case when p_size % 10 = 1 and p_size % 100 <> 11 then 'one' when p_size % 10 between 2 and 4 and p_size % 100 not between 12 and 14 then 'few' else 'many' end as word, least(greatest(p_retailprice - 950, 0), 100)::double as clamped from part
""")
def plural_and_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    word, clamped = T.plural(F.col("p_size"), "one", "few", "many"), scoring.clamp(F.col("p_retailprice") - 950)
    return load(spark, sf_dir, "part").select("p_partkey", word.alias("word"), clamped.cast("double").alias("clamped"))


WRITTEN = "case p_partkey % 7 when 0 then p_size || ',5' when 1 then '-' || p_size when 2 then p_size || ' cm' when 3 then p_size || ' 000' when 4 then p_size || '.5' when 5 then p_size || ',1234' else p_size || ';' end"


@register(f"""
with w as (select p_partkey, {WRITTEN} as t from part)
select p_partkey, case when regexp_matches(t, '^[0-9]+(,[0-9]{{1,2}})?$') then 'ok' when t like '-%' then 'minus' when regexp_matches(t, '[a-z]') then 'units' when contains(t, ' ') then 'space' when contains(t, '.') then 'dot'
 when regexp_matches(t, '^[0-9]+,[0-9]{{3,}}$') then 'decimals' else 'other' end as fault, regexp_replace(replace(t, '.', ','), '[^0-9,]', '', 'g') as repaired from w
""")
def number_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a number is not in the strict form, and what a soft repair makes of it."""
    rows = load(spark, sf_dir, "part").select("p_partkey", F.expr(WRITTEN).alias("t"))
    return rows.select("p_partkey", checks.number_fault(F.col("t")).alias("fault"), checks.soft_number(F.col("t")).alias("repaired"))


@register("""
with f as (select user_id, count(*) as events, count(*) filter (where event_type = 'error') as errors, max(value) as best from events group by 1), c(name, kind, value) as (values ('many', 'events', 50), ('faults', 'errors', 10), ('high', 'best', 90), ('odd', 'unknown', 0))
select user_id, name, coalesce(case kind when 'events' then events when 'errors' then errors when 'best' then best end >= value, false) as met from f, c
""")
def conditions_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's facts against four conditions, one of them of an unknown kind."""
    facts = load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").cast("double").alias("events"), F.count_if(F.col("event_type") == "error").cast("double").alias("errors"), F.max("value").alias("best")
    )
    known = F.create_map(F.lit("events"), F.col("events"), F.lit("errors"), F.col("errors"), F.lit("best"), F.col("best"))
    wanted = [("many", "events", 50), ("faults", "errors", 10), ("high", "best", 90), ("odd", "unknown", 0)]
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(v).alias("value")) for n, k, v in wanted])
    rows = facts.select("user_id", known.alias("facts"), F.explode(listed).alias("c"))
    return rows.select("user_id", "c.name", rules.condition_met(F.col("c.kind"), F.col("c.value"), F.col("facts")).alias("met"))


@register(r"""
with t as (select doc_id, trim(string_split(text, chr(10))[1]) as t, text as s from documents where text is not null)
select doc_id, case when regexp_matches(t, '(,|\b(of|in|for|the|de|la|le|el))$') then 'trailing' when regexp_matches(t, '[$\\]') then 'latex' when length(t) < 3 or not regexp_matches(t, '[A-Za-zÀ-ÿ]') then 'junk'
 when length(t) >= 40 and starts_with(s, t) and length(s) > length(t) then 'truncated' end as fault from t
""")
def title_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four marks of a bad title, the first line standing for it."""
    rows = load(spark, sf_dir, "documents").where("text is not null")
    title = F.split("text", "\n", -1)[0]
    return rows.select("doc_id", title.alias("title"), "text").select("doc_id", checks.title_fault(F.col("title"), F.col("text")).alias("fault"))


@register("""
with d as (select *, length(coalesce(text, '')) < 120 as junk from documents left join labels using (doc_id)), r as (select distinct l_orderkey as doc_id from lineitem where l_quantity = 50)
select doc_id, case when not junk then 'keep' when toxic is null and not exists (select 1 from r where r.doc_id = d.doc_id) and not coalesce(contains(text, ':'), false) then 'delete'
 when exists (select 1 from r where r.doc_id = d.doc_id) or coalesce(contains(text, ':'), false) then 'fragment with parent' else 'fragment' end as verdict from d
""")
def junk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts without answer, references or signs of a parent go; others are fragments, with or without a parent."""
    refs = load(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").where("l_quantity = 50").select(F.col("l_orderkey").alias("doc_id")).distinct().withColumn("told", F.lit(True))
    rows = _documents(spark, sf_dir).join(refs, "doc_id", "left")
    junk, parent = F.length(F.coalesce("text", F.lit(""))) < 120, F.coalesce("told", F.contains("text", F.lit(":")), F.lit(False))
    verdict = F.when(~junk, "keep").when(F.col("toxic").isNull() & ~parent, "delete").when(parent, "fragment with parent").otherwise("fragment")
    return rows.select("doc_id", verdict.alias("verdict"))


@register("""
with p as (select doc_id % 20 as query_id, doc_id, source, text from documents where doc_id % 3 = 0), s as (select p.*, quality from p left join labels using (doc_id))
select query_id, count(*) as size, count(*) filter (where quality = 0) as not_visible, count(*) - count(distinct source) as repeats_of_group, count(*) > 150 as too_many from s group by 1
""")
def pool_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool's size, its rows that may not be seen, its rows beyond one a group, and whether it is over its cap."""
    pool = _documents(spark, sf_dir).where("doc_id % 3 = 0").withColumn("query_id", F.col("doc_id") % 20)
    counts = pool.groupBy("query_id").agg(F.count("*").alias("size"), F.count_if(F.col("quality") == 0).alias("not_visible"), F.count_distinct("source").alias("groups"))
    return counts.select("query_id", "size", "not_visible", (F.col("size") - F.col("groups")).alias("repeats_of_group"), (F.col("size") > 150).alias("too_many"))


@register(f"select item_id, case when len({TOKENS}) <= 4 then 'short' else 'long' end as kind from benchmark union all select conv_id * 1000 + turn, case when len({TOKENS}) <= 4 then 'short' else 'long' end from conversations")
def query_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of at most four words are short."""
    kind = F.when(F.size(T.tokens(F.col("text"))) <= 4, "short").otherwise("long").alias("kind")
    said = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), kind)
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), kind).unionByName(said)


@register("""
with k as (select o_orderkey, o_custkey, lower(o_orderpriority) as key, year(o_orderdate) as y from orders), r as (select *, row_number() over (partition by o_custkey, key order by y desc, o_orderkey) as n, count(*) over (partition by o_custkey, key) as size from k)
select o_custkey, key, o_orderkey as winner, size from r where n = 1
""")
def pool_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows of one normalised key the newest year's stays, then the smallest id's; no window, so a hot key is combined where it is read."""
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    best = F.max_by("o_orderkey", F.struct(F.year("o_orderdate"), -F.col("o_orderkey"))).alias("winner")
    return rows.groupBy("o_custkey", F.lower("o_orderpriority").alias("key")).agg(best, F.count("*").alias("size"))


@register("""
with recursive s as (select p_partkey as id, p_brand || '-' || p_partkey % 40 as k, case when p_partkey % 3 <> 0 then p_size % 4 end as a, case when p_partkey % 5 <> 0 then p_type end as b from part),
e as (select x.id as x, y.id as y from s x join s y on x.k = y.k and (x.a = y.a or x.a is null or y.a is null) and (x.b = y.b or x.b is null or y.b is null)),
reach(id, root) as (select id, id from s union select e.y, r.root from reach r join e on r.id = e.x)
select id, min(root) as root from reach group by id
""")
def wildcard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key that agree where neither has a null, merged; independent of their order."""
    rows = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws("-", "p_brand", (F.col("p_partkey") % 40).cast("string")).alias("k"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") % 4).alias("a"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("b"),
    )
    return rules.wildcard_groups(rows, "k", "a", "b", "id")


@register("""
with e as (select event_id, user_id, user_id % 10 as place, cast(ts as date) as day, ts from events),
c as (select *, row_number() over (partition by user_id, day order by ts, event_id) - 1 as mine, row_number() over (partition by place, day order by ts, event_id) - 1 as theirs from e)
select event_id, mine, theirs, mine >= 3 or theirs >= 20 as refused from c
""")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counters a day, of the account and of the place it comes from; a row is refused once either was reached."""
    events = load(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumn("day", F.to_date("ts")).withColumn("place", F.col("user_id") % 10)
    order = [F.asc("ts"), F.asc("event_id")]
    # An account's day is small; a place's day may be most of the rows, so its counter goes by range.
    placed = ranking.places(events.withColumnRenamed("place", "of"), order, ["of", "day"]).withColumn("theirs", F.col("place") - 1)
    counted = placed.withColumn("mine", rules.counter_before(F.lit(True), "user_id", "day", order=order))
    return counted.select("event_id", "mine", "theirs", ((F.col("mine") >= 3) | (F.col("theirs") >= 20)).alias("refused"))


@register("""
with s as (select cast(ts as date) as set_day, cast(ts + to_minutes(cast(floor(value) as bigint)) as date) as saved_day, value from events where value is not null)
select cast(set_day as varchar) as set_day, count(*) as runs, count(*) filter (where saved_day > set_day) as saved_later, max(value) as best from s group by 1
""")
def runs_by_set_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run belongs to the day it was set, also when it is saved after midnight."""
    saved = F.timestamp_add("MINUTE", F.floor("value").cast("int"), F.col("ts"))
    rows = load(spark, sf_dir, "events", "ts", "value").where("value is not null").select(F.to_date("ts").cast("string").alias("set_day"), F.to_date(saved).cast("string").alias("saved_day"), "value")
    return rows.groupBy("set_day").agg(F.count("*").alias("runs"), F.count_if(F.col("saved_day") > F.col("set_day")).alias("saved_later"), F.max("value").alias("best"))
