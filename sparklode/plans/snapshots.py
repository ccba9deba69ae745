"""Snapshot diffs and merges, other formats, scoring, and streams that end in the same result as their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.functions import scoring
from sparklode.functions import text as T
from sparklode.operators import relational, snapshot
from sparklode.plans.registry import Registry
from sparklode.sources import formats, load
from sparklode.sources.scratch import Scratch
from sparklode.streaming import counters as streams

register = Registry()

NEW_SQL = "select p_partkey, case when p_partkey % 10 = 3 then p_brand || '*' else p_brand end as p_brand, case when p_partkey % 14 = 3 then null else p_size end as p_size from part where p_partkey % 9 <> 1 union all select p_partkey + 1000000, p_brand, p_size from part where p_partkey % 50 = 0"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = load(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    brand = F.when(F.col("p_partkey") % 10 == 3, F.concat("p_brand", F.lit("*"))).otherwise(F.col("p_brand"))
    size = F.when(F.col("p_partkey") % 14 != 3, F.col("p_size"))
    kept = old.where("p_partkey % 9 <> 1").select("p_partkey", brand.alias("p_brand"), size.alias("p_size"))
    added = old.where("p_partkey % 50 = 0").select((F.col("p_partkey") + 1000000).alias("p_partkey"), "p_brand", "p_size")
    return old, kept.unionByName(added)


@register(f"""
with n as ({NEW_SQL}), h as (select distinct l_partkey from lineitem where l_quantity = 50)
select coalesce(o.p_partkey, n.p_partkey) as p_partkey, case when o.p_partkey is null then 'create' when n.p_partkey is null and o.p_partkey in (select l_partkey from h) then 'kept' when n.p_partkey is null then 'delete'
 when o.p_brand is distinct from n.p_brand or o.p_size is distinct from n.p_size then 'update' else 'same' end as action,
 case when o.p_partkey is not null and n.p_partkey is not null then concat_ws(',', case when o.p_brand is distinct from n.p_brand then 'p_brand' end, case when o.p_size is distinct from n.p_size then 'p_size' end) else '' end as changed
from part o full join n on o.p_partkey = n.p_partkey
""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns the old version into the new one; parts that line items still name are kept."""
    old, new = _versions(spark, sf_dir)
    held = load(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return snapshot.diff(old, new, "p_partkey", ["p_brand", "p_size"], held)


@register(f"with n as ({NEW_SQL}) select p_partkey, p_brand, coalesce(p_size, -1) as p_size from n")
def snapshot_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applying the plan gives the new version."""
    old, new = _versions(spark, sf_dir)
    now = snapshot.applied(old, new, snapshot.diff(old, new, "p_partkey", ["p_brand", "p_size"]), "p_partkey")
    return now.withColumn("p_size", F.coalesce("p_size", F.lit(-1)))


@register(f"""
with n as ({NEW_SQL}), w as (select o.p_partkey, o.p_brand as before, n.p_brand as written, case when o.p_partkey % 20 = 3 then 'edited' else n.p_brand end as now from part o join n using (p_partkey))
select p_partkey, case when now is not distinct from written then before else now end as value, now is distinct from written as conflict from w
""")
def snapshot_revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old values come back, but not over an edit made since."""
    old, new = _versions(spark, sf_dir)
    now = new.withColumn("p_brand", F.when(F.col("p_partkey") % 20 == 3, "edited").otherwise(F.col("p_brand")))
    return snapshot.reverted(now, old, new, "p_partkey", "p_brand")


@register("""
select o_custkey as k, arg_max(o_totalprice, o_orderkey) as price, max(o_orderkey) as pos from orders group by 1
""")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderkey").toDF("k", "price", "pos")
    return snapshot.last_wins(rows, "k", "pos")


@register("""
with cur as (select c_custkey as k, c_name as inn, c_mktsegment as seg, c_custkey % 11 <> 0 as is_active from customer where c_custkey % 10 <> 0),
inc as (select case when c_custkey % 17 = 5 then c_custkey + 500000 else c_custkey end as k, c_name as inn, case when c_custkey % 13 = 2 then 'NEW' else c_mktsegment end as seg from customer where c_custkey % 7 <> 3),
gone as (select * from cur where k not in (select k from inc)), unk as (select * from inc where k not in (select k from cur)),
mv as (select g.k as old_key, u.k as new_key from (select inn, min(k) as k from gone group by 1 having count(*) = 1) g join (select inn, min(k) as k from unk group by 1 having count(*) = 1) u using (inn)),
re as (select coalesce(mv.new_key, cur.k) as k, inn, seg, is_active from cur left join mv on cur.k = mv.old_key)
select coalesce(re.k, inc.k) as k, case when inc.k is not null then inc.inn else re.inn end as inn, case when inc.k is not null then inc.seg else re.seg end as seg, inc.k is not null as is_active,
 case when re.k is null then 'added' when inc.k is null and re.is_active then 'deactivated' when inc.k is null then 'inactive' when re.inn is distinct from inc.inn or re.seg is distinct from inc.seg or not re.is_active then 'changed' else 'same' end as change
from re full join inc on re.k = inc.k
""")
def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert with re-keying and deactivation."""
    rows = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").toDF("k", "inn", "seg")
    current = rows.where("k % 10 <> 0").withColumn("is_active", F.col("k") % 11 != 0)
    incoming = rows.where("k % 7 <> 3").withColumn("seg", F.when(F.col("k") % 13 == 2, "NEW").otherwise(F.col("seg")))
    incoming = incoming.withColumn("k", F.when(F.col("k") % 17 == 5, F.col("k") + 500000).otherwise(F.col("k")))
    return snapshot.registry_merge(current, incoming, "k", ["inn"], ["inn", "seg"], 0.5)


@register("""
select doc_id, coalesce(nullif(case when doc_id % 3 = 0 then upper(lang) when doc_id % 3 = 1 then '' end, ''), nullif(case when doc_id % 2 = 0 then 'second' end, ''), lang) as lang from documents
""")
def precedence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = load(spark, sf_dir, "documents", "doc_id", "lang")
    first = base.where("doc_id % 3 < 2").withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).otherwise(""))
    second = base.where("doc_id % 2 = 0").withColumn("lang", F.lit("second"))
    return snapshot.by_precedence(base, [first, second], "doc_id", ["lang"])


@register("""
with s as (select source as name, count(*) as n from documents group by 1) select name, n, case when name in ('src0', 'src1', 'src2') then 'core' when name like 'src1%' then 'tens' end as target from s
""")
def taxonomy_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the mapping table, then by rule; what neither knows stays null and is reported."""
    rows = load(spark, sf_dir, "documents", "source").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    mapping = spark.createDataFrame([("src0", "core"), ("src1", "core"), ("src2", "core")], "name string, target string")
    return snapshot.remapped(rows, "name", mapping, F.when(F.col("name").startswith("src1"), "tens"))


@register("""
select 'orders' as "table", count(*) as rows from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)
union all select 'events', count(*) from events where user_id in (select c_custkey from customer where c_nationkey = 3)
""")
def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey").where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    orders = load(spark, sf_dir, "orders", "o_custkey").withColumnRenamed("o_custkey", "user_id")
    return snapshot.cascade("user_id", users, {"orders": orders, "events": load(spark, sf_dir, "events", "user_id")})


@register("select sha256('salt' || c_custkey) as c_custkey, '' as c_name, c_mktsegment from customer")
def anonymised_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.anonymised(load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment"), ["c_name"], ["c_custkey"], "salt")


@register("""
select doc_id // 500 as chunk_no, count(*) as rows, sha256(string_agg(sha256(concat_ws('|', doc_id, lang, sha256(text))), '' order by doc_id)) as digest from documents group by 1
""")
def package_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 500 ids with digests that depend on the rows' order."""
    rows = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return snapshot.manifest(rows, "doc_id", 500, F.concat_ws("|", "doc_id", "lang", F.sha2("text", 256)))


@register("select doc_id, row_number() over (order by (doc_id * 7919) % 1009, doc_id) as position from (select distinct doc_id from documents)")
def json_lines_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents queued as JSON lines in a mixed order, a fifth of them again at the end, and read back as ids without repeats and with
    their places."""
    scratch = Scratch(spark, "queue")
    rows = load(spark, sf_dir, "documents", "doc_id", "lang").orderBy((F.col("doc_id") * 7919) % 1009, "doc_id")
    rows.unionByName(rows.where("doc_id % 5 = 0")).write.json(scratch.path("lines"))
    return formats.first_of_each(formats.read_json_lines(spark, scratch.path("lines"), "doc_id long, lang string"), "doc_id")


@register("select doc_id, case when regexp_matches(t, '^[=+@\\t\\r-]') then '''' || t else t end as cell from (select doc_id, case when doc_id % 2 = 0 then '=' || lang else lang end as t from documents)")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV report written with its formula guard and read again."""
    scratch = Scratch(spark, "csv")
    rows = load(spark, sf_dir, "documents", "doc_id", "lang")
    cells = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("="), F.col("lang"))).otherwise(F.col("lang")).alias("cell"))
    formats.write_csv(cells, scratch.path("report"), ["doc_id", "cell"])
    return formats.read_csv(spark, scratch.path("report"), "doc_id long, cell string")


@register("select s_suppkey, s_name, s_nationkey from supplier")
def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "xml")
    rows = load(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    rows.write.format("xml").option("rowTag", "org").option("rootTag", "orgs").save(scratch.path("orgs"))
    return formats.read_xml(spark, scratch.path("orgs"), "org", "s_suppkey long, s_name string, s_nationkey int")


@register("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where event_id % 7 <> 6")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in fences, with talk around it or its end cut off, is still read."""
    raw = load(spark, sf_dir, "events", "event_id", "props")
    k = F.col("event_id") % 7
    spoiled = (
        F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done")))
        .when(k == 2, F.concat(F.regexp_replace("props", "}$", ""), F.lit(', "more": [1, 2')))
        .when(k == 6, F.lit("nothing here"))
        .otherwise(F.col("props"))
    )
    read = raw.select("event_id", F.from_json(formats.repair_json(spoiled), "k bigint")["k"].alias("k"))
    return read.where("k is not null")


@register("select event_id, round(case when event_type = 'view' then 0 when r + w = 0 then 0 when kind = 'multi' then greatest(r - w, 0) / 4.0 * 3 when kind = 'match' then r / 4.0 * 3 when r = 4 and w = 0 then 3 else -1 end, 2)::double as points from (select event_id, event_type, event_id % 5 as r, (event_id // 5) % 3 as w, case event_id % 3 when 0 then 'multi' when 1 then 'match' else 'single' end as kind from events) where event_type <> 'view'")
def decimal_half_up_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exam items with partial credit, to two decimals half up."""
    rows = load(spark, sf_dir, "events", "event_id", "event_type").where("event_type <> 'view'")
    r, w = F.col("event_id") % 5, F.floor(F.col("event_id") / 5) % 3
    kind = F.when(F.col("event_id") % 3 == 0, "multi").when(F.col("event_id") % 3 == 1, "match").otherwise("single")
    return rows.select("event_id", scoring.exam_points(kind, r, w, F.lit(4), F.lit(3), F.lit(1)).cast("double").alias("points"))


@register("""
select event_id, floor((10 + floor(greatest(least(1 - value / 100, 1), 0) * 50 + 0.5)) * case when event_id % 13 >= 10 then 2.0 when event_id % 13 >= 5 then 1.5 when event_id % 13 >= 3 then 1.2 else 1.0 end + 0.5)::bigint as points from events
""")
def question_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base points, a bonus for speed and a multiplier for the streak, rounded half up."""
    rows = load(spark, sf_dir, "events", "event_id", "value")
    return rows.select("event_id", scoring.question_points(F.lit(10), F.col("value"), F.lit(100.0), F.col("event_id") % 13).alias("points"))


@register("""
select user_id, case when ok >= 20 and ok / n::double >= 0.8 and hard >= 3 then 'master' when ok >= 10 and ok / n::double >= 0.6 then 'confident' when ok >= 3 then 'learning' when n > 0 then 'started' else 'new' end as mastery
from (select user_id, count(*) filter (where event_type <> 'error') as ok, count(*) as n, count(*) filter (where value > 100) as hard from events group by 1)
""")
def mastery_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events", "user_id", "event_type", "value").groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "error").alias("ok"), F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("hard")
    )
    return rows.select("user_id", scoring.mastery(F.col("ok"), F.col("n"), F.col("hard")).alias("mastery"))


#: A right answer and one given, in all notations, from each part's size, price and name.
ANSWERS = """
case p_partkey % 9 when 0 then p_size || ',5' when 1 then '−' || p_size when 2 then '' || p_size when 3 then p_name when 4 then p_size || '/0' when 5 then p_name when 6 then '' || cast(p_size as double)
  when 7 then ' ' || p_size || '/4 ' else '' end as correct,
case p_partkey % 9 when 0 then (2 * p_size + 1) || '/2' when 1 then '-' || (p_size + p_partkey % 2) || '.0' when 2 then '' || (p_size + (p_partkey % 4) * 0.25) when 3 then '  ' || upper(p_name) || ' ' when 4 then p_size || '/0'
  when 5 then '' || p_size when 6 then '+' || p_size || '.00' when 7 then replace('' || (p_size / 4.0), '.', ',') else 'x' end as given
"""


def _parsed_sql(text: str) -> str:
    flat = f"translate(trim(translate({text}, '{T.DASHES}', '{'-' * len(T.DASHES)}')), ', ', '.')"
    top, below = f"split_part({flat}, '/', 1)", f"split_part({flat}, '/', 2)"
    return f"""case when regexp_matches({flat}, '^[+-]?[0-9]+([.][0-9]+)?$') then {flat}::double
 when regexp_matches({flat}, '^-?[0-9]+/[0-9]+$') and try_cast({below} as double) <> 0 then {top}::double / {below}::double end"""


@register(rf"""
with a as (select p_partkey, {ANSWERS} from part), p as (select *, {_parsed_sql("correct")} as x, {_parsed_sql("given")} as y from a)
select p_partkey, round(x, 9) as parsed, coalesce(case when x is not null and y is not null then abs(x - y) <= 0.5 * (p_partkey % 9 = 2)::int + 1e-12 end,
  trim(regexp_replace(lower(correct), '[ \t\n\r\f\v]+', ' ', 'g')) = trim(regexp_replace(lower(given), '[ \t\n\r\f\v]+', ' ', 'g'))) as ok from p
""")
def open_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open answers: numbers in any notation within a tolerance, else equal texts."""
    rows = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").selectExpr("p_partkey", *[f"{x} as {name}" for x, name in _answer_parts()])
    tolerance = F.when(F.col("p_partkey") % 9 == 2, 0.5).otherwise(0.0)
    return rows.select("p_partkey", F.round(T.parsed_number(F.col("correct")), 9).alias("parsed"), T.open_answer_right(F.col("correct"), F.col("given"), tolerance).alias("ok"))


def _answer_parts() -> list[tuple[str, str]]:
    """The two expressions of ANSWERS with their names; both engines read them alike."""
    first, second = ANSWERS.strip().rsplit(" as given", 1)[0].split(" as correct,")
    return [(first, "correct"), (second, "given")]


@register("""
with l as (select l_partkey as item, year(l_shipdate) as y, case when l_linenumber % 3 = 0 then '' else l_returnflag end as stage from lineitem where l_orderkey % 2 = 0), r as (select l_partkey as item, year(l_shipdate) as y, l_returnflag as stage from lineitem where l_orderkey % 2 = 1),
a as (select item from l where not exists (select 1 from r where r.item = l.item and r.y = l.y and (r.stage = l.stage or r.stage = '' or l.stage = ''))), b as (select item from r where not exists (select 1 from l where r.item = l.item and r.y = l.y and (r.stage = l.stage or r.stage = '' or l.stage = '')))
select distinct item from (select item from a union select item from b) where item in (select item from l) and item in (select item from r)
""")
def wildcard_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose keys on both sides do not agree, an empty stage agreeing with any."""
    rows = load(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate", "l_returnflag", "l_linenumber", "l_orderkey")
    stage = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag"))
    side = lambda k, s: rows.where(F.col("l_orderkey") % 2 == k).select(F.col("l_partkey").alias("item"), F.year("l_shipdate").alias("y"), s.alias("stage"))
    return relational.wildcard_conflicts(side(0, stage), side(1, F.col("l_returnflag")), "item", ["y"], "stage")


def _stream(spark: SparkSession, sf_dir: str, build, mode: str) -> DataFrame:
    """The stream's result after all input, read from the files of its sink in the shared folder."""
    scratch = Scratch(spark, "stream")
    stream = build(streams.event_stream(spark, f"{sf_dir}/events.parquet", watermark="60 days"))
    sink = streams.latest_result if mode == "complete" else streams.append_log
    sink(stream, scratch.path("result"), scratch.path("checkpoint"))
    if mode == "complete":
        return streams.latest(spark, scratch.path("result"), stream.schema)
    return spark.read.schema(stream.schema).parquet(scratch.path("result"))


@register("""
select user_id % 10 as item, count(*) as shown, count(*) filter (where event_type = 'purchase') as correct, count(*) filter (where event_type = 'error') as wrong, sum(cast(round(value * 10) as bigint))::bigint as total_ms from events group by 1
""")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running counters of a stream, at its end."""
    return _stream(spark, sf_dir, streams.counters, "complete")


@register("select user_id, cast(date_trunc('hour', ts) as varchar) as hour, count(distinct cast(round(value) as bigint)) as items from events group by all")
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _stream(spark, sf_dir, streams.quota, "complete")
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "items")


@register("""
with s as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 24 hour then 0 else 1 end as new from events where event_type = 'error'),
i as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from s) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as since, count(*) as failures from i group by user_id, session
""")
def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows that each failure extends."""
    out = _stream(spark, sf_dir, streams.failures, "complete")
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("since"), "failures")


@register()
def stream_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful suppression of repeats; tested against the batch form."""
    return _stream(spark, sf_dir, lambda e: streams.without_repeats(e, 14400), "append").select("event_id", "stored")


FACTS = """
c as (select c_nationkey as place, c_mktsegment as kind, count(*) as n, round(max(c_acctbal), 2) as best from customer where c_custkey % 3 > 0 group by 1, 2),
i as (select c_nationkey as place, case when c_custkey % 7 = 0 then 'NEW' else c_mktsegment end as kind, count(*) as n, case when c_nationkey % 2 = 0 then round(max(c_acctbal), 2) end as best from customer where c_custkey % 4 = 0 and c_nationkey < 20 group by 1, 2, c_nationkey)
"""


@register(f"""
with {FACTS}
select coalesce(c.place, i.place) as place, coalesce(c.kind, i.kind) as kind, coalesce(i.n, c.n) as n, coalesce(i.best, c.best) as best,
  case when c.n is null then 'inserted' when i.n is null then 'kept' when c.n <> i.n or c.best is distinct from coalesce(i.best, c.best) then 'updated' else 'same' end as change
from c full join i on c.place = i.place and c.kind = i.kind
""")
def facts_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by place and kind after a later input of some of them; what the input leaves empty stays."""
    rows = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal").withColumnsRenamed({"c_nationkey": "place", "c_mktsegment": "kind"})
    best = F.round(F.max("c_acctbal"), 2)
    current = rows.where("c_custkey % 3 > 0").groupBy("place", "kind").agg(F.count("*").alias("n"), best.alias("best"))
    later = rows.where("c_custkey % 4 = 0 and place < 20").withColumn("kind", F.when(F.col("c_custkey") % 7 == 0, "NEW").otherwise(F.col("kind")))
    incoming = later.groupBy("place", "kind").agg(F.count("*").alias("n"), F.when(F.col("place") % 2 == 0, best).alias("best"))
    return snapshot.upsert(current, incoming, ["place", "kind"], ["n", "best"])


#: Nineteen blocks of an order's text, each with its budget; None is no budget. Both engines read the expressions alike.
BLOCKS: list[tuple[int | None, str]] = [
    (None, "concat('order ', o_orderkey)"), (None, "case when o_orderkey % 3 > 0 then o_orderstatus end"), (6, "o_orderpriority"), (4, "concat(year(o_orderdate), '')"), (None, "case when o_totalprice > 200000 then 'large' end"),
    (12, "c_name"), (5, "c_mktsegment"), (None, "case when c_acctbal < 0 then 'in debt' end"), (None, "n_name"), (3, "r_name"), (None, "case when n_lines > 4 then concat(n_lines, ' lines') end"), (None, "case when returned > 0 then 'returned' else '' end"),
    (8, "p_name"), (7, "p_brand"), (None, "case when p_size > 25 then concat('size ', p_size) end"), (10, "p_type"), (9, "s_name"), (None, "case when s_acctbal > 5000 then 'rich' end"), (None, "case when s_nationkey = c_nationkey then 'local' else null end"),
]
ORDER_SQL = """
l as (select l_orderkey, count(*) as n_lines, count(*) filter (where l_returnflag = 'R') as returned, min(l_partkey) as part, max(l_suppkey) as supp from lineitem group by 1),
o as (select * from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join l on l_orderkey = o_orderkey left join part on p_partkey = part left join supplier on s_suppkey = supp)
"""


@register(f"""
with {ORDER_SQL}
select o_orderkey, concat_ws(' ', {", ".join(f"nullif({e if b is None else f'left({e}, {b})'}, '')" for b, e in BLOCKS)}) as text from o
""")
def assembled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of nineteen optional blocks for every order, in their order and each within its budget."""
    lines = load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    lines = lines.agg(F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.min("l_partkey").alias("p_partkey"), F.max("l_suppkey").alias("s_suppkey"))
    table = lambda name: load(spark, sf_dir, name)
    joined = (
        table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(lines, "o_orderkey", "left").join(table("part"), "p_partkey", "left").join(table("supplier"), "s_suppkey", "left")
    )
    return joined.select("o_orderkey", T.within_budgets([(budget, F.expr(e)) for budget, e in BLOCKS]).alias("text"))
