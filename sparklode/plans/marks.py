"""Terms, labels, ranges, names, formulas and options read out of texts; results of sets, index texts and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.functions import marks
from sparklode.functions import text as T
from sparklode.operators import dedup, relational
from sparklode.plans.registry import Registry
from sparklode.sources import load

register = Registry()

STOP = ["the", "and", "of", "to", "in", "that"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


@register(f"""
with w as (select conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9À-ÿ]+') as w from conversations),
k as (select conv_id, turn, list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: lower(x) not in ({STOP_SQL}) and length(x) > 1) as w from w)
select conv_id, turn, array_to_string(list_transform(list_sort(list_transform(w, lambda x, i: {{'low': (x <> upper(x))::int, 'n': length(x), 'k': i, 'w': x}}))[1:6], lambda s: s.w), ' ') as terms from k
""")
def query_terms_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most six terms of each turn: abbreviations first, then by length."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.query_terms(F.col("text"), STOP), " ").alias("terms"))


LABELS = (
    "case p_partkey % 4 when 0 then substr(p_name, 1, 4) when 1 then upper(substr(p_name, 1, 1)) || ', ' || substr(p_name, 2, 1) "
    "when 2 then substr(p_name, 1, 1) || ';' || substr(p_type, 1, 1) else substr(p_name, 1, 1) || ') ' || substr(p_type, 2, 1) || ')' end"
)


@register(f"select p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower({LABELS}), '[a-z]'))), '') as labels from part")
def answer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in four notations as sorted sets."""
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(T.label_set(F.expr(LABELS)), "").alias("labels"))


@register("""
with m as (select distinct o_custkey, month(o_orderdate) as m from orders), g as (select *, m - row_number() over (partition by o_custkey order by m) as island from m),
r as (select o_custkey, min(m) as a, max(m) as b, count(*) as n from g group by o_custkey, island)
select o_custkey, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as months, sum(n)::bigint as n from r group by 1
""")
def month_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of each customer's orders written as ranges; `n` counts the months that the written form gives back."""
    rows = load(spark, sf_dir, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.collect_set(F.month("o_orderdate")).alias("m"))
    written = rows.select("o_custkey", T.grade_text(F.array_sort("m")).alias("months"))
    return written.select("o_custkey", "months", F.size(T.grade_numbers(F.col("months"))).cast("long").alias("n"))


NAMED = (
    "case p_partkey % 7 when 0 then 'школа №' || p_size || ', 12' when 1 then p_name || ' ' || p_size || '-летия' when 2 then p_name || ' ' || p_size when 3 then p_name || ' ' || p_size || '.5' "
    "when 4 then p_size || ' лет ' || p_name || ' 7' when 5 then '(' || p_size || ') й летний' else 'дом 12345 ' || p_size || ' й летний ' || p_partkey end"
)


@register(f"""
with n as (select p_partkey, string_split_regex(replace({NAMED}, '№', ' № '), '[\\s,;:()«»"]+') as w from part),
s as (select *, list_filter(range(1, len(w) + 1), lambda i: i > 1 and w[i - 1] = '№' and regexp_matches(w[i], '^[0-9]+$')) as signed,
  list_filter(range(1, len(w) + 1), lambda i: length(w[i]) <= 4 and regexp_matches(w[i], '^[0-9]+$') and not starts_with(coalesce(w[i + 1], ''), 'лет')
    and not (coalesce(w[i + 1], '') = 'й' and starts_with(coalesce(w[i + 2], ''), 'лет'))) as bare from n)
select p_partkey, try_cast(coalesce(w[signed[1]], w[bare[1]]) as int) as number from s
""")
def numbers_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that name something; anniversaries and decimals are none."""
    return load(spark, sf_dir, "part").select("p_partkey", marks.number_in_name(F.expr(NAMED)).alias("number"))


@register("""
select o_orderkey, case when o_orderkey % 7 <> 0 then (o_orderkey % 9 + 1) * 100 + (o_custkey % 8 + 2) * 10 + o_orderkey % 5 + 1 end as number from orders
""")
def numbers_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written numbers read back; those over 3000 are none."""
    units, tens = F.array(*map(F.lit, T.UNITS)), F.array(*map(F.lit, T.TENS))
    word = lambda words, k: F.element_at(words, k.cast("int"))
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    high, middle, low = word(units, F.col("o_orderkey") % 9 + 2), word(tens, F.col("o_custkey") % 8 + 1), word(units, F.col("o_orderkey") % 5 + 2)
    text = F.concat_ws(" ", F.lit("House"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("nine thousand")), high, F.lit("hundred"), middle, low, F.lit("left"))
    return rows.select("o_orderkey", T.number_words(text).cast("long").alias("number"))


@register("""
select l_orderkey, md5(string_agg(l_partkey || '|' || l_returnflag, ' ' order by l_linenumber, l_partkey, l_returnflag)) as fingerprint, count(*) as parts from lineitem group by 1
""")
def part_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each order's lines in their order, and how many there are; an order has few lines."""
    lines = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    line = F.struct("l_linenumber", "l_partkey", "l_returnflag", F.col("l_partkey").cast("string").alias("statement"), F.col("l_returnflag").alias("answer"))
    listed = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("parts"))
    return listed.select("l_orderkey", dedup.parts_key(F.col("parts")).alias("fingerprint"), F.size("parts").cast("long").alias("parts"))


@register("""
with f as (select l_partkey, string_agg(distinct l_returnflag, ' ' order by l_returnflag) as flags from lineitem group by 1)
select p_partkey, concat_ws(chr(10), p_name, p_type, case when p_size > 25 then p_brand end, flags) as body from part left join f on l_partkey = p_partkey
""")
def index_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index reads of each part: its own fields and those of its links, missing ones left out."""
    flags = load(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), " ").alias("flags"))
    rows = load(spark, sf_dir, "part").join(flags, F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.select("p_partkey", F.concat_ws("\n", "p_name", "p_type", F.when(F.col("p_size") > 25, F.col("p_brand")), "flags").alias("body"))


@register("""
with q as (select l_orderkey, l_linenumber, l_quantity, case when l_tax > 0 then l_discount end as percent from lineitem),
r as (select *, row_number() over (partition by l_orderkey order by percent nulls last, l_linenumber) as n from q)
select l_orderkey, round(avg(percent), 6) as accuracy, round(avg(l_quantity), 6) as score, max(case when n = 1 then l_linenumber end) as hardest from r group by 1
""")
def set_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each set, and its hardest question: the least percent, then the least number, unknown percents last."""
    percent = F.when(F.col("l_tax") > 0, F.col("l_discount"))
    rows = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").withColumn("percent", percent)
    hardest = F.min_by("l_linenumber", F.struct(F.col("percent").isNull(), "percent", "l_linenumber"))
    return rows.groupBy("l_orderkey").agg(F.round(F.avg("percent"), 6).alias("accuracy"), F.round(F.avg("l_quantity"), 6).alias("score"), hardest.alias("hardest"))


@register("""
select 'without orders' as side, c_custkey as id from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)
union all select 'unknown customer', o_orderkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0)
""")
def missing_on_either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    same = F.col("c_custkey") == F.col("o_custkey")
    return relational.missing_both_ways(
        customers, orders.where("o_totalprice > 250000"), customers.where("c_acctbal > 0"), orders, same, ("without orders", "c_custkey"), ("unknown customer", "o_orderkey")
    )


B = "chr(92)"
FORMULA = (
    f"case p_partkey % 6 when 0 then {B} || 'frac{{1}}{{' || p_size || '}}' when 1 then {B} || 'frac{{1}}{{' || p_size when 2 then '}}' || p_size || '{{' "
    f"when 3 then {B} || 'begin{{align}}x' || {B} || 'end{{align}}' when 4 then {B} || 'begin{{tikz}}x' || {B} || 'end{{tikz}}' else {B} || 'begin{{cases}}' || p_size || case p_partkey % 4 when 0 then {B} || 'cdot x' when 1 then {B} || 'colour{{x}}' else '' end end"
)


@register(f"""
with f as (select p_partkey, {FORMULA} as f from part), c as (select p_partkey, f, list_transform(string_split(f, ''), lambda x: case x when '{{' then 1 when '}}' then -1 else 0 end) as d from f)
select p_partkey, list_sum(d) <> 0 or list_min(list_transform(range(1, len(d) + 1), lambda k: list_sum(d[1:k]))) < 0 as braces, contains(f, 'begin{{tikz}}') as environment, contains(f, 'colour') as command,
len(regexp_extract_all(f, 'begin\\{{')) <> len(regexp_extract_all(f, 'end\\{{')) as unclosed from c
""")
def formula_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Braces that don't close, environments and commands that aren't known, and environments that aren't closed."""
    rows = load(spark, sf_dir, "part").select("p_partkey", F.expr(FORMULA).alias("f"))
    return rows.select("p_partkey", *[c.alias(n) for n, c in marks.formula_faults(F.col("f")).items()])


TAILS = (
    "case p_partkey % 7 when 0 then p_name || chr(10) || 'a) ' || p_size || chr(10) || 'b) none' || chr(10) when 1 then p_name || chr(10) || '1. one' || chr(10) || chr(10) || '2. two' || chr(10) || '3. three' "
    "when 2 then p_name || chr(10) || '1. one' || chr(10) || 'b) two' when 3 then p_name || chr(10) || '1. find it' || chr(10) || '2. two' when 4 then 'a) one' || chr(10) || 'b) two' "
    "when 5 then p_name || chr(10) || 'a) one' else p_name || chr(10) || '1. one' || chr(10) || '3. three' end"
)


@register("""
select p_partkey, (['parsed', 'parsed', 'mixed_style', 'verb_like_subquestion', 'empty_stem', 'no_block', 'mixed_style'])[p_partkey % 7 + 1] as reason,
case p_partkey % 7 when 0 then 2 when 1 then 3 else 0 end as options, case when p_partkey % 7 < 2 then p_name end as stem from part
""")
def options_in_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option lists at the end of statements, or why there is none."""
    rows = load(spark, sf_dir, "part").select("p_partkey", F.expr(TAILS).alias("t"))
    found = rows.select("p_partkey", marks.tail_options(F.col("t")).alias("o"))
    return found.select("p_partkey", "o.reason", F.size("o.options").alias("options"), "o.stem")


@register("""
with d as (select *, length(coalesce(text, '')) < 200 or contains(text, '#') as critical, coalesce(quality = 1, false) as spared, coalesce(toxic = 1, false) as flagged from documents left join labels using (doc_id))
select doc_id, case when critical and not spared then 'flag' else 'unflag' end as action from d where (coalesce(critical, false) and not spared) <> flagged
""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to flag for a critical defect and rows whose flag goes; spared rows are never flagged."""
    labels = load(spark, sf_dir, "labels")
    rows = load(spark, sf_dir, "documents", "doc_id", "text").join(labels, "doc_id", "left")
    critical = (F.length(F.coalesce("text", F.lit(""))) < 200) | F.contains("text", F.lit("#"))
    return relational.flag_changes(rows, critical, F.col("quality") == 1, F.col("toxic") == 1).select("doc_id", "action")


PLACED = (
    "case s_suppkey % 8 when 0 then 'г. ' || n_name || ', ул. Школьная, 18' when 1 then 'ул. Мира, 2, с. ' || n_name || ' ул. Новая, Тверская область, 171062' when 2 then 'REGION region, ' || n_name || ' CITY' "
    "when 3 then '12 Main street, ' || n_name || ', 99' when 4 then '171062, Тверская область, д. 5' when 5 then 'town of ' || lower(n_name) || ' street 5; x' when 6 then 'district of ' || n_name else null end"
)


@register(f"""
with s as (select s_suppkey, n_name, s_suppkey % 8 as k, row_number() over (partition by n_nationkey order by s_suppkey) as n from supplier join nation on s_nationkey = n_nationkey)
select s_suppkey, case when k in (0, 1, 2, 6) or (k = 3 and n_name in (select n_name from nation where n_nationkey % 2 = 0)) then left(n_name, 1) || lower(substr(n_name, 2)) when k = 5 then lower(n_name) end as city from s
""")
def address_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of addresses in eight notations; every second nation's name is a known city."""
    from sparklode.functions import address

    nations = load(spark, sf_dir, "nation", "n_nationkey", "n_name")
    known = [r["n_name"] for r in nations.where("n_nationkey % 2 = 0").select("n_name").orderBy("n_name").limit(1000).collect()]
    rows = load(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", address.city_of(F.expr(PLACED), F.array(*map(F.lit, known))).alias("city"))
