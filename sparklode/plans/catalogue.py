"""Facets, joins, reports and set operations over the catalogue-like tables (parts, orders, line items, customers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklode.operators import dedup, ranking, relational, reports
from sparklode.plans.registry import Registry
from sparklode.sources import load

register = Registry()


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def part_ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The many-to-many link of parts and return flags."""
    return load(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_linestatus")


def chosen(spark: SparkSession, sf_dir: str) -> relational.Facets:
    return relational.Facets(
        columns={"brand": ("p_brand", BRANDS), "size": ("p_size", [1, 5, 10, 15, 20, 25])},
        links={"flag": (part_ships(spark, sf_dir), "l_partkey", "l_returnflag", ["R"])},
    )


BRANDS = ["Brand#1", "Brand#2", "Brand#3", "Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#32"]
BRANDS_SQL = ", ".join(f"'{b}'" for b in BRANDS)
SIZE_SQL, FLAG_SQL = "p_size in (1, 5, 10, 15, 20, 25)", "p_partkey in (select l_partkey from lineitem where l_returnflag = 'R')"


@register(f"select p_partkey, p_brand from part where p_brand in ({BRANDS_SQL}) and {SIZE_SQL} and {FLAG_SQL}")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR inside a group, AND between groups."""
    return chosen(spark, sf_dir).apply(parts(spark, sf_dir), "p_partkey").select("p_partkey", "p_brand")


@register(f"""
select 'brand' as facet, p_brand as option, count(distinct p_partkey) as n from part where {SIZE_SQL} and {FLAG_SQL} group by all
union all select 'size', cast(p_size as varchar), count(distinct p_partkey) from part where p_brand in ({BRANDS_SQL}) and {FLAG_SQL} group by all
""")
def facet_drill_sideways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each facet is counted without its own filter."""
    facets, table = chosen(spark, sf_dir), parts(spark, sf_dir)
    brand = facets.counts(table, "p_partkey", "brand", "p_brand").withColumn("facet", F.lit("brand"))
    size = facets.counts(table, "p_partkey", "size", "p_size").withColumn("facet", F.lit("size"))
    return brand.unionByName(size.withColumn("option", F.col("option").cast("string"))).select("facet", "option", "n")


@register("select l_returnflag as option, count(distinct l_partkey) as n from lineitem join part on l_partkey = p_partkey where p_size <= 10 group by 1")
def facet_counts_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A facet over a link counts parts, not links."""
    small = parts(spark, sf_dir).where("p_size <= 10").select("p_partkey")
    link = part_ships(spark, sf_dir).join(small, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return relational.facet_counts(link, "l_partkey", "l_returnflag")


@register("""
with c as (select p_brand as option from part group by 1), f as (select p_brand as option, count(distinct p_partkey) as n from part where p_size = 7 and p_retailprice > 1500 group by 1)
select option, coalesce(n, 0) as n, coalesce(n, 0) = 0 as is_zero from c left join f using (option)
""")
def facet_zero_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = parts(spark, sf_dir)
    filtered = table.where("p_size = 7 and p_retailprice > 1500")
    return relational.options_with_zero(relational.facet_counts(table, "p_partkey", "p_brand"), relational.facet_counts(filtered, "p_partkey", "p_brand"))


@register("select l_partkey from lineitem where l_returnflag in ('A', 'N', 'R') group by 1 having count(distinct l_returnflag) = 3")
def tags_relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with every wanted flag."""
    return relational.having_all(part_ships(spark, sf_dir), "l_partkey", "l_returnflag", ["A", "N", "R"])


@register("select o_orderkey, o_orderpriority from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)")
def semi_join_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = load(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").where("l_quantity > 45")
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    return orders.join(heavy, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@register("select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_totalprice > 300000)")
def anti_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 300000")
    return load(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@register("select p_partkey, p_brand from part where not coalesce(p_brand in (select distinct p_brand from part where p_size = 50 and p_type = 'PROMO'), false)")
def not_in_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose brand has no promotion part of size 50; a missing brand counts as not listed."""
    table = parts(spark, sf_dir)
    listed = table.where("p_size = 50 and p_type = 'PROMO' and p_brand is not null").select("p_brand").distinct()
    return table.join(listed, "p_brand", "left_anti").select("p_partkey", "p_brand")


@register("""
with t as (select p_brand, count(*) as n, count(*) / (select count(*) from part)::double as share from part group by 1)
select p_brand, n, round(share, 9) as share from t where p_brand not in ('Brand#1', 'Brand#11', 'Brand#12') or share >= 0.045
""")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.visible_by_coverage(parts(spark, sf_dir), "p_brand", ["Brand#1", "Brand#11", "Brand#12"], 0.045)
    return rows.withColumn("share", F.round("share", 9))


@register("""
select p_partkey, p_name from part where contains(lower(p_name), 'widget') and contains(lower(p_type), 'o')
""")
def words_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive substrings, all of them needed."""
    return parts(spark, sf_dir).where(F.lower("p_name").contains("widget") & F.lower("p_type").contains("o")).select("p_partkey", "p_name")


@register("select c_custkey from customer where c_custkey = 5 or c_custkey between 50 and 59 or c_custkey between 500 and 599 or c_custkey between 5000 and 5999")
def number_prefix_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that begin with 5, as ranges that a scan can use."""
    return load(spark, sf_dir, "customer", "c_custkey").where(reports.number_prefix("c_custkey", 5, 4))


@register("select n_name, r_name, count(c_custkey) as customers from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by all")
def dimension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension's rows with their facts counted, rows without facts included; 25 nations are broadcast."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    counted = load(spark, sf_dir, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    named = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = named.join(counted, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@register("""
select o_orderkey, list(l_partkey order by l_linenumber, l_partkey)[1] as first_part, count(*) as lines, string_agg(l_partkey::varchar, '-' order by l_linenumber, l_partkey) as children
from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'P' group by 1
""")
def prefetch_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with their ordered children as an array."""
    lines = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    nested = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    open_orders = load(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'P'")
    joined = open_orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", F.col("c")[0]["l_partkey"].alias("first_part"), F.size("c").alias("lines"), F.array_join(F.col("c.l_partkey"), "-").alias("children"))


@register("""
select o_orderkey from orders a join (select o_orderkey, case when o_orderkey % 7 = 0 then upper(o_orderpriority) || '!' else o_orderpriority end as o_orderpriority,
 case when o_orderkey % 11 = 0 then null else o_orderstatus end as o_orderstatus from orders) b using (o_orderkey)
where coalesce(a.o_orderpriority, '') <> coalesce(b.o_orderpriority, '') or coalesce(a.o_orderstatus, '') <> coalesce(b.o_orderstatus, '')
""")
def null_safe_change_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    new = old.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.upper("o_orderpriority"), F.lit("!"))).otherwise(F.col("o_orderpriority")))
    new = new.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")))
    return relational.changed_rows(old, new, "o_orderkey", ["o_orderpriority", "o_orderstatus"])


@register("""
with a as (select distinct l_partkey, l_returnflag from lineitem where l_quantity <= 25), b as (select distinct l_partkey, l_returnflag from lineitem where l_quantity > 20)
(select *, 'a' as side from (select * from a except select * from b)) union all (select *, 'b' from (select * from b except select * from a))
""")
def snapshot_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_quantity")
    a, b = (rows.where(c).select("l_partkey", "l_returnflag").distinct() for c in ("l_quantity <= 25", "l_quantity > 20"))
    return relational.symmetric_difference(a, b)


@register("""
with q as (select p_partkey, case when p_size > 5 then p_size end as part_no, p_brand from part), s as (select case when p_size > 5 then p_size end as part_no, p_brand, count(*) as shown from part group by all)
select p_partkey, shown from q left join s on q.part_no is not distinct from s.part_no and q.p_brand = s.p_brand
""")
def null_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composite key whose second part may be null."""
    rows = parts(spark, sf_dir).select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size")).alias("part_no"), "p_brand")
    stats = rows.groupBy("part_no", "p_brand").agg(F.count("*").alias("shown"))
    return relational.null_safe_join(rows, stats, ["part_no", "p_brand"]).select("p_partkey", "shown")


@register("""
select o_orderpriority as grade, year(o_orderdate) as y, count(*) as n, round(avg(o_totalprice), 4) as mean_price from orders group by all
""")
def group_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate", "o_totalprice")
    return rows.groupBy(F.col("o_orderpriority").alias("grade"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


YEARS = (1994, 1995, 1996, 1997, 1998)
YEARS_SQL = ", ".join(f"count(*) filter (where year(o_orderdate) = {y}) as y{y}, count(*) filter (where year(o_orderdate) = {y}) > 0 as has{y}" for y in YEARS)


@register(f"select o_orderpriority as grade, {YEARS_SQL} from orders group by 1")
def pivot_score_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade by year over five years, with a flag for cells that have no rows."""
    rows = load(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate").select(F.col("o_orderpriority").alias("grade"), F.year("o_orderdate").alias("y"))
    return reports.pivot_counts(rows, "grade", "y", YEARS)


@register("""
select old || '->' || new as cell, count(*) as n from (
 select l_orderkey, min(l_returnflag) as old, max(l_linestatus) as new from lineitem group by 1) group by 1
""")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement cells of two labels of the same order."""
    rows = load(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus").groupBy("l_orderkey")
    both = rows.agg(F.min("l_returnflag").alias("old"), F.max("l_linestatus").alias("new"))
    return reports.crosstab(both, "old", "new")


@register("""
with c as (select p_type, p_brand, count(*) as n, sum(count(*)) over (partition by p_type) as total, row_number() over (partition by p_type order by count(*) desc, p_brand) as r from part group by p_type, p_brand)
select p_type, p_brand, n, round(100.0 * n / total, 6) as percent, r as rank_in_group from c where r <= 6
""")
def distribution_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = parts(spark, sf_dir).groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    counted = counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("p_type")), 6))
    return ranking.top_k_per_group(counted, ["p_type"], [F.desc("n"), F.asc("p_brand")], 6)


@register("""
select o_custkey, o_orderkey, o_totalprice, r as rank_in_group from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3
""")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return ranking.top_k_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@register("select o_orderkey, o_totalprice from orders order by (o_orderpriority = '1-URGENT') desc, o_totalprice desc, o_orderkey limit 20 offset 40")
def sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 20, hits of the flag first."""
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderpriority")
    urgent = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return relational.page(rows, [urgent.desc(), F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 20).select("o_orderkey", "o_totalprice")


@register()
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty customers that depend on ids and seed only."""
    return relational.seeded_sample(load(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_custkey", 42, 50)


@register("""
with ranked as (select p_partkey, p_brand, p_retailprice, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r from part)
select p_partkey, p_brand, stage from (
 select *, row_number() over (order by stage, p_retailprice desc, p_partkey) as n from (select *, least(r, 3) as stage from ranked)) where n <= 60
""")
def quota_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty parts, one per brand first, then a second, then the rest by price."""
    return reports.pick_with_quota(parts(spark, sf_dir), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 3, 60).select("p_partkey", "p_brand", "stage")


@register("""
with x as (select p_partkey, p_size, 0 as priority from part where p_size > 48 union all select p_partkey, p_size, 1 from part where p_size between 40 and 48)
select p_partkey, p_size, priority from x order by priority, p_size desc, p_partkey limit 120
""")
def confirmed_first_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = parts(spark, sf_dir).select("p_partkey", "p_size")
    return relational.fill_in_order(table.where("p_size > 48"), table.where("p_size between 40 and 48"), [F.desc("p_size"), F.asc("p_partkey")], 120)


@register("""
select n_nationkey, n_name, class, pop from (
 select n_nationkey, n_name, case when starts_with(lower(n_name), 'i') then 0 when regexp_matches(lower(n_name), '(^|[^a-z])i') then 1 else 2 end as class, (select count(*) from customer where c_nationkey = n_nationkey) as pop
 from nation where contains(lower(n_name), 'i')) order by class, pop desc, n_name limit 8
""")
def relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of the name, start of a word, middle; then size, then name."""
    pop = load(spark, sf_dir, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("pop"))
    named = load(spark, sf_dir, "nation", "n_nationkey", "n_name").where(F.lower("n_name").contains("i"))
    joined = named.join(pop, F.col("n_nationkey") == F.col("c_nationkey"), "left").withColumn("pop", F.coalesce("pop", F.lit(0)))
    rows = joined.withColumn("class", reports.match_class(F.lower("n_name"), "i"))
    return rows.orderBy("class", F.desc("pop"), "n_name").limit(8).select("n_nationkey", "n_name", "class", "pop")


@register("""
with k as (select distinct l_suppkey as s, l_shipdate::date as d from lineitem), x as (select s, d, d - (row_number() over (partition by s order by d))::integer as island from k)
select s, max(n) as longest from (select s, island, count(*) as n from x group by all) group by s
""")
def supplier_day_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = load(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate").select(F.col("l_suppkey").alias("s"), F.to_date("l_shipdate").alias("d"))
    return ranking.day_streaks(days, "s", "d").groupBy("s").agg(F.max("length").alias("longest"))


@register("""
select attribute, count(distinct v) as different, count(distinct v) > 1 as differs from (
 select 'size' as attribute, cast(p_size as varchar) as v from part where p_partkey in (1, 2, 3) union all select 'brand', p_brand from part where p_partkey in (1, 2, 3) union all select 'type', p_type from part where p_partkey in (1, 2, 3)) group by 1
""")
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per attribute, flagged where the compared items differ."""
    rows = parts(spark, sf_dir).where(F.col("p_partkey").isin(1, 2, 3))
    wide = rows.select("p_partkey", F.col("p_size").cast("string").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    long = wide.unpivot("p_partkey", ["size", "brand", "type"], "attribute", "v")
    return long.groupBy("attribute").agg(F.countDistinct("v").alias("different")).withColumn("differs", F.col("different") > 1)


@register("""
with d as (select case when o_orderkey % 50 <> 0 then o_orderdate end as t from orders),
k as (select case when t is null then 'undated' when year(t) - (month(t) < 9)::int between 1993 and 1997 then 'month' else 'outside' end as bucket, year(t) - (month(t) < 9)::int as year, month(t) as month from d),
c as (select bucket, case when bucket = 'month' then year else 0 end as year, case when bucket = 'month' then month else 0 end as month, count(*) as n from k group by 1, 2, 3),
g as (select 'month' as bucket, y.year, m.month from (select unnest(range(1993, 1998)) as year) y, (select unnest(range(1, 13)) as month) m union all select 'undated', 0, 0 union all select 'outside', 0, 0)
select bucket, year, month, coalesce(n, 0) as n from g left join c using (bucket, year, month)
""")
def month_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by month of five academic years, empty months included; those without a date (every fiftieth stands for them) or outside the years have a bucket of their own."""
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("t"))
    return reports.academic_months(rows, F.col("t"), 1993, 1997)


@register("""
with built as (select l_partkey, max(o_orderdate) as built from lineitem join orders on l_orderkey = o_orderkey group by 1), edited as (select l_partkey, max(l_shipdate) as edited from lineitem group by 1)
select l_partkey, edited > built as stale, date_diff('day', built, edited) as days from edited join built using (l_partkey)
""")
def as_of_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items last shipped after they were last ordered, each compared with its own date."""
    rows = load(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_shipdate")
    edited = rows.groupBy("l_partkey").agg(F.max("l_shipdate").alias("edited"))
    built = rows.join(load(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").groupBy("l_partkey").agg(F.max("o_orderdate").alias("built"))
    return edited.join(built, "l_partkey").select("l_partkey", (F.col("edited") > F.col("built")).alias("stale"), F.datediff("edited", "built").cast("long").alias("days"))


@register("""
select r_name, n_name, year(o_orderdate) as year, count(distinct o_orderkey) as orders, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as double) as revenue, min(o_totalprice) as cheapest, max(o_totalprice) as dearest
from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey
group by all
""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of customers from suppliers of their own nation, by year: six tables joined."""
    tables = {t: load(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem", "supplier")}
    joined = (
        tables["lineitem"]
        .join(tables["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(tables["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
        .join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )
    revenue = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double")
    return joined.groupBy("r_name", "n_name", F.year("o_orderdate").alias("year")).agg(
        F.count_distinct("o_orderkey").alias("orders"), revenue.alias("revenue"), F.min("o_totalprice").alias("cheapest"), F.max("o_totalprice").alias("dearest")
    )


@register("select l_returnflag as flag, l_linestatus as status, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity from lineitem group by all")
def nested_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by fields of the items of a JSON array in a column: each order's lines as one array, taken apart again."""
    line = F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("quantity"))
    lines = load(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity").groupBy("l_orderkey").agg(F.to_json(F.collect_list(line)).alias("lines"))
    items = lines.select(F.explode(F.from_json("lines", "array<struct<flag:string,status:string,quantity:double>>")).alias("x")).select("x.*")
    return items.groupBy("flag", "status").agg(F.count("*").alias("n"), F.sum(F.col("quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


@register("""
with m as (select p_partkey, p_brand as grp, (p_name <> '')::int + (p_size > 20)::int + (p_retailprice > 1000)::int + (p_size % 2)::int + (p_partkey % 3 = 0)::int + (length(p_name) > 12)::int as completeness, p_partkey % 29 = 0 as approved from part),
r as (select *, row_number() over (partition by grp order by completeness desc, p_partkey) as n, count(*) filter (where approved) over (partition by grp) as yes, min(p_partkey) filter (where approved) over (partition by grp) as ok,
  nth_value(completeness, 2) over (partition by grp order by completeness desc, p_partkey rows between unbounded preceding and unbounded following) as second from m)
select grp, case when yes = 1 then ok else p_partkey end as id, case when yes = 1 then 'approved' when second is null or completeness - second >= 2 then 'margin' else 'human' end as rule, completeness, second from r where n = 1
""")
def group_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part stands for its brand and size: the approved one, else the clearly most complete one, else a person is asked."""
    one = lambda c: c.cast("int")
    rows = parts(spark, sf_dir)
    filled = one(F.col("p_name") != "") + one(F.col("p_size") > 20) + one(F.col("p_retailprice") > 1000) + F.col("p_size") % 2 + one(F.col("p_partkey") % 3 == 0) + one(F.length("p_name") > 12)
    members = rows.select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), filled.alias("completeness"), (F.col("p_partkey") % 29 == 0).alias("approved"))
    return dedup.chosen(members)


@register("""
with a as (select p_partkey as anchor, case when p_partkey % 4 <> 0 then p_size % 3 end as year, case when p_partkey % 3 <> 0 then left(p_brand, 7) end as stage from part), m as (select distinct l_orderkey as candidate, l_partkey as anchor from lineitem),
c as (select x.candidate from m x join m y on x.candidate = y.candidate and x.anchor < y.anchor join a p on p.anchor = x.anchor join a q on q.anchor = y.anchor where p.year <> q.year or p.stage <> q.stage)
select candidate, anchor from m where candidate not in (select candidate from c)
""")
def matches_without_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose parts agree on size class and brand, a missing one agreeing with any, with all pairs of their parts."""
    matches = load(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("candidate"), F.col("l_partkey").alias("anchor")).distinct()
    rows = parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") % 3).alias("year"), F.when(F.col("p_partkey") % 3 != 0, F.substring("p_brand", 1, 7)).alias("stage"))
    return dedup.without_conflicts(matches, rows, ["year", "stage"])


@register("""
with s as (select o_custkey, count(*) as n, avg(o_totalprice) as m from orders group by 1)
select o_custkey, n, case when m = (select null) then null else round(m, 4) end as mean_price, n >= 10 as regular from s where n > 1
""")
def having_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey")
    rows = rows.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price")).where("n > 1")
    return rows.withColumn("regular", F.col("n") >= 10)


@register("""
with d as (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) as n from orders)
select o_orderkey, n as place from d
""")
def global_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places over a whole table without one task that sees all rows."""
    rows = load(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return ranking.places(rows, [F.asc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "place")


@register("""
select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) as sum_qty, round(sum(l_extendedprice), 1) as sum_base_price,
 round(avg(l_discount), 9) as avg_disc, count(*) as count_order, min(l_quantity) as least_qty, max(l_extendedprice) as top_price from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by all
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    rows = rows.where(F.col("l_shipdate") <= "1998-09-02").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 1).alias("sum_base_price"),
        F.round(F.avg("l_discount"), 9).alias("avg_disc"),
        F.count("*").alias("count_order"),
        F.min("l_quantity").alias("least_qty"),
        F.max("l_extendedprice").alias("top_price"),
    )
