"""Boards, streaks, cohorts, funnels and counters over the events table: value is the score, event_type the mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.functions import dates, scoring
from sparklode.operators import cohort, ranking, relational
from sparklode.plans.registry import Registry
from sparklode.sources import load
from sparklode.sources.scratch import Scratch

register = Registry()

MOSCOW_DAY = "cast(ts + interval 3 hour as date)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")


def best_first() -> list:
    return [F.desc("value"), F.asc("ts"), F.asc("event_id")]


@register("""
select user_id, event_id, value, row_number() over (order by value desc, ts, event_id) as place
from (select *, row_number() over (partition by user_id order by value desc, ts, event_id) as n from events where event_type = 'purchase') where n = 1
""")
def board_best_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's best ranked run (not the sum of runs) and its place."""
    ranked = events(spark, sf_dir).where("event_type = 'purchase'")
    best = ranking.best_per_key(ranked, "user_id", best_first())
    return ranking.places(best, best_first()).select("user_id", "event_id", "value", "place")


@register("""
with best as (select *, row_number() over (partition by user_id order by value desc, ts, event_id) as n from events where event_type = 'purchase'),
placed as (select user_id, value, row_number() over (order by value desc, ts, event_id) as place from best where n = 1)
select user_id, value, place, place > 10 as outside_top from placed where place <= 10 or user_id = 7
""")
def board_place_outside_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top ten and user 7's own row."""
    best = ranking.best_per_key(events(spark, sf_dir).where("event_type = 'purchase'"), "user_id", best_first())
    placed = ranking.places(best, best_first())
    return ranking.board_with_me(placed, 10, F.col("user_id") == 7).select("user_id", "value", "place", "outside_top")


@register("""
select user_id, event_type, value, place from (
  select user_id, event_type, value, row_number() over (partition by event_type order by case when event_type = 'error' then value else -value end, ts, event_id) as place
  from events where ts >= timestamp '2024-01-23 00:00:00' and ts < timestamp '2024-01-30 00:00:00') where place <= 20
""")
def board_direction_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven days' boards by mode; for `error` smaller is better."""
    week = events(spark, sf_dir).where(dates.half_open("ts", "2024-01-23", "2024-01-30"))
    sort = F.when(F.col("event_type") == "error", F.col("value")).otherwise(-F.col("value"))
    top = ranking.top_k_per_group(week, ["event_type"], [sort.asc(), F.asc("ts"), F.asc("event_id")], 20)
    return top.select("user_id", "event_type", "value", F.col("rank_in_group").alias("place"))


@register("""
with best as (select user_id, max(value) as value from events where event_type = 'purchase' group by user_id),
levels as (select value, lag(value) over (order by value desc) as up from (select distinct value from best))
select user_id, value, round(up - value, 6) as gap from best join levels using (value)
""")
def gap_to_next_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each user's best lacks to the next better best."""
    best = events(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return ranking.gap_to_better(best, "value", ["event_type"]).select("user_id", "value", F.round("gap", 6).alias("gap"))


@register("""
select event_type, user_id, max(value) as best from events group by all
""")
def max_per_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.max("value").alias("best"))


@register("select event_type, count(distinct user_id) as players from events where ts >= timestamp '2024-01-15 00:00:00' group by event_type")
def players_per_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("ts") >= "2024-01-15").groupBy("event_type").agg(F.countDistinct("user_id").alias("players"))


@register("""
select event_id, user_id, max(case when event_type <> 'view' then value end) over (partition by user_id order by ts, event_id rows unbounded preceding) as record from events
""")
def running_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal record so far; views are shown but don't count."""
    rows = ranking.running_record(events(spark, sf_dir), "user_id", [F.asc("ts"), F.asc("event_id")], F.col("value"), F.col("event_type") != "view")
    return rows.select("event_id", "user_id", "record")


STREAKS_SQL = f"""
with days as (select distinct user_id, {MOSCOW_DAY} as day from events where event_type in ('purchase', 'signup')),
islands as (select user_id, day, day - (row_number() over (partition by user_id order by day))::integer as island from days)
select user_id, island, min(day) as first_day, max(day) as last_day, count(*) as length from islands group by user_id, island
"""


def activity_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = events(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup"))
    return solved.select("user_id", dates.local_day("ts").alias("day"))


@register(f"select user_id, cast(first_day as varchar) as first_day, cast(last_day as varchar) as last_day, length from ({STREAKS_SQL})")
def day_streak_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ranking.day_streaks(activity_days(spark, sf_dir), "user_id", "day")
    return runs.select("user_id", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "length")


@register(f"""
select user_id, max(length) as best, coalesce(max(case when last_day >= date '2024-01-29' then length end), 0) as current,
  sum(greatest(0, date_diff('day', greatest(first_day, date '2024-01-24'), least(last_day, date '2024-01-30')) + 1))::bigint as week
from ({STREAKS_SQL}) group by user_id
""")
def day_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and current streak of local days, and active days of the last seven, as of 2024-01-30."""
    return ranking.streak_summary(ranking.day_streaks(activity_days(spark, sf_dir), "user_id", "day"), "user_id", F.lit("2024-01-30").cast("date"))


@register()
def day_streaks_with_freezes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks that two freezes a month can bridge; a fold, so tested against a plain loop."""
    return ranking.streak_with_freezes(activity_days(spark, sf_dir), "user_id", "day", "2024-01-30")


@register("""
with marked as (select user_id, event_id, ts, (event_type = 'error')::int as fail,
  sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events)
select user_id, max(n) as longest_run from (select user_id, island, sum(1 - fail)::bigint as n from marked group by user_id, island) group by user_id
""")
def longest_correct_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.longest_run(events(spark, sf_dir), "user_id", [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error")


@register(f"""
select event_id, earlier, case when earlier < 5 then 1.0 when earlier < 15 then 0.5 else 0.1 end::double as factor from (
select event_id, event_type, coalesce(sum((event_type = 'view')::int) over (partition by user_id, {MOSCOW_DAY} order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as earlier
from events) where event_type = 'view'
""")
def easy_decay_in_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view with the number of views before it on that local day, and the factor it decays to."""
    rows = events(spark, sf_dir).withColumn("day", dates.local_day("ts"))
    counted = ranking.earlier_in_day(rows, "user_id", "day", [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "view")
    return counted.where("event_type = 'view'").select("event_id", "earlier", scoring.easy_decay(F.col("earlier")).alias("factor"))


@register("""
select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n = 1
""")
def first_event_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ranking.first_per(events(spark, sf_dir), [F.col("user_id"), F.col("event_type")], [F.asc("ts"), F.asc("event_id")])
    return first.select("event_id", "user_id", "event_type")


@register("""
with weeks as (select user_id, cast(date_trunc('week', cast(ts + interval 3 hour as timestamp)) as date) as week, count(*) as n from events where event_type = 'purchase' group by all),
good as (select user_id, week, week - 7 * (row_number() over (partition by user_id order by week))::integer as island from weeks where n >= 3)
select user_id, max(length) as weeks from (select user_id, island, count(*) as length from good group by all) group by user_id
""")
def week_goal_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of weeks with at least three purchases."""
    weeks = events(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id", dates.week_start("ts").alias("week")).agg(F.count("*").alias("n"))
    index = (F.datediff("week", F.lit("2020-01-06").cast("date")) / 7).cast("int")
    good = weeks.where("n >= 3").select("user_id", F.date_add(F.lit("2020-01-06").cast("date"), index).alias("day"))
    return ranking.day_streaks(good, "user_id", "day").groupBy("user_id").agg(F.max("length").alias("weeks"))


@register("""
select user_id, event_id, age, round(mean_all, 6) as mean_all from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as age, avg(value) over (partition by user_id) as mean_all from events) where age <= 20
""")
def run_history_last_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.latest_n(events(spark, sf_dir), "user_id", [F.desc("ts"), F.desc("event_id")], 20)
    return rows.select("user_id", "event_id", "age", F.round("mean_all", 6).alias("mean_all"))


@register("""
with t as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as previous, row_number() over (partition by user_id order by ts, event_id) as n from events)
select user_id, event_id, event_type, previous from t where n > 1 and event_type is distinct from previous
""")
def adjacent_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type differs from the one before."""
    rows = ranking.adjacent_breaks(events(spark, sf_dir), "user_id", [F.asc("ts"), F.asc("event_id")], "event_type", "event_type")
    return rows.select("user_id", "event_id", "event_type", "previous")


@register("""
with t as (select user_id, event_type, event_id, row_number() over (partition by user_id order by ts, event_id) as n,
  row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as island from events)
select user_id, event_type, min(n) as first, max(n) as last, count(*) as length from t group by user_id, event_type, island
""")
def run_length_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.asc("ts"), F.asc("event_id")]
    from pyspark.sql import Window as W

    numbered = events(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy(*order)))
    return ranking.run_lengths(numbered, ["user_id"], [F.asc("n")], "event_type", "n")


@register("""
with r as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events where value is not null),
a as (select event_type, value as p90 from r where k = greatest(1, least(round_even(90 / 100.0 * n, 0)::bigint, n))),
b as (select event_type, value as p50 from r where k = greatest(1, ceil(50 * n / 100.0)))
select event_type, p90, p50 from a join b using (event_type)
""")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both nearest-rank rules: rounded index (p90) and rank rounded up (p50)."""
    return cohort.ranked_values(events(spark, sf_dir), ["event_type"], "value", {"p90": cohort.round_rank(90), "p50": cohort.ceil_rank(50)})


@register("""
with first as (select * from (select *, row_number() over (partition by event_type, user_id order by ts, event_id) as n from events) where n = 1)
select event_type, user_id, case when count(*) over (partition by event_type) >= 20
  then floor(100 * (rank() over (partition by event_type order by value) - 1) / (count(*) over (partition by event_type)))::bigint end as percentile from first
""")
def cohort_percent_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's first attempt among the first attempts of its cohort."""
    first = ranking.first_per(events(spark, sf_dir), [F.col("event_type"), F.col("user_id")], [F.asc("ts"), F.asc("event_id")])
    return cohort.percent_below(first, "event_type", "value", 20).select("event_type", "user_id", "percentile")


@register("""
with f as (select user_id, bool_or(event_type = 'view') as a, bool_or(event_type = 'click') as b, bool_or(event_type = 'purchase') as c
  from events where ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-06 00:00:00' group by user_id)
select 0 as step_no, 'view' as step, count(*) filter (where a) as actors, count(*) filter (where a) as also_before from f
union all select 1, 'click', count(*) filter (where b), count(*) filter (where a and b) from f
union all select 2, 'purchase', count(*) filter (where c), count(*) filter (where b and c) from f
""")
def funnel_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = events(spark, sf_dir).where(dates.half_open("ts", "2024-01-05", "2024-01-06"))
    return cohort.funnel(day, "user_id", "event_type", ["view", "click", "purchase"])


@register("""
with d as (select cast(unnest(generate_series(date '2023-12-30', date '2024-02-02', interval 1 day)) as date) as day),
c as (select cast(ts + interval 3 hour as date) as day, count(*) as n from events group by 1)
select cast(d.day as varchar) as day, coalesce(n, 0) as n from d left join c on d.day = c.day
""")
def activity_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort.zero_filled_days(events(spark, sf_dir), dates.local_day("ts"), "2023-12-30", "2024-02-02")
    return rows.select(F.col("day").cast("string").alias("day"), "n")


@register("""
select user_id, cast(day as varchar) as day, n from (
 select user_id, day, n, row_number() over (partition by user_id order by n desc, day desc) as r from (
  select user_id, cast(ts + interval 3 hour as date) as day, count(*) as n from events group by all)) where r = 1
""")
def best_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = events(spark, sf_dir).groupBy("user_id", dates.local_day("ts").alias("day")).agg(F.count("*").alias("n"))
    best = ranking.best_per_key(days, "user_id", [F.desc("n"), F.desc("day")])
    return best.select("user_id", F.col("day").cast("string").alias("day"), "n")


@register("""
select user_id, event_type as favourite, n from (
 select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, event_type) as r from events group by user_id, event_type) where r = 1
""")
def mode_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent type of each user, ties by name."""
    counts = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = ranking.best_per_key(counts, "user_id", [F.desc("n"), F.asc("event_type")])
    return best.select("user_id", F.col("event_type").alias("favourite"), "n")


@register("""
select user_id, count(*) as attempts, count(*) filter (where event_type = 'purchase') as correct,
 round_even(100.0 * count(*) filter (where event_type = 'purchase') / count(*), 0)::bigint as accuracy,
 cast(trunc(avg(case when value <> 0 then value end)) as bigint) as mean_value,
 (100 * count(*) filter (where event_type = 'purchase')) // count(*) as accuracy_floor
from events group by user_id
""")
def personal_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of sums rounded half to even, and a mean that ignores zeros and is cut to a whole number."""
    right = F.count_if(F.col("event_type") == "purchase")
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("attempts"),
        right.alias("correct"),
        F.bround(100.0 * right / F.count("*")).cast("long").alias("accuracy"),
        F.avg(F.when(F.col("value") != 0, F.col("value"))).cast("long").alias("mean_value"),
        F.floor(100 * right / F.count("*")).alias("accuracy_floor"),
    )


@register("""
with r as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events where value is not null),
p as (select event_type, max(value) filter (where k = greatest(1, ceil(25 * n / 100.0))) as p25, max(value) filter (where k = greatest(1, ceil(90 * n / 100.0))) as p90 from r group by 1)
select event_type, count(*) as attempts, round(median(value), 6) as median_value, round(100.0 * count(*) / sum(count(*)) over (), 4) as share,
 count(*) filter (where value > 100) as high, any_value(p25) as p25, any_value(p90) as p90 from events join p using (event_type) group by event_type having count(*) >= 20
""")
def economy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes with enough attempts: size, median and percentiles, share of all attempts of such modes, and high values."""
    from pyspark.sql import Window as W

    all_ = events(spark, sf_dir)
    values = cohort.ranked_values(all_, ["event_type"], "value", {"median_value": cohort.median_ranks(), "p25": cohort.ceil_rank(25), "p90": cohort.ceil_rank(90)})
    rows = all_.groupBy("event_type").agg(F.count("*").alias("attempts"), F.count_if(F.col("value") > 100).alias("high"))
    rows = rows.where("attempts >= 20").join(values, "event_type").withColumn("median_value", F.round("median_value", 6))
    return rows.withColumn("share", F.round(100.0 * F.col("attempts") / F.sum("attempts").over(W.partitionBy()), 4))


@register("""
select k, count(*) as n, count(distinct user_id) as users, round(avg(value), 6) as mean_value from (
 select user_id, value, cast(json_extract(props, '$.k') as bigint) as k from events) where k is not null group by k
""")
def nested_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a field inside the JSON column; malformed items are skipped."""
    raw = load(spark, sf_dir, "events", "user_id", "value", "props")
    parsed = raw.withColumn("k", F.from_json("props", "k bigint")["k"]).where(F.col("k").isNotNull())
    return parsed.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"))


@register("""
select user_id % 10 as item, count(*) as shown, count(*) filter (where event_type = 'purchase') as correct, count(*) filter (where event_type = 'error') as wrong,
 count(*) filter (where event_type = 'view') as skipped, sum(cast(round(value * 10) as bigint))::bigint as total_ms from events group by 1
""")
def incremental_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that each answer adds to."""
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    return events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("item")).agg(
        F.count("*").alias("shown"),
        is_("purchase").alias("correct"),
        is_("error").alias("wrong"),
        is_("view").alias("skipped"),
        F.sum(F.round(F.col("value") * 10).cast("long")).alias("total_ms"),
    )


@register("""
with s as (select user_id % 50 as item, count(*) filter (where event_type = 'purchase') as ok, count(*) filter (where event_type in ('purchase', 'error')) as n from events group by 1)
select item, ok, n, case when 1.0 * ok / n >= 0.9 then 1 when 1.0 * ok / n >= 0.7 then 2 when 1.0 * ok / n >= 0.5 then 3 when 1.0 * ok / n >= 0.3 then 4 else 5 end as difficulty from s where n >= 20
""")
def measured_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty 1 to 5 from the share solved, where at least 20 tried."""
    rows = events(spark, sf_dir).groupBy((F.col("user_id") % 50).alias("item")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("ok"), F.count_if(F.col("event_type").isin("purchase", "error")).alias("n")
    )
    return rows.where("n >= 20").withColumn("difficulty", scoring.difficulty_from_share(F.col("ok") / F.col("n")))


@register("""
with w as (select event_type, count(*) as weight from events group by event_type),
e as (select *, 100.0 * weight / sum(weight) over () as exact from w),
f as (select *, floor(exact) as base, 100 - sum(floor(exact)) over () as rest, row_number() over (order by round(exact - floor(exact), 9) desc, event_type) as r from e)
select event_type, weight, (base + case when r <= rest then 1 else 0 end)::bigint as share from f
""")
def apportionment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole percentages that add up to 100."""
    weights = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("weight"))
    return cohort.apportion(weights, [], "weight", [F.asc("event_type")], 100).select("event_type", "weight", "share")


@register("""
with e as (select user_id, event_type, ts, event_id from events where event_type = 'view'),
d as (select a.user_id, count(*) as rival_count from (select distinct user_id, cast(ts as date) as day from e) a
  join (select distinct user_id, cast(ts as date) as day from e) b on a.day = b.day and a.user_id <> b.user_id group by a.user_id)
select user_id, rival_count from d
""")
def duel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user, how many others were there on its days, added up; counted by day, so no pairs are made."""
    seen = events(spark, sf_dir).where("event_type = 'view'").select("user_id", F.to_date("ts").alias("day")).distinct()
    others = seen.groupBy("day").agg((F.count("*") - 1).alias("others"))
    return seen.join(others, "day").groupBy("user_id").agg(F.sum("others").alias("rival_count")).where("rival_count > 0")


@register("""
with w as (select user_id, date_trunc('hour', ts) as hour, count(distinct cast(round(value) as bigint)) as items from events group by all)
select user_id, cast(hour as varchar) as hour, items from w where items >= 2
""")
def quota_distinct_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct items of each subject in tumbling hours, where the quota of one is passed."""
    item = F.round("value").cast("long")
    rows = events(spark, sf_dir).groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.countDistinct(item).alias("items"))
    return rows.where("items >= 2").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "items")


@register("""
with recursive o as (select user_id, event_type, epoch(ts)::double as t, event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events),
walk as (
  select user_id, event_type, n, event_id, t, t as anchor, true as stored from o where n = 1
  union all
  select o.user_id, o.event_type, o.n, o.event_id, o.t, case when o.t - w.anchor > 14400 then o.t else w.anchor end, o.t - w.anchor > 14400
  from walk w join o on o.user_id = w.user_id and o.event_type = w.event_type and o.n = w.n + 1)
select event_id, stored from walk
""")
def suppress_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats within four hours of the last stored event of the same owner and kind are not stored."""
    return dates.anchored_suppression(events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id", 14400).select("event_id", "stored")


@register("""
with s as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 24 hour then 0 else 1 end as new from events where event_type = 'error'),
i as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from s)
select user_id, session::bigint as session, count(*) as failures, case when count(*) >= 10 then 3600 when count(*) >= 5 then 300 when count(*) >= 3 then 60 else 0 end as penalty from i group by all
""")
def failure_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures counted until a day passes without one, and the penalty the count brings."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events(spark, sf_dir).where("event_type = 'error'")
    fresh = F.when(F.col("ts") - F.expr("INTERVAL 24 HOURS") <= F.lag("ts").over(w), 0).otherwise(1)
    marked = rows.withColumn("new", fresh).withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("failures")).withColumn("penalty", scoring.penalty_seconds(F.col("failures")))


@register("""
with a as (select event_id, ts, ts + interval 90 minute as expires_at, ts + interval 95 minute as graced_at, case when event_type = 'error' then null else ts + (value * 2) * interval 1 minute end as submitted from events)
select event_id, case when submitted is null or submitted > graced_at then true else false end as lapsed,
 cast(ceil(epoch(case when submitted is null or submitted > expires_at then expires_at else submitted end) - epoch(ts)) as bigint) as spent_s
from a where expires_at < timestamp '2024-01-31 12:00:00'
""")
def lapsed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts past their time and five minutes of grace have lapsed; all are closed at their expiry at the latest, not when found."""
    minutes = F.col("value") * 2
    rows = events(spark, sf_dir).withColumn("limit_s", F.lit(5400.0)).withColumn("used_s", F.when(F.col("event_type") != "error", minutes * 60))
    lapsed = F.col("used_s").isNull() | (F.col("used_s") > F.col("limit_s") + 300)
    late = F.col("used_s").isNull() | (F.col("used_s") > F.col("limit_s"))
    open_ = rows.where(F.col("ts") + F.expr("INTERVAL 90 MINUTES") < "2024-01-31 12:00:00")
    return open_.select("event_id", lapsed.alias("lapsed"), F.ceil(F.round(F.when(late, F.col("limit_s")).otherwise(F.col("used_s")), 6)).cast("long").alias("spent_s"))


@register("""
select count(*) filter (where ts < timestamp '2024-01-15 00:00:00') as to_purge, count(*) filter (where ts >= timestamp '2024-01-15 00:00:00') as kept,
 cast(date '2024-02-29' - interval 1 month as date)::varchar as cutoff_from_leap from events
""")
def retention_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows older than one calendar month before 2024-02-15, and the month's-end rule."""
    old = F.col("ts") < dates.months_ago("2024-02-15", 1)
    return events(spark, sf_dir).agg(
        F.count_if(old).alias("to_purge"), F.count_if(~old).alias("kept"), F.first(dates.months_ago("2024-02-29", 1).cast("string")).alias("cutoff_from_leap")
    )


@register("""
with o as (select cast(round(value) as bigint) as session_key, count(distinct user_id) as n, min(user_id) as owner from events where event_type = 'signup' group by 1)
select e.event_id, o.owner from events e join o on cast(round(e.value) as bigint) = o.session_key where o.n = 1 and e.event_type = 'view'
""")
def identity_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anonymous rows get a user where exactly one user owns their session key."""
    rows = events(spark, sf_dir).withColumn("session_key", F.round("value").cast("long"))
    owners = relational.unique_owner(rows.where("event_type = 'signup'").withColumnRenamed("user_id", "owner"), "session_key", "owner")
    return rows.where("event_type = 'view'").join(owners, "session_key").select("event_id", "owner")


@register("""
with p as (select user_id, ts, value from events where event_type = 'purchase')
select user_id, count(*) as n, round(100 * pow(greatest(count(*) - 1, 0), 1.5), 4) as xp_needed, cast(floor(sum(value)) as bigint) as xp,
  list_max(list_filter(range(1, 2000), lambda l: 100 * pow(l - 1, 1.5) <= floor(sum(value)))) as level from p group by user_id
""")
def level_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experience that as many levels as purchases need, and the level that the purchases' value reaches."""
    rows = events(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"), F.floor(F.sum("value")).alias("xp"))
    return rows.select("user_id", "n", F.round(scoring.xp_for_level(F.col("n")), 4).alias("xp_needed"), "xp", scoring.level_for_xp(F.col("xp")).cast("long").alias("level"))


@register("""
with first as (select * from (select *, row_number() over (partition by user_id, event_type, cast(round(value) as bigint) order by ts, event_id) as n from events) where n = 1)
select user_id, cast(cast(ts + interval 3 hour as date) as varchar) as day, count(*) as solved, sum(case event_type when 'purchase' then 50 when 'signup' then 30 when 'click' then 10 when 'view' then 5 else 0 end)::bigint as xp
from first group by all
""")
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-day totals rebuilt from the event log: only the first solve of an item brings points."""
    item = F.round("value").cast("long")
    first = ranking.first_per(events(spark, sf_dir), [F.col("user_id"), F.col("event_type"), item], [F.asc("ts"), F.asc("event_id")])
    points = scoring.xp_by_type(F.col("event_type"))
    return first.groupBy("user_id", dates.local_day("ts").cast("string").alias("day")).agg(F.count("*").alias("solved"), F.sum(points).alias("xp"))


@register("""
select block, got, most, first_number from (
 select event_type as block, sum(cast(round(value) as bigint))::bigint as got, max(cast(round(value) as bigint)) as most, min(event_id) as first_number from events group by 1)
""")
def block_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals per block, numbered by the block's first item."""
    points = F.round("value").cast("long")
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("block")).agg(F.sum(points).alias("got"), F.max(points).alias("most"), F.min("event_id").alias("first_number"))


@register("""
select user_id, event_id, score, place from (
 select user_id, event_id, cast(round(value * 100) as bigint) as score, row_number() over (order by cast(round(value * 100) as bigint) desc, seconds, ts, event_id) as place from (
  select *, case when event_type = 'error' then 90 * 60 else cast(ceil(value) as bigint) end as seconds from events where cast(ts as date) = date '2024-01-10'))
""")
def exam_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, then time spent (the whole limit for runs closed by the clock), then submission, then id."""
    rows = events(spark, sf_dir).where(F.to_date("ts") == "2024-01-10").withColumn("score", F.round(F.col("value") * 100).cast("long"))
    rows = rows.withColumn("seconds", F.when(F.col("event_type") == "error", F.lit(5400)).otherwise(F.ceil("value")))
    return ranking.places(rows, [F.desc("score"), F.asc("seconds"), F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id", "score", "place")


@register("select cast(cast(ts as date) as varchar) as day, event_type as kind, round(sum(value), 2) as cost, count(*) as calls from events group by all")
def cost_per_kind_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("kind"))
    return rows.agg(F.round(F.sum("value"), 2).alias("cost"), F.count("*").alias("calls"))


@register("""
with l as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events where value is not null),
p as (select event_type, max(case when k = greatest(1, ceil(50 * n / 100.0)) then value end) as p50, max(case when k = greatest(1, ceil(95 * n / 100.0)) then value end) as p95, max(value) as top from l group by event_type)
select event_type, p50, p95, top, p95 > greatest(200, 1.5 * p50) as failed from p
""")
def latency_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p50, p95 and maximum, and whether p95 passes the larger of a floor and a multiple of the baseline."""
    rows = events(spark, sf_dir)
    p50, p95 = (cohort.nearest_rank_ceil(rows, ["event_type"], "value", p) for p in (50, 95))
    top = rows.groupBy("event_type").agg(F.max("value").alias("top"))
    return p50.join(p95, "event_type").join(top, "event_type").withColumn("failed", F.col("p95") > F.greatest(F.lit(200.0), 1.5 * F.col("p50")))


@register("""
with t as (select user_id, count(*) as n from events group by user_id), s as (select event_id % 1000 as k, user_id from events)
select s.k, count(distinct s.user_id) as people from s group by s.k having count(distinct s.user_id) >= 3
""")
def popular_with_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that at least three different people typed."""
    rows = events(spark, sf_dir).groupBy((F.col("event_id") % 1000).alias("k")).agg(F.countDistinct("user_id").alias("people"))
    return rows.where("people >= 3")


@register("""
with r as (select event_id, user_id, ts from events where event_type = 'signup')
select event_id, week, cast(cast(ts as date) + (7 * week)::integer as varchar) as day from r, (select unnest(range(0, 4)) as week)
""")
def recurring_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four weekly copies of each entry."""
    rows = events(spark, sf_dir).where("event_type = 'signup'").select("event_id", "ts", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("week"))
    return rows.select("event_id", "week", F.date_add(F.to_date("ts"), 7 * F.col("week")).cast("string").alias("day"))


@register("""
select count(*) as n, sum(event_id)::bigint as id_sum, cast(max(ts) as varchar)[1:19] as newest,
 substr(sha1(count(*) || ',' || sum(event_id)::bigint || ',' || strftime(max(ts), '%Y-%m-%d %H:%M:%S')), 1, 16) as digest from events
""")
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change detector: count, sum of ids and newest time, hashed."""
    newest = F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss")
    one = events(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"), newest.alias("newest"))
    return one.withColumn("digest", F.substring(F.sha1(F.concat_ws(",", "n", "id_sum", "newest")), 1, 16))


@register("""
with s as (select user_id, cast(ts as date) as day, round(sum(value), 6) as score from events where event_type = 'purchase' group by 1, 2),
r as (select user_id, day, rank() over (partition by day order by score) - 1 as wins, rank() over (partition by day order by score desc) - 1 as losses, count(*) over (partition by day) - 1 as rivals from s)
select user_id, sum(rivals)::bigint as duels, sum(wins)::bigint as won, sum(losses)::bigint as lost, sum(rivals - wins - losses)::bigint as drawn from r group by 1
""")
def duel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's scores against those of all others of the same days: won, lost and drawn, counted without pairs."""
    days = events(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("score"))
    days = Scratch(spark, "duels").keep(days, "days")
    placed = days.join(cohort.counts_below(days, ["day"], "score"), ["day", "score"])
    lost = F.col("size") - F.col("below") - F.col("n")
    return placed.groupBy("user_id").agg(F.sum(F.col("size") - 1).alias("duels"), F.sum("below").alias("won"), F.sum(lost).alias("lost"), F.sum(F.col("n") - 1).alias("drawn"))


@register("""
with u as (select event_type, user_id, count(*) as n, count(*) filter (where value > 50) as good from events group by 1, 2)
select event_type, count(*) as users, sum(n)::bigint as attempts, sum(good)::bigint as good, round(sum(good) / sum(n)::double, 9) as share, max(n) as most, round(avg(n), 9) as mean, sum((good = 0)::int)::bigint as without from u group by 1
""")
def work_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of work: who did it, how often and how well, the busiest, and those who never did well."""
    by_user = events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("good"))
    return by_user.groupBy("event_type").agg(
        F.count("*").alias("users"), F.sum("n").alias("attempts"), F.sum("good").alias("good"), F.round(F.sum("good") / F.sum("n"), 9).alias("share"), F.max("n").alias("most"), F.round(F.avg("n"), 9).alias("mean"), F.count_if(F.col("good") == 0).alias("without")
    )


def _daily_sql(anonymous: bool) -> str:
    some = "" if anonymous else "where user_id % 10 <> 0"
    return f"""select cast(ts as date) as day, user_id, max(value) as best from events {some} group by 1, 2"""


@register(f"""
with a as (select 'all' as kind, * from ({_daily_sql(True)}) union all select 'named', * from ({_daily_sql(False)})),
p as (select *, row_number() over (partition by kind, day order by best desc, user_id) as place from a)
select kind, cast(day as varchar) as day, user_id, best, place, place > 3 as outside_top from p where place <= 3 or user_id = 7
""")
def daily_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's three best with user 7's own place, once with everybody and once without the anonymous rows."""
    best = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.max("value").alias("best"))
    out = None
    for kind, rows in (("all", best), ("named", best.where("user_id % 10 <> 0"))):
        placed = ranking.places(rows, [F.desc("best"), F.asc("user_id")], ["day"])
        board = ranking.board_with_me(placed, 3, F.col("user_id") == 7).withColumn("kind", F.lit(kind))
        out = board if out is None else out.unionByName(board)
    return out.select("kind", F.col("day").cast("string").alias("day"), "user_id", "best", "place", "outside_top")
