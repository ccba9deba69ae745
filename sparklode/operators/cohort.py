"""Cohorts and activity: percentiles, percent ranks, funnels, calendars and apportionment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklode.sources.scratch import Scratch


def counts_below(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, below, size), one row per distinct value of a key: its rows, those with a smaller value, and all of the key's.

    Equal values are counted where they are read. The distinct ones are dealt to tasks by range, so that a key with most of the
    rows is many tasks' work, summed within each task's part of a key, and moved on by what the key's earlier parts hold.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    dealt = counts.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id())
    rows = Scratch(df.sparkSession, "counts-below").keep(dealt, "counts")
    earlier = F.sum("n").over(W.partitionBy("__part", *keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    inside = rows.withColumn("__inside", F.coalesce(earlier, F.lit(0)))
    sums = rows.groupBy("__part", *keys).agg(F.sum("n").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sums.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], before.alias("__before"), F.sum("held").over(W.partitionBy(*keys)).alias("size"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return inside.join(parts, same).select(*keys, value, "n", (F.col("__inside") + F.col("__before")).alias("below"), "size")


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, a column for each of `ranks`): the values at several ranks, each an expression over `size`, from one count.

    A rank may lie between two: `name: (low, high)` gives their mean, as a median wants it."""
    found = counts_below(df.where(F.col(value).isNotNull()), keys, value)
    at = lambda rank: F.max(F.when((rank > F.col("below")) & (rank <= F.col("below") + F.col("n")), F.col(value)))
    out = {name: (at(rank[0]) + at(rank[1])) / 2 if isinstance(rank, tuple) else at(rank) for name, rank in ranks.items()}
    return found.groupBy(*keys).agg(*[c.alias(name) for name, c in out.items()])


def round_rank(percent: int) -> Column:
    """round(p / 100 * n), half to even, kept inside the list."""
    return F.greatest(F.lit(1), F.least(F.bround(F.lit(percent) / 100 * F.col("size")).cast("long"), F.col("size")))


def ceil_rank(percent: int) -> Column:
    """ceil(p * n / 100)."""
    return F.greatest(F.lit(1), F.ceil(F.lit(percent) * F.col("size") / 100))


def median_ranks() -> tuple[Column, Column]:
    return F.floor((F.col("size") + 1) / 2), F.floor(F.col("size") / 2) + 1


def _at_rank(df: DataFrame, keys: Sequence[str], value: str, rank: Column, name: str) -> DataFrame:
    found = counts_below(df.where(F.col(value).isNotNull()), keys, value)
    return found.where((rank > F.col("below")) & (rank <= F.col("below") + F.col("n"))).select(*keys, F.col(value).alias(name))


def nearest_rank_round(df: DataFrame, keys: Sequence[str], value: str, percent: int) -> DataFrame:
    """The value at index round(p / 100 * n) - 1 of the sorted values, half to even, kept inside the list."""
    return _at_rank(df, keys, value, round_rank(percent), f"p{percent}")


def nearest_rank_ceil(df: DataFrame, keys: Sequence[str], value: str, percent: int) -> DataFrame:
    """The value at rank ceil(p * n / 100)."""
    return _at_rank(df, keys, value, ceil_rank(percent), f"p{percent}")


def percent_below(df: DataFrame, cohort: str, value: str, least: int) -> DataFrame:
    """Floor of the percentage of the cohort with a strictly smaller value; null in cohorts of fewer than `least`."""
    found = counts_below(df, [cohort], value).select(F.col(cohort).alias("__c"), F.col(value).alias("__v"), "below", "size")
    rows = df.join(found, F.col(cohort).eqNullSafe(F.col("__c")) & F.col(value).eqNullSafe(F.col("__v")))
    return rows.withColumn("percentile", F.when(F.col("size") >= least, F.floor(100 * F.col("below") / F.col("size")))).drop("__c", "__v", "below", "size")


def funnel(df: DataFrame, actor: str, name: str, steps: Sequence[str]) -> DataFrame:
    """Distinct actors of each step, and of each step together with the one before; steps need not come in order."""
    flags = df.groupBy(actor).agg(*[F.bool_or(F.col(name) == s).alias(f"f{k}") for k, s in enumerate(steps)])
    sums = [F.count_if(F.col(f"f{k}")).alias(f"n{k}") for k in range(len(steps))]
    both = [F.count_if(F.col(f"f{k - 1}") & F.col(f"f{k}")).alias(f"b{k}") for k in range(1, len(steps))]
    one = flags.agg(*sums, *both)
    rows = [F.struct(F.lit(k).alias("step_no"), F.lit(s).alias("step"), F.col(f"n{k}").alias("actors"), (F.col(f"b{k}") if k else F.col("n0")).alias("also_before")) for k, s in enumerate(steps)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def zero_filled_days(df: DataFrame, day: Column, first: str, last: str) -> DataFrame:
    """Rows per calendar day from `first` to `last`, days without rows included."""
    spark = df.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    counted = df.withColumn("day", day).groupBy("day").agg(F.count("*").alias("n"))
    return calendar.join(counted, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def apportion(df: DataFrame, keys: Sequence[str], weight: str, order: Sequence[Column], total: int) -> DataFrame:
    """Whole shares of `total` in proportion to the weights, by largest remainder; ties go by `order`."""
    w = W.partitionBy(*keys)
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(w)
    base = df.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact"))
    rest = F.lit(total) - F.sum("__floor").over(w)
    rank = F.row_number().over(w.orderBy(F.desc(F.round(F.col("__exact") - F.col("__floor"), 9)), *order))
    given = base.withColumn("__rest", rest).withColumn("__rank", rank)
    return given.withColumn("share", F.col("__floor") + F.when(F.col("__rank") <= F.col("__rest"), 1).otherwise(0)).drop("__exact", "__floor", "__rest", "__rank")
