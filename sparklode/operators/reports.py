"""Pivots, cross-tabs, quotas and small report helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklode.functions.dates import academic_year


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[int]) -> DataFrame:
    """Rows of each `row` by `column` value: y<value> and has<value>. The values are given, so one pass is enough."""
    counts = [F.count_if(F.col(column) == v).alias(f"y{v}") for v in values]
    out = df.groupBy(row).agg(*counts)
    return out.withColumns({f"has{v}": F.col(f"y{v}") > 0 for v in values})


def crosstab(df: DataFrame, old: str, new: str) -> DataFrame:
    """Counts by cell `old->new`, over rows that have both."""
    both = df.where(F.col(old).isNotNull() & F.col(new).isNotNull())
    return both.groupBy(F.concat_ws("->", old, new).alias("cell")).agg(F.count("*").alias("n"))


def number_prefix(column: str, number: int, digits: int) -> Column:
    """Numbers of up to `digits` digits that begin with `number`, as a disjunction of ranges."""
    out, low, high = F.col(column) == number, number, number
    for _ in range(digits - len(str(number))):
        low, high = low * 10, high * 10 + 9
        out = out | F.col(column).between(low, high)
    return out


def match_class(name: Column, query: str) -> Column:
    """0: the name starts with the query, 1: a word does, 2: it is somewhere inside. Both in lower case."""
    import re

    return F.when(name.startswith(query), 0).when(name.rlike(f"(^|[^a-z]){re.escape(query)}"), 1).otherwise(2)


def pick_with_quota(df: DataFrame, source: str, order: Sequence[Column], stages: int, k: int) -> DataFrame:
    """`k` rows, first with at most one per source, then two, ...; the last stage takes any."""
    nth = F.row_number().over(W.partitionBy(source).orderBy(*order))
    return df.withColumn("stage", F.least(nth, F.lit(stages))).orderBy("stage", *order).limit(k)


def academic_months(df: DataFrame, day: Column, first: int, last: int) -> DataFrame:
    """(bucket, year, month, n): rows by month of the academic years `first` to `last`, empty months included; `undated` and `outside` have year and month 0."""
    year = academic_year(day)
    bucket = F.when(day.isNull(), "undated").when(year.between(first, last), "month").otherwise("outside")
    placed = df.select(bucket.alias("bucket"), F.when(bucket == "month", year).otherwise(0).alias("year"), F.when(bucket == "month", F.month(day)).otherwise(0).alias("month"))
    years, months = (F.sequence(F.lit(a), F.lit(b)) for a, b in ((first, last), (1, 12)))
    cells = df.sparkSession.range(1).select(F.explode(years).alias("year")).select("year", F.explode(months).alias("month")).select(F.lit("month").alias("bucket"), "year", "month")
    rest = df.sparkSession.range(1).select(F.explode(F.array(F.lit("undated"), F.lit("outside"))).alias("bucket"), F.lit(0).alias("year"), F.lit(0).alias("month"))
    counted = placed.groupBy("bucket", "year", "month").agg(F.count("*").alias("n"))
    return cells.unionByName(rest).join(counted, ["bucket", "year", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
