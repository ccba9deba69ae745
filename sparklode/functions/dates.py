"""Local days, weeks, half-open intervals, calendar months and anchored windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Europe/Moscow"


def local_day(ts: str, zone: str = ZONE) -> Column:
    """The calendar day in `zone`, not in UTC."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def week_start(ts: str, zone: str = ZONE) -> Column:
    """Monday of the local week."""
    return F.to_date(F.date_trunc("week", F.from_utc_timestamp(ts, zone)))


def half_open(ts: str, since: str, until: str) -> Column:
    return (F.col(ts) >= since) & (F.col(ts) < until)


def months_ago(day: str, months: int) -> Column:
    """The same day some months earlier, or the month's last day."""
    return F.add_months(F.lit(day).cast("date"), -months)


def academic_year(day: Column, first_month: int = 9) -> Column:
    """The year in which the academic year of a day began."""
    return F.year(day) - F.when(F.month(day) < first_month, 1).otherwise(0)


def anchored_suppression(df: DataFrame, keys: Sequence[str], ts: str, id_col: str, seconds: float) -> DataFrame:
    """(keys, id, stored): an event is stored unless it is within `seconds` of the last stored event of its keys.

    The anchor doesn't slide, so this is no session window: rows go through each key's sorted events with the last stored
    time as the only state. Rows are sorted within range-free hash partitions, and the batches of a partition stream by,
    so a hot key costs time in one task but never memory.
    """
    names = [*keys, id_col, "stored"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor = None, 0.0
        for rows in batches:
            stored = []
            for at, t in zip(rows[list(keys)].itertuples(index=False, name=None), rows["__t"]):
                fresh = at != key or t - anchor > seconds
                if fresh:
                    key, anchor = at, t
                stored.append(fresh)
            yield rows[[*keys, id_col]].assign(stored=stored)

    slim = df.select(*keys, id_col, F.col(ts).cast("double").alias("__t"))
    ordered = slim.repartition(*keys).sortWithinPartitions(*keys, "__t", id_col)
    return ordered.mapInPandas(walk, ", ".join(f"{n} {kinds.get(n, 'boolean')}" for n in names))
