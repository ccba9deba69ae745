"""Ranking, places, streaks and other ordered computations. Every ordering ends in an id, so results are total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklode.sources.scratch import Scratch

Order = Sequence[Column]


def best_per_key(df: DataFrame, key: str, order: Order) -> DataFrame:
    """The first row of each key in `order`."""
    return top_k_per_group(df, [key], order, 1).drop("rank_in_group")


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Order, k: int) -> DataFrame:
    """The first `k` rows of each group with their rank_in_group; the filter on the rank is pushed below the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank_in_group", rank).where(F.col("rank_in_group") <= k)


def places(df: DataFrame, order: Order, board: Sequence[str] = ()) -> DataFrame:
    """Ordinal places 1, 2, ... within each board.

    Places over a whole large table are counted in two steps: rows are range-partitioned, sorted and numbered within their
    partition, and written with both numbers, so that they are dealt out once; the partitions' sizes (one row each) then
    give the offsets. No single task sees all rows. Boards are dealt out by range in the same way, so that a board with most of
    the rows is numbered in parts; at most two boards of a partition go on in another, so their offsets are few.
    """
    if board:
        return _places_on_boards(df, order, board)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__in": inside + 1})
    numbered = Scratch(df.sparkSession, "places").keep(dealt, "numbered")
    sizes = numbered.groupBy("__part").agg(F.max("__in").alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return numbered.join(F.broadcast(offsets), "__part").withColumn("place", F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")


def _places_on_boards(df: DataFrame, order: Order, board: Sequence[str]) -> DataFrame:
    dealt = df.repartitionByRange(*[F.asc(b) for b in board], *order).withColumn("__part", F.spark_partition_id())
    rows = Scratch(df.sparkSession, "places").keep(dealt, "dealt")
    sizes = rows.groupBy("__part", *board).agg(F.count("*").alias("size"))
    whole = W.partitionBy(*board)
    before = F.sum("size").over(whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    names = [F.col(b).alias(f"__b{k}") for k, b in enumerate(board)]
    later = sizes.select(F.col("__part").alias("__p"), *names, before.alias("__before")).where("__before is not null")
    here = F.col("__part") == F.col("__p")
    for k, b in enumerate(board):
        here = here & F.col(b).eqNullSafe(F.col(f"__b{k}"))
    inside = rows.withColumn("__in", F.row_number().over(W.partitionBy("__part", *board).orderBy(*order)))
    placed = inside.join(F.broadcast(later), here, "left").withColumn("place", F.col("__in") + F.coalesce("__before", F.lit(0)))
    return placed.drop("__part", "__in", "__p", "__before", *[f"__b{k}" for k in range(len(board))])


def board_with_me(placed: DataFrame, top: int, mine: Column) -> DataFrame:
    """The first `top` places and the asker's own row, wherever it stands."""
    return placed.where((F.col("place") <= top) | mine).withColumn("outside_top", F.col("place") > top)


def gap_to_better(df: DataFrame, value: str, board: Sequence[str]) -> DataFrame:
    """The distance to the next better distinct value on the board; null for the best."""
    nearest = before_in_order(df.select(*board, value).distinct(), board, [F.desc(value)], value, "__up").select(*board, value, "__up")
    return df.join(nearest, [*board, value]).withColumn("gap", F.col("__up") - F.col(value)).drop("__up")


def before_in_order(df: DataFrame, board: Sequence[str], order: Order, value: str, name: str) -> DataFrame:
    """`df` with `value` of the row before on its board as `name`; null for a board's first row, and `value` must not be null.

    Rows are dealt out by range of (board, order), so that a board with most of the rows is many tasks' work. The first row of a task's
    part of a board takes the last value of the part before: one row a part, and at most two boards of a task go on elsewhere.
    """
    dealt = df.repartitionByRange(*[F.asc(b) for b in board], *order).withColumn("__part", F.spark_partition_id())
    rows = Scratch(df.sparkSession, "before").keep(dealt, "dealt")
    inside = W.partitionBy("__part", *board).orderBy(*order)
    marked = rows.withColumn("__own", F.lag(value).over(inside)).withColumn("__first", F.row_number().over(inside) == 1).withColumn("__last", F.lead(value).over(inside).isNull())
    ends = marked.where("__last").select(*[F.col(b).alias(f"__b{k}") for k, b in enumerate(board)], "__part", F.col(value).alias("__end"))
    keys = [f"__b{k}" for k in range(len(board))]
    carried = ends.withColumn("__carried", F.lag("__end").over(W.partitionBy(*keys).orderBy("__part"))).where("__carried is not null")
    here = F.col("__part") == F.col("__p")
    for k, b in enumerate(board):
        here = here & F.col(b).eqNullSafe(F.col(f"__b{k}"))
    joined = marked.join(F.broadcast(carried.select(F.col("__part").alias("__p"), *keys, "__carried")), here & F.col("__first"), "left")
    return joined.withColumn(name, F.coalesce("__own", "__carried")).drop("__part", "__p", "__own", "__first", "__last", "__carried", *keys)


def running_record(df: DataFrame, key: str, order: Order, value: Column, counts: Column) -> DataFrame:
    """Running maximum of `value` over earlier and this row; only rows where `counts` holds advance it."""
    frame = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("record", F.max(F.when(counts, value)).over(frame))


def day_streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive days: key, first_day, last_day, length."""
    distinct = days.select(key, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(W.partitionBy(key).orderBy(day)))
    runs = distinct.withColumn("__island", island).groupBy(key, "__island")
    return runs.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("length")).drop("__island")


def streak_summary(streaks: DataFrame, key: str, today: Column) -> DataFrame:
    """Best run, the run that reaches today or yesterday (0 without one), and the days of the seven up to today."""
    alive = F.col("last_day") >= F.date_sub(today, 1)
    inside = F.datediff(F.least("last_day", today), F.greatest("first_day", F.date_sub(today, 6))) + 1
    return streaks.groupBy(key).agg(
        F.max("length").alias("best"), F.coalesce(F.max(F.when(alive, F.col("length"))), F.lit(0)).alias("current"), F.sum(F.greatest(inside, F.lit(0))).cast("long").alias("week")
    )


def longest_run(df: DataFrame, key: str, order: Order, failed: Column) -> DataFrame:
    """The longest stretch of rows without a failure between failures."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = df.withColumn("__fail", failed.cast("int")).withColumn("__island", F.sum("__fail").over(w))
    runs = marked.groupBy(key, "__island").agg(F.sum(1 - F.col("__fail")).alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest_run"))


def earlier_in_day(df: DataFrame, key: str, day: str, order: Order, counted: Column) -> DataFrame:
    """How many counted rows of the same key and day come before each row."""
    w = W.partitionBy(key, day).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("earlier", F.coalesce(F.sum(counted.cast("int")).over(w), F.lit(0)))


def first_per(df: DataFrame, keys: Sequence[Column], order: Order) -> DataFrame:
    """The earliest row for each combination of key expressions."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def adjacent_breaks(df: DataFrame, block: str, order: Order, first: str, second: str) -> DataFrame:
    """Rows whose `first` differs from the previous row's `second` in the block; a missing second letter is a break too."""
    before = F.lag(second).over(W.partitionBy(block).orderBy(*order))
    has_before = F.row_number().over(W.partitionBy(block).orderBy(*order)) > 1
    return df.withColumn("previous", before).withColumn("__has", has_before).where(F.col("__has") & ~F.col(first).eqNullSafe(F.col("previous"))).drop("__has")


def run_lengths(df: DataFrame, keys: Sequence[str], order: Order, value: str, number: str) -> DataFrame:
    """Neighbouring rows of one value as ranges: keys, value, first, last, length."""
    w = W.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    island = F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    runs = df.withColumn("__new", changed).withColumn("__run", island).groupBy(*keys, "__run", value)
    return runs.agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("length")).drop("__run")


def latest_n(df: DataFrame, key: str, order_newest_first: Order, n: int) -> DataFrame:
    """The newest `n` rows of each key, with the mean over all its rows."""
    w = W.partitionBy(key)
    ranked = df.withColumn("age", F.row_number().over(w.orderBy(*order_newest_first))).withColumn("mean_all", F.avg("value").over(w))
    return ranked.where(F.col("age") <= n)


def streak_with_freezes(days: DataFrame, key: str, day: str, today: str, monthly: int = 2) -> DataFrame:
    """Current and best streak where up to `monthly` missed days of a calendar month are paid by freezes.

    days: distinct active days. A fold over each key's sorted days, in the JVM: the state is (last day, run, best, month,
    freezes left). A gap of g missed days is bridged when the freezes left in the month of the day after it cover g; a
    new month restores the allowance. The current run is void when the days missed up to the day before `today` exceed
    what is left. A key's days are as many as its days of activity, not its events.
    """
    listed = days.groupBy(key).agg(F.sort_array(F.collect_set(day)).alias("days"))
    month = lambda d: F.year(d) * 12 + F.month(d)
    zero = F.struct(
        F.lit(None).cast("date").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("month"), F.lit(monthly).alias("left")
    )

    def step(s: Column, d: Column) -> Column:
        left = F.when(month(d) == s["month"], s["left"]).otherwise(F.lit(monthly))
        gap = F.datediff(d, s["last"]) - 1
        holds = s["last"].isNotNull() & (gap <= left)
        run = F.when(holds, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(
            d.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"), month(d).alias("month"), F.when(holds, left - gap).otherwise(left).alias("left")
        )

    folded = listed.select(key, F.aggregate("days", zero, step).alias("s"))
    missed = F.datediff(F.lit(today).cast("date"), F.col("s.last")) - 1
    left = F.when(month(F.lit(today).cast("date")) == F.col("s.month"), F.col("s.left")).otherwise(F.lit(monthly))
    return folded.select(key, F.when(missed <= left, F.col("s.run")).otherwise(F.lit(0)).alias("current"), F.col("s.best").alias("best"))
