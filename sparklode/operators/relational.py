"""Faceted filtering, relational division, semi- and anti-joins, and comparisons between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Facets:
    """Filter groups: OR inside a group, AND between groups.

    columns: group -> (column, accepted values) on the table itself.
    links: group -> (link table, id column, value column, accepted values), matched by existence.
    """

    columns: Mapping[str, tuple[str, Sequence]] = field(default_factory=dict)
    links: Mapping[str, tuple[DataFrame, str, str, Sequence]] = field(default_factory=dict)

    def apply(self, df: DataFrame, id_col: str, skip: str | None = None) -> DataFrame:
        """Rows that satisfy all groups but `skip`; a link never multiplies rows."""
        for name, (column, values) in self.columns.items():
            if name != skip and values:
                df = df.where(F.col(column).isin(list(values)))
        for name, (link, link_id, value, values) in self.links.items():
            if name != skip and values:
                chosen = link.where(F.col(value).isin(list(values))).select(F.col(link_id).alias(id_col))
                df = df.join(chosen, id_col, "left_semi")
        return df

    def counts(self, df: DataFrame, id_col: str, facet: str, column: str) -> DataFrame:
        """Drill-sideways counts of a facet: its own filter is left out, nulls are no option."""
        return facet_counts(self.apply(df, id_col, skip=facet), id_col, column)


def facet_counts(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """Distinct entities per option."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("option")).agg(F.countDistinct(id_col).alias("n"))


def options_with_zero(corpus: DataFrame, filtered: DataFrame) -> DataFrame:
    """Options come from the corpus counts, numbers from the filtered ones; empty options stay, flagged."""
    joined = corpus.select("option").join(filtered, "option", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("is_zero", F.col("n") == 0)


def having_all(link: DataFrame, id_col: str, value: str, wanted: Sequence) -> DataFrame:
    """Relational division: ids linked with every wanted value."""
    hit = link.where(F.col(value).isin(list(wanted)))
    return hit.groupBy(id_col).agg(F.countDistinct(value).alias("__n")).where(F.col("__n") == len(set(wanted))).select(id_col)


def not_in(column: str, values: Sequence) -> Column:
    """NOT IN that treats null as an ordinary unlisted value."""
    return ~F.coalesce(F.col(column).isin(list(values)), F.lit(False))


def visible_by_coverage(df: DataFrame, key: str, gated: Sequence[str], least: float) -> DataFrame:
    """Keys with their share of rows; a gated key has to reach `least`, others always pass."""
    share = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(max(1, df.count())))
    return share.where(~F.col(key).isin(list(gated)) | (F.col("share") >= least))


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys of both tables where any column differs, null being equal to empty."""
    a, b = old.alias("a"), new.alias("b")
    differs = F.lit(False)
    for c in columns:
        differs = differs | (F.coalesce(F.col(f"a.{c}").cast("string"), F.lit("")) != F.coalesce(F.col(f"b.{c}").cast("string"), F.lit("")))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).where(differs).select(F.col(f"a.{key}").alias(key))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of exactly one table, with the side they are on."""
    left = a.subtract(b).withColumn("side", F.lit("a"))
    return left.unionByName(b.subtract(a).withColumn("side", F.lit("b")))


def two_level_join(left: DataFrame, right: DataFrame, exact: str, normalised: str, id_col: str) -> DataFrame:
    """Match on the exact key first and what is left on the normalised key; `level` says which. Ties: the smallest right id."""
    by_exact = right.groupBy(exact).agg(F.min(id_col).alias("match_id"))
    by_normal = right.groupBy(normalised).agg(F.min(id_col).alias("match_id"))
    hit = left.join(by_exact, exact).withColumn("level", F.lit("exact"))
    rest = left.join(by_exact, exact, "left_anti").join(by_normal, normalised).withColumn("level", F.lit("normalised"))
    return hit.unionByName(rest)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on a composite key whose parts may be null and then have to be null on both sides."""
    r = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(r, condition, how).drop(*[f"__{k}" for k in keys])


def unique_owner(links: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that exactly one owner uses."""
    found = links.where(F.col(owner).isNotNull()).groupBy(key).agg(F.countDistinct(owner).alias("__n"), F.min(owner).alias(owner))
    return found.where("__n = 1").drop("__n")


def wildcard_conflicts(left: DataFrame, right: DataFrame, item: str, keys: Sequence[str], stage: str) -> DataFrame:
    """Items whose keys on both sides do not agree: some key of either side has no partner on the other.

    Two keys agree when `keys` are equal and the stages are equal or one of them is empty.
    """
    a, b = left.alias("a"), right.alias("b")
    agree = (F.col(f"a.{item}") == F.col(f"b.{item}")) & ((F.col(f"a.{stage}") == F.col(f"b.{stage}")) | (F.col(f"a.{stage}") == "") | (F.col(f"b.{stage}") == ""))
    for k in keys:
        agree = agree & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    shared = left.select(item).distinct().intersect(right.select(item).distinct())
    alone = a.join(b, agree, "left_anti").select(item).unionByName(b.join(a, agree, "left_anti").select(item))
    return shared.join(alone.distinct(), item, "left_semi")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of the ordered rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def seeded_sample(df: DataFrame, id_col: str, seed: int, k: int) -> DataFrame:
    """`k` rows that depend on nothing but ids and seed."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(k)


def fill_in_order(preferred: DataFrame, others: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first `k` rows with all of `preferred` before any of `others`."""
    both = preferred.withColumn("priority", F.lit(0)).unionByName(others.withColumn("priority", F.lit(1)))
    return both.orderBy("priority", *order).limit(k)


def missing_both_ways(left: DataFrame, of_left: DataFrame, of_right: DataFrame, right: DataFrame, same: Column, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """(side, id): rows of `left` without a partner in `of_left`, and rows of `right` without one in `of_right`; first and second are (side, id column)."""
    ours = left.join(of_left, same, "left_anti").select(F.lit(first[0]).alias("side"), F.col(first[1]).alias("id"))
    theirs = right.join(of_right, same, "left_anti").select(F.lit(second[0]).alias("side"), F.col(second[1]).alias("id"))
    return ours.unionByName(theirs)


def flag_changes(df: DataFrame, critical: Column, spared: Column, flagged: Column) -> DataFrame:
    """The rows whose flag must change, with `action` flag or unflag; a null is no."""
    critical, spared, flagged = (F.coalesce(c, F.lit(False)) for c in (critical, spared, flagged))
    wanted = critical & ~spared
    return df.where(wanted != flagged).withColumn("action", F.when(wanted, "flag").otherwise("unflag"))
