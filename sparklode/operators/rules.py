"""Row-level rules: visibility, roles, quotas, conditions, classifications, and merging by wildcard keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklode.operators.graph import connected_components


def visible(df: DataFrame, gate: str, published: Column, flagged: Column, usable: Column, hidden: Column) -> DataFrame:
    """Rows a visitor may see: published, not flagged, with usable content; behind the gate `catalog` hidden rows go too. A null is no."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    shown = sure(published) & ~sure(flagged) & sure(usable)
    return df.where(shown & ~sure(hidden) if gate == "catalog" else shown)


def reviewed_only(df: DataFrame, strict: bool, active: bool, reviewed: Column) -> DataFrame:
    """The second filter: rows not reviewed are hidden when the filter is active and strict."""
    return df.where(F.coalesce(reviewed, F.lit(False))) if active and strict else df


def seen_by_role(role: str, public: Column, own: Column, group: Column) -> Column:
    """Guests see public rows, students their own too, tutors those of their group, superusers all; other roles see none."""
    known = {"guest": public, "student": public | own, "tutor": public | own | group, "superuser": F.lit(True)}
    return F.coalesce(known.get(role, F.lit(False)), F.lit(False))


def counter_before(counts: Column, *keys: str, order: Sequence[Column]) -> Column:
    """How many counted rows of the same keys came before a row."""
    return F.coalesce(F.sum(counts.cast("int")).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def condition_met(kind: Column, value: Column, facts: Column) -> Column:
    """Whether the fact named by a condition reaches its value; a condition of unknown kind is not met."""
    return F.coalesce(F.try_element_at(facts, kind) >= value, F.lit(False))


def wildcard_groups(rows: DataFrame, key: str, a: str, b: str, id_col: str) -> DataFrame:
    """(id, root): rows of one key whose attributes agree, a null agreeing with anything, and what hangs together through them.

    Edges are stars, never pairs: full rows (a, b) meet the first row (null, b) and the first (a, null); rows with a null
    in either place all agree with each other across the two kinds; a row of two nulls agrees with every row of its key.
    Rows that agree in full meet through their first. A row without a key stays alone. The result does not depend on the order of rows.
    """
    slim = rows.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(a).alias("a"), F.col(b).alias("b"))
    no_a, no_b = F.col("a").isNull(), F.col("b").isNull()
    kinds = {"full": ~no_a & ~no_b, "only_b": no_a & ~no_b, "only_a": ~no_a & no_b, "none": no_a & no_b}
    of = {name: slim.where(where) for name, where in kinds.items()}

    def first(name: str, *by: str) -> DataFrame:
        return of[name].groupBy(*by).agg(F.min("id").alias("hub"))

    def star(members: DataFrame, hubs: DataFrame, *by: str) -> DataFrame:
        return members.join(hubs, list(by)).select("id", "hub")

    edges = [
        star(of["full"], first("full", "key", "a", "b"), "key", "a", "b"),
        star(slim.where(~no_b), first("only_b", "key", "b"), "key", "b"),
        star(slim.where(~no_a), first("only_a", "key", "a"), "key", "a"),
        star(of["only_b"], first("only_a", "key"), "key"),
        star(of["only_a"], first("only_b", "key"), "key"),
        star(slim, first("none", "key"), "key"),
    ]
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    roots = connected_components(every, "id", "hub")
    return slim.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
