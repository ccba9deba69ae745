"""Duplicate groups with gates, choice of representatives, and what follows from groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.operators.graph import connected_components


def star_edges(df: DataFrame, id_col: str, keys: Sequence[Column]) -> DataFrame:
    """(a, b): every member of a key's group tied to its smallest id: n - 1 edges instead of all pairs. Null or empty keys are no group."""
    named = df.select(F.col(id_col).alias("b"), *[k.cast("string").alias(f"k{i}") for i, k in enumerate(keys)])
    names = [f"k{i}" for i in range(len(keys))]
    usable = F.lit(True)
    for n in names:
        usable = usable & (F.coalesce(F.col(n), F.lit("")) != "")
    named = named.where(usable)
    least = named.groupBy(*names).agg(F.min("b").alias("a"))
    return named.join(least, names).where("a <> b").select("a", "b")


def parts_key(parts: Column) -> Column:
    """Digest of ordered parts, each (statement, answer): rows that share a header but not their parts differ in it."""
    return F.md5(F.array_join(F.transform(parts, lambda p: F.concat_ws("|", p["statement"], p["answer"])), " "))


def groups(edges: DataFrame) -> DataFrame:
    """(id, root, group_id) of components with at least two members; group_id is independent of the edges' order."""
    members = connected_components(edges, "a", "b").withColumnRenamed("node", "id")
    # The digest of the smallest id and the size stands for the sorted list of ids, which may be long.
    sizes = members.groupBy("root").agg(F.count("*").alias("members"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mix"))
    named = sizes.select("root", "members", F.concat(F.lit("d"), F.substring(F.md5(F.concat_ws(",", "root", "members", "mix")), 1, 16)).alias("group_id"))
    return members.join(named, "root").select("id", "root", "members", "group_id")


def text_groups(df: DataFrame, id_col: str, text: Column, least: int) -> DataFrame:
    """(root, members): groups of at least two equal texts of at least `least` characters, by their digest."""
    keyed = df.where(F.length(text) >= least).select(F.col(id_col).alias("id"), F.sha1(text).alias("digest"))
    return keyed.groupBy("digest").agg(F.min("id").alias("root"), F.count("*").alias("members")).where("members > 1")


def representatives(members: DataFrame, group: str, id_col: str, score: Sequence[Column]) -> DataFrame:
    """(group, id, rule): each group's member with the best scores, ties by the smallest id, and the rule that decided.

    The rule is `only` for groups of one, `score` where the first score is larger than anyone else's, else `tie`. Ids are
    numbers. Members are counted by group and first score where they are read, so a large group is no one task's work.
    """
    rest = F.struct(*[s.alias(f"s{k}") for k, s in enumerate(score[1:])], (-F.col(id_col)).alias("less"), F.col(id_col).alias("id"))
    by_score = members.groupBy(F.col(group), score[0].alias("__first")).agg(F.count("*").alias("__n"), F.max(rest).alias("__best"))
    top = F.max(F.struct(F.col("__first"), F.col("__n"), F.col("__best")))
    whole = by_score.groupBy(group).agg(F.sum("__n").alias("__size"), top.alias("__top"))
    rule = F.when(F.col("__size") == 1, "only").when(F.col("__top.__n") == 1, "score").otherwise("tie")
    return whole.select(group, F.col("__top.__best.id").alias(id_col), rule.alias("rule"))


def chosen(members: DataFrame, margin: int = 2) -> DataFrame:
    """(grp, id, rule, completeness, second) of members (grp, id, completeness, approved): which member stands for its group.

    One approved member stands for it; else the most complete one, if no other comes within `margin`; else nobody does and the group
    is left to a person, with the most complete member of the smallest id as a proposal. Completeness has few values, so a
    group is counted by them."""
    levels = members.groupBy("grp", "completeness").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.count_if("approved").alias("yes"), F.min(F.when(F.col("approved"), F.col("id"))).alias("ok"))
    whole = levels.groupBy("grp").agg(F.sum("yes").alias("yes"), F.min("ok").alias("ok"), F.reverse(F.array_sort(F.collect_list(F.struct("completeness", "n", "least")))).alias("by"))
    best, next_ = F.get("by", F.lit(0)), F.get("by", F.lit(1))
    second = F.when(best["n"] > 1, best["completeness"]).otherwise(next_["completeness"])
    rule = F.when(F.col("yes") == 1, "approved").when(second.isNull() | (best["completeness"] - second >= margin), "margin").otherwise("human")
    return whole.select("grp", F.when(F.col("yes") == 1, F.col("ok")).otherwise(best["least"]).alias("id"), rule.alias("rule"), best["completeness"].alias("completeness"), second.alias("second"))


def without_conflicts(matches: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(candidate, anchor) of the candidates no two of whose anchors conflict: on each key the anchors that have one (a null agrees with
    anything) have the same. Agreement isn't transitive over nulls, so anchors are compared all together, by counting keys."""
    joined = matches.join(anchors.withColumnRenamed("id", "anchor"), "anchor")
    counted = joined.groupBy("candidate").agg(*[(F.min(k) != F.max(k)).alias(f"__{j}") for j, k in enumerate(keys)])
    clash = F.lit(False)
    for j in range(len(keys)):
        clash = clash | F.coalesce(F.col(f"__{j}"), F.lit(False))
    return matches.join(counted.where(clash).select("candidate"), "candidate", "left_anti").select("candidate", "anchor")


def collapse(ranked: DataFrame, id_col: str, group: str, rank: str, favourite: str) -> DataFrame:
    """(id, position): one result per duplicate group, its favourite if it is among the results, else the best-ranked; ids without a
    group stay. position is the group's best rank."""
    key = F.coalesce(F.concat(F.lit("group-"), F.col(group).cast("string")), F.concat(F.lit("own-"), F.col(id_col).cast("string")))
    first = F.min(F.struct((~F.coalesce(F.col(favourite), F.lit(False))).alias("other"), F.col(rank).alias("rank"), F.col(id_col).alias("id")))
    return ranked.groupBy(key.alias("__key")).agg(first.alias("__best"), F.min(rank).alias("position")).select(F.col("__best.id").alias(id_col), "position")


def bands(similarity: Column, duplicate: float, hidden: float) -> Column:
    return F.when(similarity >= duplicate, "duplicate").when(similarity >= hidden, "hidden").otherwise("distinct")
