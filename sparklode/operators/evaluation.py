"""Retrieval metrics from rankings (query_id, id, rank) and truth (query_id, id) or graded labels (query_id, id, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(rankings: DataFrame, truth: DataFrame, ks: list[int], index: DataFrame | None = None) -> DataFrame:
    """recall@k, mrr@10 and binary ndcg@10 of each query that has truth; `unreachable` when none of it is in the index."""
    hits = truth.join(rankings, ["query_id", "id"], "left")
    if index is not None:
        hits = hits.join(index.select("id", F.lit(True).alias("indexed")), "id", "left")
    reach = F.bool_or(F.coalesce("indexed", F.lit(False))) if index is not None else F.lit(True)
    gain = F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    found = hits.groupBy("query_id").agg(
        F.count("*").alias("relevant"),
        *[(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks],
        F.coalesce(1 / F.min(F.when(F.col("rank") <= 10, F.col("rank"))), F.lit(0.0)).alias("mrr_10"),
        gain.alias("dcg"),
        (~reach).alias("unreachable"),
    )
    return found.withColumn("ndcg_10", F.col("dcg") / ideal).drop("dcg")


def means(cases: DataFrame, ks: list[int]) -> DataFrame:
    """Averages over queries, the gap between the deepest and the shallowest recall, and the unreachable share."""
    columns = [*(f"recall_{k}" for k in ks), "mrr_10", "ndcg_10"]
    out = cases.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 9).alias(c) for c in columns], F.round(F.avg(F.col("unreachable").cast("int")), 9).alias("unreachable"))
    return out.withColumn("gap", F.round(F.col(f"recall_{ks[-1]}") - F.col(f"recall_{ks[0]}"), 9))


def graded(rankings: DataFrame, labels: DataFrame, counts: DataFrame, k: int, good: int) -> DataFrame:
    """precision@k (unlabelled counts as bad), precision among labelled (null without any), labelled share, graded ndcg@k, and whether three are good.

    labels: (query_id, id, label) of the rows shown. counts: (query_id, counts), how many rows each query has of the highest
    label, the next, and so on down to 1; the perfect list is made of them."""
    shown = rankings.where(F.col("rank") <= k).join(labels, ["query_id", "id"], "left")
    ok = F.col("label") >= good
    gain = lambda label, place: (F.pow(F.lit(2.0), label) - 1) / F.log2(place + 1)
    scored = shown.groupBy("query_id").agg(
        (F.count_if(ok) / F.count("*")).alias("precision"),
        F.try_divide(F.count_if(ok), F.count("label")).alias("precision_labelled"),
        (F.count("label") / F.count("*")).alias("labelled_share"),
        F.sum(F.coalesce(gain(F.col("label"), F.col("rank")), F.lit(0.0))).alias("dcg"),
        (F.count_if(ok) >= 3).alias("three_good"),
    )
    best = F.slice(F.flatten(F.transform("counts", lambda n, j: F.array_repeat(F.size("counts") - j, F.least(n, F.lit(k)).cast("int")))), 1, k)
    ideal = F.aggregate(F.transform(best, lambda label, place: gain(label, place + 1)), F.lit(0.0), lambda s, x: s + x)
    joined = scored.join(counts.select("query_id", ideal.alias("ideal")), "query_id", "left")
    return joined.withColumn("ndcg", F.coalesce(F.try_divide(F.col("dcg"), F.col("ideal")), F.lit(0.0))).drop("dcg", "ideal")


def anchor_recall(rankings: DataFrame, anchors: DataFrame, ks: list[int]) -> DataFrame:
    """(k, recall): the share of anchors (query_id, id), one a query, that stand among the first k; none is no anchors at all."""
    found = anchors.join(rankings, ["query_id", "id"], "left")
    shares = [F.struct(F.lit(k).alias("k"), F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")).alias("recall")) for k in ks]
    return found.agg(*[s.alias(f"s{j}") for j, s in enumerate(shares)]).select(F.explode(F.array(*[F.col(f"s{j}") for j in range(len(ks))])).alias("x")).select("x.*")


def merged_judges(first: DataFrame, second: DataFrame, rule: str) -> DataFrame:
    """Two judges' labels, 0 to 2, by `consensus` (1, disputed, where they differ), `lenient` (the larger) or `strict` (the smaller).

    A pair that one judge alone has seen keeps that label and is `partial`; `disagreement` doesn't depend on the rule.
    """
    a, b = first.withColumnRenamed("label", "la"), second.withColumnRenamed("label", "lb")
    both = a.join(b, ["query_id", "id"], "full")
    alone = F.coalesce("la", "lb")
    pick = {"consensus": F.when(F.col("la") == F.col("lb"), F.col("la")).otherwise(1), "lenient": F.greatest("la", "lb"), "strict": F.least("la", "lb")}[rule]
    partial = F.col("la").isNull() | F.col("lb").isNull()
    return both.select("query_id", "id", F.when(partial, alone).otherwise(pick).alias("label"), partial.alias("partial"), F.coalesce(F.col("la") != F.col("lb"), F.lit(False)).alias("disagreement"))


def agreement(machine: DataFrame, manual: DataFrame, key: str, disputed: int) -> DataFrame:
    """Exact share over common keys, and the share after dropping pairs where either label is `disputed`."""
    both = machine.select(key, F.col("label").alias("la")).join(manual.select(key, F.col("label").alias("lb")), key)
    clear = (F.col("la") != disputed) & (F.col("lb") != disputed)
    same = F.col("la") == F.col("lb")
    return both.agg(F.count("*").alias("common"), F.round(F.avg(same.cast("int")), 9).alias("exact"), F.round(F.avg(F.when(clear, same.cast("int"))), 9).alias("binary"))
