"""Connected components over an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.sources.scratch import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung below the node's smallest neighbour."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return around.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung below the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of `edges`, the smallest node it can reach. Self-loops and repeats are harmless.

    Each round is one large star and one small star, two shuffles each, with the partial minimum taken before the
    shuffle; a hub is only a key of a join that adaptive execution splits. Rounds grow with the logarithm of the
    longest path. Every round's edges are written to the shared folder, so no lineage builds up; what is joined grows with
    them, so it is shuffled at every size and never broadcast. Null ends are ignored; an edge table without edges gives no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    start = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = scratch.keep(start.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct(), "0")
    before = None
    for k in range(1, max_rounds + 1):
        now = scratch.keep(_small_star(_large_star(now)), str(k))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        scratch.drop(str(k - 1))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
