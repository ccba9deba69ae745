"""Which filter removes what, alone and in every order.

Filters of a whole text (null: empty; words are maximal runs without ASCII white space): A fails under `MIN_WORDS` words; B
when fewer than `MIN_DISTINCT` in a hundred words are distinct; C when more than `MAX_UPPER` in a hundred code points are
A-Z; D when the text holds any of `#$%&*|`; E when a smaller doc_id has the identical text anywhere in the table.

A document's failures are a mask. The audit needs nothing but the number of documents by part and mask, at most 2^filters
rows a part. The subset-zeta transform of these counts gives the survivors of every set of filters at once; what a step
removes in any order is the difference between two neighbouring sets, and likewise for the counts of labelled documents.

E needs no document twice: rows of one text, part and label are counted where they were read, so that a group of copies
is a few rows, and only the rows at the text's smallest doc_id pass. Rows without a doc_id are no one's smaller copy and have
none. Rows that share the smallest doc_id pass all. A doc_id with several labels counts as good, or toxic, if any row says
so; missing labels count as 0. Texts are equal when their SHA-256 is. A null part is the empty string. Other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.sources.scratch import Scratch

FILTERS = ("A", "B", "C", "D", "E")
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10
WHITE = " \t\n\x0b\x0c\r"
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Whether filters A to D fail on a text that is not null."""
    body = F.trim(text, F.lit(WHITE))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[\\x20\\x09-\\x0D]+"))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return [
        n < MIN_WORDS,
        100 * distinct < MIN_DISTINCT * n,
        100 * upper > MAX_UPPER * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def labelled_groups(docs: DataFrame, labels: DataFrame, part_col: str) -> DataFrame:
    """(text, part, mask, good, toxic, n, missing, low, n_low): rows of one text, by part and label.

    text is a digest and mask has A to D; n rows, of which `missing` have no doc_id and n_low have the smallest, `low`."""
    body = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), body.alias("text"))
    mask = sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(text_failures(F.col("text")))), F.lit(0))
    # Rows without an id match no label; a number of their own keeps them from meeting in one task.
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    slim = facts.select("doc_id", "part", own.alias("own"), mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("text"))
    said = {name: F.max(F.coalesce(F.col(column) == 1, F.lit(False))).alias(name) for name, column in (("good", "quality"), ("toxic", "toxic"))}
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*said.values())
    marked = slim.join(marks.withColumn("own", F.lit(0).cast("long")), ["doc_id", "own"], "left").fillna(False, ["good", "toxic"])
    same = ("text", "part", "mask", "good", "toxic")
    by_id = marked.groupBy("doc_id", "own", *same).agg(F.count("*").alias("n"))
    return by_id.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.min("doc_id").alias("low"),
        F.min_by("n", "doc_id").alias("n_low"),
    )


def mask_counts(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents fail just the filters of `mask`, and how many of them are labelled so.

    docs has doc_id, text and the part; labels has doc_id, quality and toxic."""
    groups = Scratch(docs.sparkSession, "filteraudit").keep(labelled_groups(docs, labels, part_col), "groups")
    lowest = groups.groupBy("text").agg(F.min("low").alias("lowest"))
    first = F.when(F.col("low") == F.col("lowest"), F.col("n_low")).otherwise(0)
    held = groups.join(lowest, "text").withColumn("passes", F.col("missing") + F.coalesce(first, F.lit(0)))
    repeated = len(text_failures(F.lit("")))
    both = F.explode(
        F.array(
            F.struct(F.col("mask"), F.col("passes").alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(1 << repeated)).alias("mask"), (F.col("n") - F.col("passes")).alias("n")),
        )
    )
    each = held.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    sums = [F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in COUNTS[1:])]
    return each.groupBy("part", "mask").agg(*sums)


def survivors(counts: np.ndarray) -> np.ndarray:
    """For every set S of filters how many documents fail none of S, from counts by mask: the zeta transform at S's complement."""
    filters = len(counts).bit_length() - 1
    inside = counts.reshape([2] * filters)
    for axis in range(filters):
        inside = np.cumsum(inside, axis=axis)
    return inside.reshape(-1)[::-1]


def order_effects(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray, names: Sequence[str] = FILTERS) -> pd.DataFrame:
    """One row per order of the filters and step, from one part's counts by mask."""
    orders = np.array(list(itertools.permutations(range(len(names)))))
    after = np.cumsum(1 << orders, axis=1)
    before = after - (1 << orders)
    masks = np.arange(len(counts))
    left = survivors(counts)
    removed = left[before] - left[after]
    failing = np.array([counts[masks >> k & 1 == 1].sum() for k in range(len(names))])
    shapley = np.zeros(len(names), np.int64)
    np.add.at(shapley, orders, removed)

    def lost(of: np.ndarray) -> np.ndarray:
        alive = survivors(of)
        return alive[before] - alive[after]

    steps = np.broadcast_to(np.arange(1, len(names) + 1, dtype=np.int32), orders.shape)
    columns = {
        "step": steps,
        "kept": left[after],
        "removed": removed,
        "redundant": failing[orders] - removed,
        "unique_fails": counts[1 << orders],
        "good_lost": lost(good),
        "toxic_lost": lost(toxic),
        "shapley": shapley[orders],
    }
    spelled = np.repeat(["".join(names[k] for k in order) for order in orders], len(names))
    return pd.DataFrame({"filter_order": spelled} | {k: v.reshape(-1) for k, v in columns.items()})


def filter_order_audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part,
    order of the five filters and step, zeros included."""
    cells = F.collect_list(F.struct("mask", *COUNTS)).alias("cells")
    by_part = mask_counts(docs, labels, part_col).groupBy("part").agg(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for part, held in zip(rows["part"], rows["cells"]):
                table = np.zeros((len(COUNTS), 1 << len(FILTERS)), np.int64)
                for cell in held:
                    table[:, cell["mask"]] = [cell[c] for c in COUNTS]
                effects = order_effects(*table)
                effects.insert(0, "part", part)
                yield effects

    longs = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return by_part.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))
