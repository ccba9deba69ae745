"""The bound that spares most pairs of near_dup_gate their texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparklode.functions import text as T

RNG = random.Random(11)
LONG = " ".join(RNG.choices(["wall", "tree", "né", "日本", "x" * 9, "😀b", "1,5"], k=400))
TEXTS = ["", "a", "ab", "ba", "abc", "abcabcabc", "ééé", LONG, LONG[:-7] + "end", LONG[: len(LONG) // 2], LONG[::-1], "".join(RNG.choices("abcdefghij", k=3000)), None]


def test_bound_is_never_below_jaccard(spark):
    """All pairs of odd texts; equal texts have a bound of one, and unlike ones are told apart without their texts."""
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").select("*", T.trigram_sketch("t").alias("s"))
    both = rows.alias("a").crossJoin(rows.alias("b"))
    bound = T.trigram_bound(F.col("a.s.n"), F.col("a.s.bits"), F.col("b.s.n"), F.col("b.s.bits"))
    got = both.select(F.col("a.k").alias("x"), F.col("b.k").alias("y"), bound.alias("most")).collect()
    assert len(got) == len(TEXTS) ** 2
    pruned = 0
    for r in got:
        x, y = TEXTS[r["x"]], TEXTS[r["y"]]
        if x is None or y is None:
            assert r["most"] is None
            continue
        exact = T.trigram_jaccard_of(x, y)
        assert exact - 1e-12 <= r["most"] <= 1 and (x != y or r["most"] == pytest.approx(1))
        pruned += r["most"] < 0.8
    assert pruned > len(TEXTS) ** 2 / 2


def test_sketch_counts_trigrams():
    assert [T.trigram_sketch_of(t)[0] for t in TEXTS if t is not None] == [len({t[i : i + 3] for i in range(len(t) - 2)} or {t}) for t in TEXTS if t is not None]
