"""What the similarity join shuffles, and that its order and its bitmap lose nothing."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sparklode.operators import setjoin
from sparklode.sources.scratch import Scratch


def _sets(spark, rng):
    sets = {k: set(rng.sample(range(5000), 20)) | set(range(9000, 9000 + 12 * (k % 4))) for k in range(200)}
    sets |= {1000 + k: set(sets[k]) - set(rng.sample(sorted(sets[k]), 1)) for k in range(0, 200, 3)}
    return sets, spark.createDataFrame([(k, [str(x) for x in sorted(s)]) for k, s in sets.items()], "id long, set array<string>")


def test_sets_are_ordered_where_they_are(spark, monkeypatch):
    """Only tokens of prefixes are shuffled, never whole sets; no join that grows is a broadcast, whatever Spark makes of its size."""
    plans, keep = {}, Scratch.keep

    def told(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", told)
    _, rows = _sets(spark, random.Random(4))
    assert setjoin.similar_sets(rows, 0.8).count() > 60
    assert "Exchange" not in plans["ordered"]
    assert "slice(tokens" in plans["prefixes"] and "BroadcastHashJoin" not in plans["prefixes"] and "BroadcastHashJoin" not in plans["candidates"]


@pytest.mark.parametrize("most", [0, 7, 1 << 18])
def test_any_number_of_common_tokens(spark, monkeypatch, most):
    """Which tokens count as common decides the order alone: the pairs are all pairs, each once."""
    monkeypatch.setattr(setjoin, "COMMON", most)
    monkeypatch.setattr(setjoin, "COUNTED", 2)
    sets, rows = _sets(spark, random.Random(5))
    got = [(r["a"], r["b"]) for r in setjoin.similar_sets(rows, 0.8).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(got) == len(want) and set(got) == want


def test_among_loses_none(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "SLOTS", 1 << 16)
    rows, ids = spark.range(5000), spark.createDataFrame([(int(k),) for k in np.arange(0, 6000, 50)] * 2, "id long")
    got = [r["id"] for r in setjoin.among(rows, ids).collect()]
    assert len(got) == len(set(got)) and set(range(0, 5000, 50)) <= set(got) and len(got) < 200
    assert setjoin.among(rows, ids.limit(0)).count() == 0
