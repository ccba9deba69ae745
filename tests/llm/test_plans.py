"""What the numbered operators and the pipeline send to every task, by their plans."""

from __future__ import annotations

import pytest

from sparklode.llm import exact, packing, simhash
from sparklode.operators.graph import connected_components
from sparklode.sources.scratch import Scratch


@pytest.fixture
def plans(monkeypatch):
    """The plans of all scratch tables written, as Spark starts them."""
    seen: list[str] = []
    keep = Scratch.keep

    def told(self, df, name):
        seen.append(plan_of(df))
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", told)
    return seen


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_broadcast_nothing(spark, plans):
    """Tables of keys, links and classes grow with the input; however small they are, none is broadcast."""
    texts = [f"the quick brown fox number {k // 3} jumps over the lazy dog again and again" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = simhash.near_duplicate_classes(docs)
    plans.append(plan_of(out))
    assert {r["component_id"] for r in out.collect()} and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p]


def test_components_broadcast_nothing(spark, plans):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
    assert {r["root"] for r in connected_components(edges, "a", "b").collect()} == {0}
    assert not [p for p in plans if "BroadcastHashJoin" in p]

def test_hashes_and_places_are_not_broadcast(spark, plans):
    docs = spark.createDataFrame([(k, f"text {k % 7}") for k in range(20)], "doc_id long, text string")
    out = exact.duplicate_groups(docs)
    assert sorted(r["group_size"] for r in out.collect()) == [2] * 2 + [3] * 18
    # The directory has a bound and is broadcast, by its prefix.
    joins = [line for p in [*plans, plan_of(out)] for line in p.split("\n") if "BroadcastHashJoin" in line and "[prefix#" not in line and "[depth#" not in line]
    assert not joins
    pieces = spark.createDataFrame([(k, 0, 0, 100 + k) for k in range(50)], "doc_id long, piece int, start long, length long")
    packed = packing.pack_pieces(pieces)
    assert packed.count() == 50 and "BroadcastHashJoin" not in plan_of(packed)
