"""Repeated keys, titles beyond ASCII, and searches and joins in blocks."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparklode.functions import checks
from sparklode.functions import text as T
from sparklode.llm import packing
from sparklode.operators import neighbours, search, setjoin, snapshot
from sparklode.plans import similar
from sparklode.sources.scratch import Scratch
from tests.conftest import SMALL


def _rows(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_title_fault_as_in_sql(spark):
    spaces = [chr(c) for c in (0x9, 0xB, 0xD, 0x85, 0xA0, 0x1680, 0x2007, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    titles = ["modèle", "éla", "x_le", "a la", "table", "7 of", "ob,", "éé"] + [f"{s}ab of{s}" for s in spaces] + [f"ab{s}" for s in spaces]
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", checks.title_fault(F.col("t"), F.lit("")).alias("f"))
    ours = {r["t"]: r["f"] for r in got.collect()}
    for title in titles:
        bare = "trim($1)"
        sql = rf"select case when regexp_matches({bare}, '(,|\b(of|in|for|the|de|la|le|el))$') then 'trailing' when length({bare}) < 3 or not regexp_matches({bare}, '[A-Za-zÀ-ÿ]') then 'junk' end"
        assert ours[title] == duckdb.execute(sql, [title]).fetchone()[0], repr(title)


OLD = [(1, "a"), (2, "b"), (3, None), (4, "d"), (5, "e"), (6, "f")]
NEW = [(1, "a"), (1, "a"), (2, "b"), (2, "x"), (3, None), (4, "y"), (4, "z"), (6, "f"), (7, "n"), (7, "n")]


def _versions(spark):
    return spark.createDataFrame(OLD, "k long, v string"), spark.createDataFrame(NEW, "k long, v string")


def test_load_plan_with_repeated_keys(spark):
    old, new = _versions(spark)
    plan = snapshot.load_plan(old, new, "k", ["v"], old.where("false").select("k"))
    wanted = [(1, "same"), (1, "same"), (2, "same"), (2, "update"), (3, "same"), (4, "update"), (4, "update"), (5, "delete"), (6, "same"), (7, "create"), (7, "create")]
    assert _rows(plan.select("k", "action")) == wanted
    now = snapshot.applied(old, new, plan, "k")
    again = snapshot.load_plan(now, new, "k", ["v"], old.where("false").select("k"))
    assert _rows(again.groupBy("action").count()) == [("same", len(NEW))]


def test_load_plan_counts_pairs(spark):
    """Several old rows of a key are each compared with each new one, as in SQL's full join; a load that is done changes nothing."""
    old = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, "c"), (3, "d"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (4, "n"), (4, "n")], "k long, v string")
    sql = "select coalesce(o.k, n.k) k, case when o.k is null then 'create' when n.k is null then 'delete' when o.v is distinct from n.v then 'update' else 'same' end a from o full join n on o.k = n.k"
    con = duckdb.connect()
    for name, frame in (("o", old), ("n", new)):
        con.register(name, frame.toPandas())
    none = old.where("false").select("k")
    plan = snapshot.load_plan(old, new, "k", ["v"], none)
    assert _rows(plan.select("k", "action")) == sorted(con.execute(sql).fetchall(), key=str)
    now = snapshot.applied(old, new, plan, "k")
    assert _rows(snapshot.load_plan(now, new, "k", ["v"], none)) == _rows(new.select("k", F.lit("same"), F.lit("")))


def test_applied_with_repeated_keys(spark):
    old, new = _versions(spark)
    assert _rows(snapshot.applied(old, new, snapshot.diff(old, new, "k", ["v"]), "k")) == sorted(NEW, key=str)
    assert _rows(snapshot.applied(new, old, snapshot.diff(new, old, "k", ["v"]), "k")) == sorted(OLD, key=str)
    held = spark.createDataFrame([(7,)], "k long")
    assert _rows(snapshot.applied(new, old, snapshot.diff(new, old, "k", ["v"], held), "k")) == sorted([*OLD, (7, "n"), (7, "n")], key=str)


def test_reverted_with_repeated_keys(spark):
    old, new = _versions(spark)
    now = new.withColumn("v", F.when(F.col("k") == 4, "edited").otherwise(F.col("v")))
    wanted = [(1, "a", False)] * 2 + [(2, "b", False)] * 2 + [(3, None, False)] + [(4, "edited", True)] * 2 + [(6, "f", False)]
    assert _rows(snapshot.reverted(now, old, new, "k", "v")) == sorted(wanted, key=str)


def test_blocks_of_postings(spark):
    """Many blocks of documents and queries, ties across them: the answers of adding up everything, and no row a candidate."""
    rng = random.Random(3)
    postings = {(t, d): rng.choice([0.5, 1.0]) for t in range(40) for d in range(150) if rng.random() < 0.3}
    queries = {q: {t: rng.choice([1.0, 2.0]) for t in rng.sample(range(45), 9)} for q in range(20)}
    table = spark.createDataFrame([(t, d, w) for (t, d), w in postings.items()] + [(None, 7, 9.0)], "term int, id int, w double")
    terms = spark.createDataFrame([(q, t, f) for q, ts in queries.items() for t, f in ts.items()] + [(3, None, 1.0)], "query_id int, term int, weight double")
    found = search.best_by_bounds(table, terms, 6, seed=100, asked=30)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    for q, ts in queries.items():
        sums = {}
        for (t, d), w in postings.items():
            if t in ts:
                sums[d] = sums.get(d, 0) + w * ts[t]
        assert got[q] == sorted((-s, d) for d, s in sums.items())[:6]
    assert search.best_by_bounds(table.limit(0), terms, 6).count() == 0 == search.best_by_bounds(table, terms.limit(0), 6).count()


def test_prefixes_stay_narrow(spark):
    """Long sets with many tokens of their own: a row of a prefix has few tokens beside it, and no pair is lost or found twice."""
    rng = random.Random(5)
    base = rng.sample(range(10**6), 600)
    sets = {k: set(base) - set(rng.sample(base, 30)) | {10**7 + 100 * k + j for j in range(20)} for k in range(6)}
    sets[50] = {base[0], 1}
    rows = spark.createDataFrame([(k, [str(x) for x in s]) for k, s in sets.items()], "id long, set array<string>")
    parts = setjoin.prefixes(setjoin.ordered_sets(rows, Scratch(spark, "narrow")), 0.8)
    assert parts.agg(F.max(F.size("prefix"))).first()[0] <= setjoin.BESIDE
    got = [(r["a"], r["b"]) for r in setjoin.similar_sets(rows, 0.8).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_tokenizer_calls_stay_small():
    """However many chunks are new, a call gets a bounded number of them, and the ids are those of whole texts."""
    encoder = packing.ChunkEncoder(packing.tokenizer_path())
    whole, calls = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **how):
            calls.append(sum(len(t.split()) for t in texts))
            return whole.encode_batch_fast(texts, **how)

    encoder.tokenizer = Counting()
    rng = random.Random(9)
    chunks = {"".join(rng.choices("abcdefgh", k=7)) + rng.choice(["", "", ".", "7"]) for _ in range(40_000)}
    encoder.learn({c.encode() for c in chunks})
    assert max(calls) <= 4096
    assert encoder.known.keys() >= {c.encode() for c in chunks}
    for chunk in rng.sample(sorted(chunks), 500):
        assert list(memoryview(encoder.known[chunk.encode()]).cast("I")) == whole.encode(chunk, add_special_tokens=False).ids
    assert packing.ChunkEncoder(packing.tokenizer_path()).tokenizer is whole


def test_vectors_without_structure_meet_in_large_products(monkeypatch):
    """Where no cell can be left out, queries meet many cells at once; the answers, ties too, are those of all pairs."""
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(3000, 16)), 1)
    v[rng.integers(0, 3000, 300)] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pivots = neighbours.fitted_pivots(v, 100)
    far = neighbours.distances(v, pivots)
    cell = far.argmin(axis=1)
    cells = neighbours.Cells(pivots, {c: (int((cell == c).sum()), float(far[cell == c, c].max())) for c in set(cell.tolist())})
    offers, offer = [], neighbours.Best.offer
    monkeypatch.setattr(neighbours.Best, "offer", lambda *args: (offers.append(1), offer(*args)))
    shelf = pd.DataFrame({"id": rng.permutation(3000), "cell": cell, "v": list(v)})
    found = neighbours.compared(cells, shelf, shelf.assign(worst=-np.inf), 8)[0]
    assert len(offers) < 150
    sims, ids = np.round(v @ v.T, 9), shelf["id"].to_numpy()
    want = {(int(ids[q]), int(ids[r])): s for q, row in enumerate(sims) for r, s in ((r, row[r]) for r in np.lexsort((ids, -row))[:8])}
    assert {(int(q), int(i)) for q, i in zip(found["query_id"], found["id"])} == want.keys()


def test_trigram_jaccard_without_arrays(spark):
    texts = ["", "a", "ab", "abc", "abcabc", "line\nbreak\r\n", "naïve 😀😀😀 é", "a" * 50, "abcd" * 30, None]
    pairs = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string")
    one, other = T.trigram_jaccard(F.col("x"), F.col("y")), T.jaccard(T.trigrams(F.col("x")), T.trigrams(F.col("y")))
    assert pairs.select(one.alias("a"), other.alias("b")).where("not (a <=> b)").collect() == []


def test_near_dup_gate_moves_no_trigrams(spark):
    plan = similar.near_dup_gate(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "trigram_jaccard" in plan and "array_intersect" not in plan


@pytest.mark.parametrize("most", [0, 3, 20, 1 << 16])
def test_shortlist_moves_only_what_a_text_may_list(spark, monkeypatch, most):
    """However many phrases count as common, the shortlists are those of a full ranking; of a text's common phrases at most k are kept."""
    rng = random.Random(3)
    names = [f"w{k}" for k in range(60)] + ["é", "z-1", "¹"]
    texts = {k: sorted(set(rng.choices(names, weights=[1 / (1 + n) ** 1.3 for n in range(len(names))], k=rng.choice([0, 1, 4, 9, 60])))) for k in range(200)}
    texts |= {200: ["once"], 201: None}
    k, fill, df = 6, 4, Counter(w for ws in texts.values() for w in ws or [])
    core = sorted(df, key=lambda w: (-df[w], w.encode()))[:fill]
    want = set()
    for id_, ws in texts.items():
        own = sorted(ws or [], key=lambda w: (df[w], w.encode()))[:k]
        listed = own + ([w for w in core if w not in own] if 0 < len(own) < fill else [])[: fill - len(own)]
        want |= {(id_, w, n) for n, w in enumerate(listed, 1)}
    tables = {}
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, frame, name: tables.setdefault(name, keep(self, frame, name)))
    rows = spark.createDataFrame(list(texts.items()), "id long, w array<string>")
    got = [tuple(r) for r in search.rare_first(rows, k, fill, most).select("id", "phrase", "place").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    kept = tables["kept"].groupBy("id").agg(F.count("*").alias("n"), F.count("df").alias("common")).collect()
    assert all(r["common"] <= max(0, k - (r["n"] - r["common"])) for r in kept)
    assert most < 20 or sum(r["n"] for r in kept) < sum(df.values())


def test_learning_chunks_walks_through_none_that_are_known():
    """What a call costs depends on its own chunks, not on all that a task remembers."""

    class Looked(dict):
        def __iter__(self):
            raise AssertionError("walked through")

        keys = items = values = __iter__

    encoder = packing.ChunkEncoder(packing.tokenizer_path())
    encoder.known = Looked()
    for words in (["ab", "ab.", "naïve", "x1", "it's"], ["ab", "ab!", "naïve,", "5%", "<|x|>", "..."]):
        chunks = {w.encode() for w in words}
        encoder.learn(chunks)
        for chunk in chunks:
            ids = encoder.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
            assert encoder.known[chunk] == np.array(ids, "<u4").tobytes()
