"""Operators on large groups against plain loops: neighbours in an order, ranks, choices, kept tables, queues and rebuilt fingerprints."""

from __future__ import annotations

import hashlib
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from sparklode.operators import cohort, dedup, evaluation, ranking, staleness
from sparklode.sources import formats
from sparklode.sources.kept import kept


def test_before_in_order(spark):
    """One board with nearly all rows, a few small ones, a null one: the row before, whatever part it is in."""
    rng = random.Random(3)
    rows = list({(rng.choice(["big"] * 30 + ["a", "b", None]), rng.randrange(5000)) for _ in range(900)})
    table = spark.createDataFrame(rows, "board string, value int").repartition(4)
    got = {(r["board"], r["value"]): r["up"] for r in ranking.before_in_order(table, ["board"], [F.desc("value")], "value", "up").collect()}
    for board in {b for b, _ in rows}:
        values = sorted((v for b, v in rows if b == board), reverse=True)
        assert [got[board, v] for v in values] == [None, *values[:-1]]
    assert len(got) == len(rows) and ranking.before_in_order(table.limit(0), ["board"], [F.desc("value")], "value", "up").count() == 0


def test_ranked_values(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaab"), rng.choice([None, *range(40)])) for _ in range(700)]
    ranks = {"p25": cohort.ceil_rank(25), "p90": cohort.round_rank(90), "mid": cohort.median_ranks()}
    got = {r["k"]: r for r in cohort.ranked_values(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", ranks).collect()}
    for k in "ab":
        v = sorted(x for key, x in rows if key == k and x is not None)
        n = len(v)
        assert (got[k]["p25"], got[k]["p90"], got[k]["mid"]) == (v[max(1, math.ceil(25 * n / 100)) - 1], v[max(1, min(n, round(0.9 * n))) - 1], statistics.median(v))


def test_representatives(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(9), k, rng.randrange(3), rng.randrange(4)) for k in range(120)] + [(50, 500, 1, 1)]
    got = {r["g"]: (r["id"], r["rule"]) for r in dedup.representatives(spark.createDataFrame(rows, "g int, id long, q int, c int"), "g", "id", [F.col("q"), F.col("c")]).collect()}
    for g in {r[0] for r in rows}:
        members = [r for r in rows if r[0] == g]
        best = min(members, key=lambda r: (-r[2], -r[3], r[1]))
        rule = "only" if len(members) == 1 else "score" if sum(r[2] == best[2] for r in members) == 1 else "tie"
        assert got[g] == (best[1], rule)


def test_chosen(spark):
    rows = [
        (1, 10, 6, False), (1, 11, 3, False), (2, 20, 6, False), (2, 21, 5, False), (3, 30, 2, True), (3, 31, 6, False),
        (4, 40, 6, True), (4, 41, 6, True), (5, 50, 0, None), (6, 60, 4, False), (6, 61, 4, False),
    ]
    got = {r["grp"]: (r["id"], r["rule"]) for r in dedup.chosen(spark.createDataFrame(rows, "grp int, id int, completeness int, approved boolean")).collect()}
    assert got == {1: (10, "margin"), 2: (20, "human"), 3: (30, "approved"), 4: (40, "human"), 5: (50, "margin"), 6: (60, "human")}


def test_conflicts(spark):
    """Agreement isn't transitive: a null agrees with both of two that don't."""
    anchors = spark.createDataFrame([(1, 2020, "a"), (2, None, "a"), (3, 2021, "a"), (4, 2020, None), (5, 2020, "b")], "id int, year int, stage string")
    matches = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 1), ("y", 2), ("y", 4), ("z", 4), ("z", 5), ("w", 1), ("w", 5)], "candidate string, anchor int")
    got = dedup.without_conflicts(matches, anchors, ["year", "stage"]).collect()
    assert sorted((r["candidate"], r["anchor"]) for r in got) == [("y", 1), ("y", 2), ("y", 4), ("z", 4), ("z", 5)]


def test_collapse(spark):
    rows = [(1, "g", 3, False), (2, "g", 5, True), (3, None, 1, False), (4, "h", 2, False), (5, "h", 4, None), (6, "own-3", 9, False)]
    got = dedup.collapse(spark.createDataFrame(rows, "id int, grp string, rank int, favourite boolean"), "id", "grp", "rank", "favourite").collect()
    assert sorted((r["id"], r["position"]) for r in got) == [(2, 3), (3, 1), (4, 2), (6, 9)]


def test_graded_from_counts(spark):
    """The perfect list made of counts equals the one made of all labels."""
    rng = random.Random(2)
    labels = {(q, d): rng.choice([0, 0, 1, 2]) for q in range(5) for d in range(40) if rng.random() < 0.5}
    shown = [(q, d, r) for q in range(6) for r, d in enumerate(rng.sample(range(40), 12), 1)]
    counts = [(q, [sum(v == g for (p, _), v in labels.items() if p == q) for g in (2, 1)]) for q in range(6)]
    found = evaluation.graded(
        spark.createDataFrame(shown, "query_id int, id int, rank int"),
        spark.createDataFrame([(q, d, v) for (q, d), v in labels.items() if any(s[:2] == (q, d) for s in shown)], "query_id int, id int, label int"),
        spark.createDataFrame(counts, "query_id int, counts array<long>"), 10, 1,
    )
    for r in found.collect():
        q = r["query_id"]
        gain = lambda v, place: (2**v - 1) / math.log2(place + 1)
        dcg = sum(gain(labels.get((q, d), 0), k) for p, d, k in shown if p == q and k <= 10)
        best = sorted((v for (p, _), v in labels.items() if p == q), reverse=True)[:10]
        ideal = sum(gain(v, k) for k, v in enumerate(best, 1))
        assert r["ndcg"] == pytest.approx(dcg / ideal if ideal else 0)


def test_kept_tables(spark, tmp_path):
    """Built once a fingerprint; a build that broke off is no build; old builds go, the newest stay."""
    import os

    root = str(tmp_path)
    made = []

    def get(fingerprint, rows=3):
        def build():
            made.append(fingerprint)
            return spark.range(rows)

        frame, new = kept(spark, "t", 1, fingerprint, build, root)
        return frame.count(), new

    assert get("a") == (3, True) and get("a", 9) == (3, False) and made == ["a"]
    with pytest.raises(Exception, match="boom"):
        kept(spark, "t", 1, "b", lambda: spark.range(4).select(F.raise_error(F.lit("boom")).alias("x")), root)
    assert get("b", 5) == (5, True)
    for k in range(3):
        assert get(f"c{k}")[1]
    builds = [d for d in os.listdir(f"{root}/kept-t") if not d.startswith((".", "_"))]
    assert len(builds) == 2 and get("c2") == (3, False) and get("a", 7) == (7, True)


def test_queue_positions(spark, tmp_path):
    """First appearances in file order, whatever the number and size of files and blocks."""
    rng = random.Random(1)
    ids = [rng.randrange(300) for _ in range(1500)]
    for part in range(5):
        with open(f"{tmp_path}/part-{part}.json", "w") as f:
            f.writelines('{"id": %d, "x": "%s"}\n' % (k, "y" * rng.randrange(50)) if k % 50 else '{"id": %d, broken\n' % k for k in ids[part * 100 : part * 100 + 100] if part < 4)
            if part == 4:
                f.writelines('{"id": %d}\n' % k for k in ids[400:])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    try:
        queue = formats.first_of_each(formats.read_json_lines(spark, str(tmp_path), "id long, x string"), "id")
        got = {r["id"]: r["position"] for r in queue.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept_ids = [k for n, k in enumerate(ids) if n >= 400 or k % 50]
    assert got == {k: n for n, k in enumerate(dict.fromkeys(kept_ids), 1)}


def test_staleness(spark):
    rng = random.Random(9)
    items = {k: {"title": f"Title {k % 7}", "statement": rng.choice([None, "some text"])} for k in range(60)}
    parts = {(k, p): f"part {rng.randrange(5)}" for k in items for p in range(1, rng.randint(1, 4))}
    values = ["Title 3", "  TITLE 3", "some  text", "other", "part 1", "PART 1", None]
    journal = [(n, rng.randrange(65), rng.choice(["title", "statement", "part", "answer"]), rng.randrange(0, 5), rng.choice(values)) for n in range(90)]
    present = staleness.slots(
        spark.createDataFrame([(k, v["title"], v["statement"]) for k, v in items.items()], "id int, title string, statement string"),
        spark.createDataFrame([(k, p, v) for (k, p), v in parts.items()], "id int, part int, value string"),
    )
    frame = spark.createDataFrame(journal, "seq int, id int, field string, part int, old string")
    got = {r["id"]: r["stale"] for r in staleness.touched(present, frame).collect()}

    def print_of(k, over):
        texts = [over.get((f, 0), items[k][f] or "") for f in ("title", "statement")]
        texts += [over.get(("part", p), v) for (i, p), v in sorted(parts.items()) if i == k]
        return hashlib.sha1(re.sub(r"\s+", " ", " \n ".join(texts)).strip().lower().encode()).hexdigest()

    want = {}
    for k in items:
        over = {}
        for _, i, field, part, old in journal:
            if i == k and field != "answer":
                over[field, part if field == "part" else 0] = old or ""
        over = {s: v for s, v in over.items() if (s[0] != "part" or (k, s[1]) in parts) and v != ((parts[k, s[1]] if s[0] == "part" else items[k][s[0]]) or "")}
        if over:
            want[k] = print_of(k, over) != print_of(k, {})
    assert got == want and set(want.values()) == {True, False}
    sums = {r["journal"]: r for r in staleness.audit(present, {"one": frame, "two": frame.where("seq < 40")}).collect()}
    assert sums["one"]["stale"] == sum(want.values()) and sums["one"]["entries"] == 90 and sums["union"]["stale"] >= sums["intersection"]["stale"] > 0


def test_nested_documents():
    doc = "# head\na: 1\nb:\n  c: 'x: y'\n  d:\n    - one\n    - two\n  e: 2\n\nf: \"q\"\n   g: 3\na: 4\nnone\n\th: 1\ni:\n  : 5\nj: http://x"
    found, errors = formats.nested_values(doc)
    assert found == {"a": "1", "b.c": "x: y", "b.d[0]": "one", "b.d[1]": "two", "b.e": "2", "f": "q", "j": "http://x"}
    assert errors == ["line 11: below a value", "line 12: a again", "line 13: no key", "line 14: tab", "line 16: no key"]
    assert formats.nested_values(None) == formats.nested_values("\n \n") == ({}, [])


def test_addresses(spark):
    from sparklode.functions import address

    cases = {
        "г. Тверь, ул. Школьная, 18": "Тверь",
        "Россия, Волгоград, ул. Мира": "Волгоград",
        "171062, Тверская область, с. Кемцы, д. 5": "Кемцы",
        "ЧЕЛЯБИНСК ГОРОД, ул. Труда, 1": "Челябинск",
        "РОСТОВ-НА-ДОНУ Г.": "Ростов-На-Дону",
        "городской округ Самара, дом 3": "Самара",
        "city of Leeds, 5 Main street": "Leeds",
        "ул. Мира, 5": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(a,) for a in cases], "a string")
    got = {r["a"]: r["c"] for r in rows.select("a", address.city_of(F.col("a"), F.array(F.lit("ВОЛГОГРАД"))).alias("c")).collect()}
    assert got == cases
