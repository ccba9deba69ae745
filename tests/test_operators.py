"""Small fixtures with hand-made results for what the oracles don't reach."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparklode.functions import marks, scoring
from sparklode.functions import text as T
from sparklode.operators import cohort, dedup, ranking, relational, rules, snapshot
from sparklode.operators.graph import connected_components
from sparklode.plans import queries
from sparklode.sources import formats
from tests.conftest import SMALL


def values(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_streak_with_freezes_equals_a_loop(spark):
    rng = random.Random(5)
    start = dt.date(2024, 1, 1)
    rows = [(u, start + dt.timedelta(d)) for u in range(30) for d in range(59) if rng.random() < 0.7]
    got = values(ranking.streak_with_freezes(spark.createDataFrame(rows, "u int, day date"), "u", "day", "2024-02-29"), "u", "current", "best")
    want = set()
    for u in {u for u, _ in rows}:
        last, run, best, month, left = None, 0, 0, None, 2
        for day in sorted(d for v, d in rows if v == u):
            if (day.year, day.month) != month:
                month, left = (day.year, day.month), 2
            gap = (day - last).days - 1 if last else None
            if last and gap <= left:
                run, left = run + 1, left - gap
            else:
                run = 1
            best, last = max(best, run), day
        today = dt.date(2024, 2, 29)
        left = left if month == (2024, 2) else 2
        want.add((u, run if (today - last).days - 1 <= left else 0, best))
    assert got == want


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 9), (20, 21), (21, 20), (7, 7), (None, 3)]
    got = values(connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b"), "node", "root")
    assert got == {(2, 2), (3, 2), (4, 2), (5, 2), (9, 2), (20, 20), (21, 20)}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
    chain = [(k, k + 1) for k in range(200)]
    assert {r for _, r in values(connected_components(spark.createDataFrame(chain, "a int, b int"), "a", "b"), "node", "root")} == {0}


def test_part_gate_splits_a_shared_header(spark):
    rows = [(k, "h", [("s", str(k))]) for k in range(30)] + [(40, "h", [("x", "y")]), (41, "h", [("x", "y")]), (50, "", [("x", "y")])]
    df = spark.createDataFrame(rows, "id int, hash string, parts array<struct<statement:string,answer:string>>")
    edges = dedup.star_edges(df, "id", [F.col("hash"), dedup.parts_key(F.col("parts"))])
    assert values(edges, "a", "b") == {(40, 41)}
    assert values(dedup.groups(edges), "id", "root", "members") == {(40, 40, 2), (41, 40, 2)}


def test_places_cross_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v"))
    got = ranking.places(df, [F.desc("v"), F.asc("id")]).select("v", "place").collect()
    assert {(r["v"], r["place"]) for r in got} == {(v, 1000 - v) for v in range(1000)}


def test_conflicts_of_wildcard_keys(spark):
    left = spark.createDataFrame([(1, "y", "a"), (2, "y", ""), (3, "y", "a")], "item int, year string, stage string")
    right = spark.createDataFrame([(1, "y", "b"), (2, "y", "b"), (3, "y", "a"), (3, "z", "a"), (4, "y", "a")], "item int, year string, stage string")
    assert values(relational.wildcard_conflicts(left, right, "item", ["year"], "stage"), "item") == {(1,), (3,)}


def test_percentiles_and_shares(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 6)], "g string, v double")
    assert values(cohort.nearest_rank_ceil(df, ["g"], "v", 50), "p50") == {(3.0,)}
    assert values(cohort.nearest_rank_round(df, ["g"], "v", 50), "p50") == {(2.0,)}
    weights = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1)], "k string, w int")
    assert values(cohort.apportion(weights, [], "w", [F.asc("k")], 100), "k", "share") == {("x", 34), ("y", 33), ("z", 33)}


def test_numbers_and_labels(spark):
    rows = spark.createDataFrame([("a 1,50 and -0 or 007.0",), ("",), ("x",)], "t string")
    assert [r[0] for r in rows.select(T.numbers(F.col("t"))).collect()] == [["1.5", "0", "7"], [], []]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.grade_numbers(F.lit("11-9, 7"))) == [7, 9, 10, 11]
    assert one(T.grade_text(F.array(*map(F.lit, [7, 8, 9, 11])))) == "7-9, 11"
    assert one(T.grade_text(F.array().cast("array<int>"))) == ""
    assert one(T.label_set(F.lit("C; a) A"))) == ["a", "c"]
    assert one(T.number_words(F.lit("the two thousand three hundred twelve of five"))) == 2312
    assert one(T.number_words(F.lit("nine thousand"))) is None
    assert one(T.shorten(F.lit("one two  three, four"), 14)) == "one two three…"
    assert one(T.plural(F.lit(22), "a", "b", "c")) == "b"
    assert one(T.statement_form(F.lit("Ｑ² — ½!"))) == "q2 1 2"
    assert one(T.query_terms(F.lit("the GDP of an open economy GDP"), ["the", "of", "an"])) == ["GDP", "open", "economy"]


def test_indel_ratio(spark):
    def slow(a, b):
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
        return 2 * lcs[-1][-1] / (len(a) + len(b)) if a or b else 1.0

    rng = random.Random(1)
    pairs = [("", ""), ("a", "")] + [("".join(rng.choices("abc", k=rng.randint(0, 30))), "".join(rng.choices("abc", k=rng.randint(0, 30)))) for _ in range(50)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.indel_ratio("a", "b").alias("r")).collect()
    assert all(r["r"] == pytest.approx(slow(r["a"], r["b"])) for r in got)


def test_levels(spark):
    df = spark.range(0, 3000, 7).select("id", scoring.level_for_xp(F.col("id")).alias("n"))
    assert all(100 * (r["n"] - 1) ** 1.5 <= r["id"] + 1e-6 and 100 * r["n"] ** 1.5 > r["id"] - 1e-6 for r in df.collect())


def test_small_registry_is_refused(spark):
    current = spark.createDataFrame([(k, "x", True) for k in range(10)], "k int, v string, is_active boolean")
    with pytest.raises(ValueError, match="too small"):
        snapshot.registry_merge(current, current.limit(2).drop("is_active"), "k", ["v"], ["v"], 0.5)


def test_key_values_and_json(spark):
    rows = spark.createDataFrame([("a: 1\nb:2\n\nbad\na: 3",), (None,)], "text string")
    got = formats.key_values(rows).collect()
    assert got[0]["fields"] == {"a": "1", "b": "2"} and got[0]["errors"] == ["line 4: no key", "line 5: a again"]
    assert got[1]["fields"] == {} and got[1]["errors"] == []
    assert formats.repaired_json('x [1, {"a": "b') == '[1,{"a":"b"}]'
    assert formats.repaired_json("nothing") is None


def test_stream_equals_batch(spark):
    known = queries()
    assert values(known["stream_suppression"](spark, SMALL), "event_id", "stored") == values(known["suppress_repeats"](spark, SMALL), "event_id", "stored")


@pytest.mark.parametrize("name", ["seeded_sample", "package_manifest", "day_streaks_with_freezes"])
def test_queries_without_oracle_repeat(spark, name):
    first, second = (queries()[name](spark, SMALL).toPandas() for _ in range(2))
    assert len(first) and sorted(map(str, first.to_numpy().tolist())) == sorted(map(str, second.to_numpy().tolist()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_places_of_many_wide_rows(spark):
    """Every place once, in the right order, when rows are wide, partitions many and adaptive execution on."""
    n = 2_000_000
    rows = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(500_000)).alias("score"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("payload"))
    rows.sparkSession.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        placed = ranking.places(rows, [F.desc("score"), F.asc("id")]).select("id", "score", "place")
        seen = placed.agg(F.count("*"), F.count_distinct("place"), F.min("place"), F.max("place"), F.count_distinct("id")).first()
        assert tuple(seen) == (n, n, 1, n, n)
        first = [r["id"] for r in placed.where("place <= 50").orderBy("place").collect()]
        assert first == [r["id"] for r in rows.orderBy(F.desc("score"), "id").limit(50).collect()]
    finally:
        rows.sparkSession.conf.set("spark.sql.shuffle.partitions", "4")


def test_places_and_percentiles_when_one_board_has_most_rows(spark):
    """Boards that go on over several partitions, a missing board name included, against sorting in plain Python."""
    rng = random.Random(11)
    data = [(k, rng.choice(["big", "big", "big", "big", "small", None]), rng.randrange(400)) for k in range(6000)]
    df = spark.createDataFrame(data, "id long, board string, score long").repartition(7)
    got = values(ranking.places(df, [F.desc("score"), F.asc("id")], ["board"]), "id", "board", "place")
    want, below, p90 = set(), set(), set()
    for board in ("big", "small", None):
        mine = sorted(((-s, k) for k, b, s in data if b == board))
        want |= {(k, board, n + 1) for n, (_, k) in enumerate(mine)}
        scores = sorted(-s for s, _ in mine)
        below |= {(k, 100 * bisect.bisect_left(scores, -s) // len(scores)) for s, k in mine}
        p90.add((board, scores[round(0.9 * len(scores)) - 1]))
    assert got == want
    assert values(cohort.percent_below(df, "board", "score", 20), "id", "percentile") == below
    assert values(cohort.nearest_rank_round(df, ["board"], "score", 90), "board", "p90") == p90


def test_wildcard_groups_do_not_pair_full_rows(spark):
    """Two full rows of different attributes stay apart unless a row with a null ties them; null keys stay alone."""
    rows = [(1, "k", 1, "x"), (2, "k", 2, "x"), (3, "k", 1, "x"), (4, "m", 1, "x"), (5, "m", 2, "x"), (6, "m", None, "x"), (7, None, 1, "x"), (8, "q", None, None), (9, "q", 4, "y"), (10, "q", 5, "z")]
    table = spark.createDataFrame(rows, "id int, key string, a int, b string")
    got = {r["id"]: r["root"] for r in rules.wildcard_groups(table, "key", "a", "b", "id").collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 8, 10: 8}


def test_tail_options_of_odd_texts(spark):
    """Nulls, empty texts, blank lines with tabs, options in the middle, and lists that don't begin at one."""
    texts = [None, "", "a) x\n\t\nb) y", "stem \n\t\nA. x\n  \nB) y\n", "a) x\nb) y\nend", "stem\n2. x\n3. y", "stem\n1. x y\n2. Compute it", "1.5 m\n1) x\n2) y"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [tuple(r["o"]) for r in rows.select("k", marks.tail_options(F.col("t")).alias("o")).orderBy("k").collect()]
    assert [g[0] for g in got] == ["no_block", "no_block", "empty_stem", "parsed", "no_block", "mixed_style", "verb_like_subquestion", "parsed"]
    assert got[3][1:] == (["x", "y"], "stem") and got[7][1:] == (["x", "y"], "1.5 m")


def test_formula_faults_and_names(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in marks.formula_faults(F.lit(r"\{ {a} \begin{cases}x\end{cases}")).items()]).first()
    assert tuple(row) == (False, False, False, False)
    odd = spark.range(1).select(*[c.alias(n) for n, c in marks.formula_faults(F.lit(r"\begin{tikz} }{ \colour{x} \frac{1}{2}")).items()]).first()
    assert odd.asDict() == {"braces": True, "environment": True, "command": True, "unclosed": True}
    names = spark.createDataFrame([("n 57",), ("n 50 лет",), ("12345",), ("3.5",), (None,), ("№ 8, 9",)], "t string")
    assert [r[0] for r in names.select(marks.number_in_name(F.col("t"))).collect()] == [57, None, None, None, None, 8]
