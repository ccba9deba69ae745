"""Joined lines, defects and concepts on small texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sparklode.operators import concepts, defects, gluing
from sparklode.plans import repair
from tests.conftest import SMALL


def glued(spark, texts, **limits):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r["id"]: r for r in gluing.glue_lines(rows, **limits).collect()}


def test_what_is_glued(spark):
    """Broken sentences are joined by one space, whatever broke them."""
    cases = {
        "The firm sells goods\nin two markets.": "The firm sells goods in two markets.",
        "one line ends\nhere and goes  \n  on to the\nend.": "one line ends here and goes on to the end.",
        "the price of $p$\n, and more": "the price of $p$ , and more",
        "It was sold to\nAnna and then": "It was sold to Anna and then",
        "the total was\n15 units": "the total was 15 units",
        "profit\n= revenue": "profit = revenue",
        "a value as\n(taken) before": "a value as (taken) before",
        "the price is\n\\$10 now": "the price is \\$10 now",
        "let $P\nQ$ be\nlarge": "let $P\nQ$ be large",
    }
    got = glued(spark, cases)
    assert {t: got[k]["text"] for k, t in enumerate(cases)} == cases and not any(r["held"] for r in got.values())


def test_what_is_kept(spark):
    """Structure, finished sentences, formulas and doubtful hyphens stay as they are."""
    texts = [
        "It ended.\nthen more", "It ended.)\nthen more", "such as:\nfirst", "head\n1. one\n2. two", "head\na) one\nb) two", "head\n• one\n• two", "text\niv) four",
        "price\nAnswer: 5", "see\n$$x = 1$$\nand so", "before\n\\[ x \\]\nafter", "a\n\nb", "a | b | c\nd | e | f", "x & y & z\nu & v & w", "700\n800\n900",
        "income: 50\noutput: 60", "inflation 5%\ngrowth 7%", "Some words\nUpper start", "text\n$x$ is large", "mc (6) =?\nvc (7) =?", "a word bro-\nken here",
        "sum $a +\nb$ done.", "the year\n1999 — 500", "text\n\\textbf{x}", "single line", "", None,
    ]
    got = glued(spark, texts)
    assert {k: got[k]["text"] for k in got} == dict(enumerate(texts)) and all(r["glued"] == 0 for r in got.values())
    assert got[19]["doubtful"] == 1 and sum(r["doubtful"] for r in got.values()) == 1


def test_gluing_settles(spark):
    """Gluing a result again changes nothing, and nothing but line breaks and the blanks around them differs."""
    rng = random.Random(5)
    pieces = ["the", "of", "Anna", "sold", "15", "it.", "(see", "$x", "y$", "= 2", "- dash", "bro-", "1) item", "a | b |", ",", "Answer:", "and", "7%", "growth 5%", ""]
    texts = [" ".join(rng.choices(pieces, k=3)).join(["", ""]) if k < 2 else "\n".join(" ".join(rng.choices(pieces, k=rng.randint(0, 4))) for _ in range(rng.randint(1, 9))) for k in range(150)]
    first = glued(spark, texts)
    again = glued(spark, [first[k]["text"] for k in range(len(texts))])
    assert all(again[k]["text"] == first[k]["text"] and again[k]["glued"] == 0 for k in again)
    assert any(r["glued"] > 1 for r in first.values())
    for k, t in enumerate(texts):
        assert re.sub(r"\s+", "", first[k]["text"]) == re.sub(r"\s+", "", t)
        assert t.count("\n") - first[k]["text"].count("\n") == first[k]["glued"]


def test_gluing_moves_no_line(spark):
    """A text's lines stay in its row, so nothing is shuffled; signs and guards are those of line by line judging."""
    texts = [
        "costs \\$5 and\nmore", "let $$\nx", "let $a\n\\$b$ and\nso", "odd $\nx\n$ and\nso", "back \\\n$x\ny$ and\nso", "(a$ b\nc$) \u00a0\n d", "a\n\nb\n", "\n", "the which\nAnna", "xwhich\nAnna",
    ]
    want = [
        "costs \\$5 and more", "let $$\nx", "let $a\n\\$b$ and so", "odd $\nx\n$ and so", "back \\\n$x\ny$ and so", "(a$ b\nc$) d", "a\n\nb\n", "\n", "the which Anna", "xwhich\nAnna",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    done = gluing.glue_lines(rows)
    assert {r["id"]: r["text"] for r in done.collect()} == dict(enumerate(want))
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_guards(spark):
    many, long = "\n".join(["word and"] * 100), "\n".join(["some words of a line and " * 5] * 30)
    got = glued(spark, [many, long, "a\nb"], most=80, longest=2500)
    assert [got[k]["held"] for k in range(3)] == ["too_many_glues", "giant_paragraph", None]
    assert got[0]["text"] == many and got[1]["text"] == long and got[2]["text"] == "a b"


def test_every_class_fires(spark):
    found = repair.defect_classes(spark, SMALL).select(F.explode(F.split("classes", ",")).alias("c")).distinct()
    assert {r["c"] for r in found.collect()} >= {f"A{k}" for k in range(1, 11)} | {f"B{k}" for k in range(1, 8)} | {"C1", "C2", "C3"}
    for query in (repair.text_signals, repair.damage_signs):
        row = query(spark, SMALL).drop("doc_id")
        assert all(row.agg(*[F.max(F.col(c).cast("int")).alias(c) for c in row.columns]).first())
    seen = repair.statement_markers(spark, SMALL).select(F.explode(F.split("markers", ",")).alias("m")).select(F.split("m", ":")[0].alias("m")).distinct()
    assert {r["m"] for r in seen.collect()} >= {*defects.MARKERS, "unpaired_dollars"}


def test_snippets_and_places(spark):
    text = "Some words before the \\footnote{note} and $a << b$ then >> here, see $5"
    item = {"title": "A title that is long enough", "statement": text, "solution": None, "answer": "", "parts": "", "labels": ""}
    row = spark.createDataFrame([(1,)], "k int").select(
        defects.defect_classes({k: F.lit(v).cast("string") for k, v in item.items()} | {"is_test": F.lit(False), "n_parts": F.lit(1), "n_files": F.lit(0)}).alias("c"),
        defects.markers(F.lit(text)).alias("m"),
        defects.markers(F.lit(None).cast("string")).alias("none"),
    ).first()
    assert row["c"] == {"A1": "e words before the \\footnote{note} and $a << b$ "[1:]} or set(row["c"]) == {"A1"}
    places = {m["marker"]: text[m["start"] : m["end"]] for m in row["m"]}
    assert places == {"footnote": "\\footnote{", "pseudo_quotes": ">>", "unpaired_dollars": "$"} and row["none"] in ([], None)


def plain_found(text, names, symbols):
    found = {s for s in symbols if s in (text or "")}
    for pattern in (concepts.WHOLE, concepts.CUT):
        words = [m[0] for m in pattern.finditer((text or "").lower())]
        for name in names:
            for key in (concepts.WHOLE, concepts.CUT):
                w = [m[0] for m in key.finditer(name.lower())]
                if w and any(words[i : i + len(w)] == w for i in range(len(words))):
                    found.add(name)
    return found


def test_concepts(spark):
    rng = random.Random(2)
    words = ["well-known", "known", "well", "price", "Price", "of", "long-run", "run", "a", "$$", "GDP"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(80)] + [None, "", "price-of run"]
    names, symbols = ["well-known", "price of", "Known Price", "run", "long run a", "", "???"], ["$$", "GDP", "P "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    dictionary = spark.createDataFrame([(n,) for n in names] + [("run",)], "name string")
    want = sorted((k, c) for k, t in enumerate(texts) for c in plain_found(t, [n for n in names if n], symbols))
    for most in (concepts.MOST, 0):
        got = concepts.concepts_of(rows, dictionary, symbols, most).collect()
        assert sorted((r["id"], r["concept"]) for r in got) == want, most
    assert concepts.concepts_of(rows.limit(0), dictionary, symbols).count() == 0
    assert concepts.concepts_of(rows, dictionary.limit(0), []).count() == 0


def test_concept_names(spark):
    names = spark.createDataFrame([("Спрос",), ("Тёмный лес",), ("",)], "name string")
    given = spark.createDataFrame([(1, 0, " спрос "), (1, 1, "темный   ЛЕС"), (1, 2, "СПРОС"), (1, 3, "other"), (1, 4, " "), (1, 5, None)], "id int, position int, raw string")
    got = sorted((r["position"], r["concept"], r["known"]) for r in concepts.matched(given, names).collect())
    assert got == [(0, "Спрос", True), (1, "Тёмный лес", True), (3, "other", False)]


def test_overlap(spark):
    """Concepts weigh two and tags one; the best k of all rows, whatever is common."""
    rng = random.Random(7)
    have = {k: {f"c{rng.randrange(12)}" for _ in range(rng.randint(0, 5))} for k in range(120)}
    tags = {k: {"common", f"t{rng.randrange(6)}"} for k in have}
    mark = lambda table, name: spark.createDataFrame([(k, c) for k, s in table.items() for c in s], f"id long, {name} string")
    asked = [0, 10, 50]
    got = concepts.overlap_top(spark.createDataFrame([(q,) for q in asked], "query_id long"), mark(have, "concept"), mark(tags, "tag"), 5).collect()
    for q in asked:
        scores = sorted((-(2 * len(have[q] & have[k]) + len(tags[q] & tags[k])), k) for k in have if k != q)[:5]
        assert [(r["id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(k, -s) for s, k in scores]


@pytest.mark.parametrize("seed", range(2))
def test_best_by_bounds(spark, seed):
    """Random weights, common and rare terms, ties: the answers of adding up everything."""
    from sparklode.operators.search import best_by_bounds

    rng = random.Random(seed)
    postings = {(t, d): rng.choice([0.5, 1.0, rng.random() + 0.01]) * (1 + t % 4) for t in range(30) for d in range(200) if rng.random() < (0.9 if t < 5 else 0.05 * (1 + t % 3))}
    queries = {q: rng.sample(range(32), rng.randint(1, 14)) for q in range(12)}
    table = spark.createDataFrame([(t, d, w) for (t, d), w in postings.items()], "term int, id int, w double")
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id int, term int")
    got = {}
    for r in best_by_bounds(table, terms, 4, seed=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], pytest.approx(r["score"])))
    for q, ts in queries.items():
        sums = {}
        for t in ts:
            for d in range(200):
                if (t, d) in postings:
                    sums[d] = sums.get(d, 0) + postings[t, d]
        want = sorted((-round(s, 6), d) for d, s in sums.items())[:4]
        assert got.get(q, []) == [(d, -s) for s, d in want]
