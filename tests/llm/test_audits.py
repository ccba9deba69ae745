"""The divergence audit, the additive classifier and the filter audit against plain loops."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparklode.llm import divergence, filteraudit, gam, queries
from sparklode.sources import load
from tests.conftest import MIDDLE, SMALL

LONG = " ".join(f"Word{k % 977} ñandú{k % 31}" for k in range(90_000))
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "b"),
    (3, "Same é text, same", None, None),
    (3, "Same é text, same", None, None),
    (None, "Same é text, same", "en", "a"),
    (None, "SAME", "en", None),
    (4, LONG, "en", "b"),
    (5, "İI ß \u0000 x1y_z", "de", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null and very long texts, null groups, and extra columns with clashing names."""
    rows = [(*r, 1, 2, "m") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, mask int, term string")


def plain_divergence(rows, min_docs, top=50):
    found, held = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        found[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in held.keys() | {g for g, _ in found}:
        kept = {t for t, n in held[lang].items() if n >= min_docs}
        sources = sorted(s for g, s in found if g == lang)

        def p(counts, lang_kept=kept):
            total = sum(counts[t] for t in lang_kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(lang_kept)) for t in lang_kept}

        own = {s: p(found[lang, s]) for s in sources}
        whole = p(sum((found[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, own[s][t] - whole[t]) for t in kept if found[lang, s][t] and own[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def listed(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


DIVERGENCE = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("cells", [divergence.CELLS, 40])
def test_divergence(spark, odd, cells):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices(["Alpha", "beta", "été", "δ", "x1y", "don't", "Zoë-zoë"], k=rng.randint(0, 9))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "é", None])) for k in range(120)]
    rows += [(200, "rare", "la", "a"), (201, "", "la", "b"), (202, None, "la", "c"), (203, "alpha", "only", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert listed(divergence.source_divergences(docs, min_docs=3, top=4, cells=cells), *DIVERGENCE) == plain_divergence(rows, 3, 4)
    assert listed(divergence.source_divergences(odd, min_docs=1), *DIVERGENCE) == plain_divergence(ODD, 1)
    assert divergence.source_divergences(odd.limit(0)).count() == 0


def test_terms_of_bytes():
    """Bounds, groups and windows on random bytes, with a hash that collides and windows smaller than a text."""
    rng = random.Random(1)
    for _ in range(30):
        texts = ["".join(rng.choices("aAbB é☃.1\n\0", k=rng.choice([0, 1, 5, 200]))) for _ in range(rng.randint(1, 6))]
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        if not len(data):
            continue
        starts, ends = divergence.bounds(data, offsets)
        want = [m.encode() for t in texts for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
        assert [data[s:e].tobytes() for s, e in zip(starts, ends)] == want
        for digest in (divergence.xxhash.xxh64_intdigest, len, lambda s: 0):
            group, terms = divergence.grouped(data, starts, ends, digest)
            assert [terms[g] for g in group] == want
        for size in (1, 3, 64, 1 << 20):
            counter = divergence.TermCounter(size)
            counter.add(["l"] * len(texts), [str(k % 2) for k in range(len(texts))], pa.array(texts))
            rows = [r for b in counter.rows() for r in b.to_pylist() if r["term"] is not None]
            n, docs = Counter(), Counter()
            for k, t in enumerate(texts):
                terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
                n.update((str(k % 2), x) for x in terms)
                docs.update({(str(k % 2), x) for x in terms})
            assert {(r["source"], r["term"]): (r["n"], r["docs"]) for r in rows} == {x: (n[x], docs[x]) for x in n}


def test_smoothed_is_exact():
    rng = random.Random(2)
    for _ in range(300):
        total, kinds = rng.randint(0, 10 ** rng.randint(1, 15)), rng.randint(1, 10**6)
        count = rng.randint(0, total)
        assert divergence.smoothed(np.array([count]), np.array([total]), kinds)[0] == 1 + 10**9 * (count + 5) // (total + 5 * kinds)


def plain_audit(rows, quality, toxic):
    first = {}
    for k, text, _ in rows:
        if k is not None:
            first[text or ""] = min(k, first.get(text or "", k))
    failed = defaultdict(list)
    for k, text, lang in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": k is not None and first[text] < k,
        }
        failed[lang or ""].append(({f for f, x in fails.items() if x}, quality.get(k) == 1, toxic.get(k) == 1))
    out = []
    for part, docs in failed.items():
        done, sums = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                sums[f] += len(gone)
                fails = sum(f in d[0] for d in docs)
                done.append((f, (part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out += [(*row, sums[f]) for f, row in done]
    return sorted(out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit(spark, odd):
    rng = random.Random(5)
    texts = ["A B c", "x " * 120, " ".join(map(str, range(150))), "UP " * 10 + " ".join(map(str, range(99))), "a # b", None, "", " ", " \x1c ", " ".join(map(str, range(120))) + " $"]
    rows = [(rng.choice([k, k, 3, 5, None]), rng.choice(texts), rng.choice(["en", "fr", None])) for k in range(60)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in [*range(40), 3, 5]] + [(None, 1, 1)]
    quality, toxic = ({k: max((r[c] or 0) for r in labels if r[0] == k) for k in range(40)} for c in (1, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert listed(filteraudit.filter_order_audit(docs, marks), *AUDIT) == plain_audit(rows, quality, toxic)
    assert listed(filteraudit.filter_order_audit(odd, marks.limit(0)), *AUDIT) == plain_audit([r[:3] for r in ODD], {}, {})
    assert filteraudit.filter_order_audit(odd.limit(0), marks).count() == 0


def test_survivors_of_every_set():
    counts = np.random.default_rng(4).integers(0, 9, 32)
    want = [sum(int(counts[m]) for m in range(32) if not m & s) for s in range(32)]
    assert filteraudit.survivors(counts).tolist() == want
    effects = filteraudit.order_effects(counts, counts, counts)
    assert effects.groupby("filter_order").removed.sum().eq(want[0] - want[31]).all()
    per_order = effects.drop_duplicates(["shapley", "unique_fails"]).shapley.sum()
    assert per_order == 120 * (want[0] - want[31]) or len(effects.shapley.unique()) < 5


def test_features_by_hand():
    assert gam.features_of(None) == gam.features_of(" \n\t") == (0.0,) * len(gam.FEATURES)
    got = dict(zip(gam.FEATURES, gam.features_of("Aa bb. bb. 12!\nx # x\nx # x")))
    assert got["words"] == pytest.approx(np.log(11)) and got["word_length"] == 1.7 and got["symbols"] == pytest.approx(0.3)
    assert got["upper"] == pytest.approx(1 / 10) and got["distinct"] == 0.5 and got["repeats"] == 0.0 and got["dup_lines"] == pytest.approx(1 / 3)
    assert got["digits"] == 0.2 and got["sentences"] == 0.2 and got["same_as_before"] == 0.2 and got["short_words"] == 0.7
    assert got["line_words"] == pytest.approx(np.log(1 + 10 / 3))


def test_trees_against_all_cuts():
    rng = np.random.default_rng(3)

    def worth(g, w):
        return g.sum() ** 2 / (w.sum() + gam.RIDGE)

    for _ in range(30):
        n = int(rng.integers(2, 9))
        g, w = rng.normal(size=n), rng.uniform(5, 9, n)
        cuts = [(worth(g[:k], w[:k]) + worth(g[k:], w[k:]) - worth(g, w), k) for k in range(1, n)]
        best = max(cuts)
        assert gam.best_cut(g, w) == (pytest.approx(best[0]), best[1]) if best[0] > 0 else gam.best_cut(g, w) == (0.0, 0)
        assert len(np.unique(gam.shallow_tree(g, w))) <= 3
        m = int(rng.integers(2, 6))
        g, w = rng.normal(size=(n, m)), rng.uniform(1, 9, (n, m))
        found = {}
        for r, c in itertools.product(range(1, n), range(1, m)):
            quarters = [(slice(a, b), slice(x, y)) for a, b in ((0, r), (r, n)) for x, y in ((0, c), (c, m))]
            found[r, c] = sum(worth(g[q], w[q]) for q in quarters) - worth(g, w), quarters
        want, quarters = max(found.values(), key=lambda x: x[0])
        got, cells = gam.crossed_tree(g, w)
        assert got == pytest.approx(max(want, 0))
        if want > 0:
            assert all(cells[q] == pytest.approx(g[q].sum() / (w[q].sum() + gam.RIDGE)) for q in quarters)


def test_pairs_are_learned():
    """An exclusive or of two features is beyond single tables; the pair table has it, and scores are sums of looked-up values."""
    rng = np.random.default_rng(9)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.4)).astype(float)
    model = gam.boosted(x, y, 20, 40, 1)
    assert list(model.pairs) == [(0, 2)]
    fresh = rng.uniform(size=(500, 3))
    assert ((model.scores(fresh) > 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 2] > 0.4))).mean() > 0.95
    for row, score in zip(fresh[:50], model.scores(fresh[:50])):
        at = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        odds = model.intercept + sum(t[b] for t, b in zip(model.tables, at)) + sum(t[at[f], at[g]] for (f, g), t in model.pairs.items())
        assert score == pytest.approx(1 / (1 + np.exp(-odds)))


def test_classifier(spark, odd):
    scored = queries.op12_quality_classifier(spark, MIDDLE)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored.select("doc_id", "held_out").collect())
    assert scored.count() == load(spark, MIDDLE, "documents").count()
    seen = scored.join(load(spark, MIDDLE, "labels"), "doc_id").where("held_out").toPandas()
    pos, neg = (seen[seen.quality == k].score.to_numpy() for k in (1, 0))
    assert (pos[:, None] > neg[None, :]).mean() > 0.97 and (seen.predicted == seen.quality).mean() > 0.95
    labels = load(spark, SMALL, "labels")
    # Labels of held-out rows never matter.
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    docs = load(spark, SMALL, "documents")
    assert listed(gam.quality_scores(docs, labels), "doc_id", "score") == listed(gam.quality_scores(docs, flipped), "doc_id", "score")
    few = gam.quality_scores(odd, labels).collect()
    assert len(few) == len(ODD) and all(0 <= r["score"] <= 1 for r in few) and not any(r["held_out"] for r in few if r["doc_id"] is None)
    assert {r["score"] for r in gam.quality_scores(odd, labels.limit(0)).collect()} == {0.0}
    assert gam.quality_scores(odd.limit(0), labels).count() == 0
