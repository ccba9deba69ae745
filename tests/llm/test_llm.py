"""Operators 1 to 10 and the pipeline against brute force on small tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparklode.llm import exact, hmm, licences, linededup, packing, pieces, quality, queries, secretscan, simhash, toxicity
from sparklode.sources import load
from tests.conftest import MIDDLE, SMALL
from tests.oracle import same

SPACE = " \t\n\x0b\x0c\r"
ODD = [None, "", " ", "\n\n", "x", "Same TEXT here", "same text here", "É é", "a" * 5000, "one two three four five six. " * 400, "é b c"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(f"[^{SPACE}]+", lower(text))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(k, t, "fp", 1) for k, t in enumerate(ODD)] + [(3, ODD[3], "fp", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, piece int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return {r["doc_id"]: r["text"] for r in load(spark, SMALL, "documents", "doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SMALL)


def base_secrets(text):
    found = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark, small, odd, none):
    for row in queries.op1_secret_scan(spark, SMALL).collect():
        want = ",".join(f"{secretscan.KINDS[k]}:{s}:{e}" for s, k, e in base_secrets(small[row["doc_id"]] or ""))
        assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(row["spans"].split(","))
    key = "Zx9Qm2Lp7Vt4Kd8Rw1Yb6Nc3"
    texts = [f"auth header {key} end", f"plain line {key} end", "secret: token: abcdefgh", f"auth {key} {key}", "session zzzzzzzz1111111111111111zzzzzzzz", "TOKEN='abcdef' AKIA" + "A" * 16]
    novelty = secretscan.Novelty()
    spans = [secretscan.all_spans(t, novelty) for t in texts]
    assert spans[0] == [(12, 3, 36)] and spans[1] == [] and spans[2] == base_secrets(texts[2]) == []
    assert len(spans[3]) == 2 and spans[4] == [] and [k for _, k, _ in spans[5]] == [0, 1]
    assert secretscan.masked(texts[5], novelty, "#") == "#' #"
    assert secretscan.find_secrets(odd).count() == len(ODD) + 1 and secretscan.find_secrets(none).count() == 0
    assert secretscan.mask_secrets(odd).columns == odd.columns


def test_recall_of_planted_secrets(small):
    """Nine in ten random strings of each kind in a sensitive phrase are covered, and prose and plain identifiers are left alone."""
    import base64
    import string

    rng = random.Random(1)
    letters = string.ascii_letters + string.digits
    of_ = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    url = lambda n: base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=")
    kinds = {
        "base62 of 16": lambda: of_(letters, 16), "base62 of 24": lambda: of_(letters, 24), "base62 of 40": lambda: of_(letters, 40), "base64": lambda: base64.b64encode(rng.randbytes(25)).decode(),
        "url-safe": lambda: url(18), "hexadecimal": lambda: rng.randbytes(16).hex().upper(), "uuid": lambda: "-".join(rng.randbytes(n).hex() for n in (4, 2, 2, 2, 6)),
        "three parts": lambda: ".".join(map(url, (18, 40, 24))), "base36": lambda: of_(string.ascii_lowercase + string.digits, 20),
    }
    phrases = ["Authorization: Bearer {}", "session cookie {}", "private key {} end", "the signing key is {}.", "client credential {}", "login with {} now", "auth({})", "signature={}", "pwd {}", "passphrase '{}'"]
    words_ = [w for t in small.values() for w in (t or "").split()]
    novelty = secretscan.Novelty()
    for kind, make in kinds.items():
        hits = 0
        for _ in range(100):
            key = make()
            text = " ".join(rng.choices(words_, k=40)) + "\n" + rng.choice(phrases).format(key) + "\n" + " ".join(rng.choices(words_, k=40))
            at = text.index(key)
            hits += sum(max(0, min(e, at + len(key)) - max(s, at)) for s, _, e in secretscan.all_spans(text, novelty)) >= 0.9 * len(key)
        assert hits >= 90, kind
    plain = "get_user_session_token refreshAccessTokenHandler authentication_provider_factory AbstractAuthenticationProcessingFilter session-timeout-seconds loginFormControllerTest 2024-01-15T10:22:33 com.example.auth.LoginService"
    assert not [w for w in plain.split() if any(k == 3 for _, k, _ in secretscan.all_spans(f"the auth key {w} here", novelty))]
    assert not [k for t in small.values() for _, k, _ in secretscan.all_spans(t, novelty) if k == 3]


def test_lines(spark, odd, none):
    text = "A line that is long enough"
    rows = [(1, f"{text}\nshort\nx"), (2, f"  {text.upper()}\t\nshort"), (3, f"{text}\n{text}"), (4, None), (5, "short")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 1, "short\nx"), 2: (2, 1, "short"), 3: (2, 0, f"{text}\n{text}"), 4: (1, 0, ""), 5: (1, 0, "short")}
    twice = spark.createDataFrame([(1, text), (2, text), (2, text), (None, text)], "doc_id long, text string")
    assert [r["n_dropped"] for r in linededup.drop_repeated_lines(twice).collect()] == [0] * 4
    assert linededup.drop_repeated_lines(odd).count() == len(ODD) + 1 and linededup.drop_repeated_lines(none).count() == 0


def test_lines_of_many_batches(spark):
    """Many small batches, ids with a far-off one, rows that share an id but not a text: the same lines go."""
    rng = random.Random(4)
    pool = [f"a long enough line number {k} of many" for k in range(40)] + ["short", "", "x" * 19]
    rows = [(rng.choice([k, k, 7]), "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for k in range(60)] + [(10**15, pool[0]), (None, pool[1])]
    holders, docs = defaultdict(int), defaultdict(set)
    for k, t in rows:
        for line in t.split("\n"):
            if k is not None and len(line) >= 20:
                docs[line].add(k)
                holders[line] = max(holders[line], k)
    want = Counter((k, "\n".join(x for x in t.split("\n") if not (k is not None and len(docs[x]) >= 3 and k < holders[x]))) for k, t in rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for batch_docs in (9, 1000):
        assert Counter((r["doc_id"], r["text"]) for r in linededup.drop_repeated_lines(table, batch_docs=batch_docs).collect()) == want
    ends = linededup.batch_ends(table.where("doc_id is not null"), 4)
    sizes = [sum(1 for k, _ in rows if k is not None and (i == 0 or k <= ends[i - 1]) and (i == len(ends) or k > ends[i])) for i in range(len(ends) + 1)]
    assert sum(sizes) == 61 and max(sizes) < 40


def test_lines_of_a_very_long_text(spark):
    """Three texts of a hundred thousand lines: work that grows with their lines ends in seconds."""
    import time

    lines = [f"line number {k} which is long enough" for k in range(100_000)]
    rows = [(k, "\n".join(lines[:50] + [f"only here in text {k} at all"] + lines[50:])) for k in (1, 2, 3)]
    began = time.perf_counter()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == (100_001, 0, rows[2][1]) and got[1] == (100_001, 100_000, "only here in text 1 at all") and got[2][1] == 100_000
    assert time.perf_counter() - began < 60


def test_line_runs(spark):
    """Runs share no key, merges keep every key, and a key's holder is the one that came first."""
    rng = random.Random(8)
    scratch = linededup.Scratch(spark, "test")
    runs = linededup.SortedRuns(scratch)
    seen = defaultdict(list)
    for batch in range(5):
        rows = [(100 - 10 * batch - d, rng.randint(1, 30), 0) for d in range(10) for _ in range(4)]
        rows = list(dict.fromkeys(rows))
        for d, h, _ in rows:
            seen[h].append(d)
        runs.add(spark.createDataFrame(rows, "doc_id long, h1 long, h2 long"))
        held = [r["h1"] for t in runs.tables() for r in t.collect()]
        assert len(held) == len(set(held)) and set(held) == set(seen)
    assert len(runs.levels) == 3 and len(runs.tables()) == 2
    for least in (1, 3, 6):
        assert {r["h1"]: r["holder"] for r in runs.repeated(least).collect()} == {h: max(d) for h, d in seen.items() if len(d) >= least}
    merge = runs.merged([n for level in runs.levels for n in level])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in merge
    runs.close()


def test_packing(spark, small, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = defaultdict(list)
    places = defaultdict(list)
    for r in queries.op3_best_fit_packing(spark, SMALL).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in small.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert sorted(got[doc]) == [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    total = 0
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [0, *itertools.accumulate(n for _, n in p)][:-1] and sum(n for _, n in p) <= 2048
        total += sum(n for _, n in p)
    assert len(places) <= -(-total // 2048) * 1.05 + 1
    full = packing.best_fit_packing(odd).collect()
    assert Counter(r["doc_id"] for r in full if r["piece"] == 0) == Counter([*range(len(ODD)), 3])
    assert all(len(r["ids"]) == 4 * r["length"] for r in full)
    assert packing.best_fit_packing(none).count() == 0


def test_sum_of_squares_rule():
    rng = random.Random(3)
    sizes = [rng.randint(1, 30) for _ in range(300)]
    bins = packing.sum_of_squares_bins(sizes, 30)
    gaps: dict[int, int] = {}
    for size, chosen in zip(sizes, bins):
        def cost(b):
            after = dict(gaps)
            after[b] = after.get(b, 30) - size
            counts = Counter(g for g in after.values() if g)
            return sum(v * v for v in counts.values())

        options = [b for b, g in gaps.items() if g >= size] + [max(gaps, default=-1) + 1]
        assert cost(chosen) == min(map(cost, options))
        gaps[chosen] = gaps.get(chosen, 30) - size
        assert gaps[chosen] >= 0


def test_chunks_encode_like_whole_texts():
    encoder = packing.ChunkEncoder(packing.tokenizer_path())
    for text in ["it's don't we're I'LL x's. a'S", "<|endoftext|> x <|STARTOFTEXT|>. A<|b", "éà. ab́, ́.", "日本語, テスト。x", "İstanbul. ẞ, ﬁ. ʰa.", "a1b2. 12,3 ...", "x y. ½", "this*** and%%% (so)"]:
        chunks = packing.chunks_of(text)
        encoder.learn(set(chunks))
        assert b"".join(encoder.known[c] for c in chunks) == array("I", encoder.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def test_chunks_of_documents_encode_like_whole_texts(small, monkeypatch):
    """Small letters, other letters and marks each by their own way, with little remembered, give the library's ids."""
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    encoder = packing.ChunkEncoder(packing.tokenizer_path())
    texts = [*small.values(), "ÉTÉ été Œuvre œuvre ΣΑΣ ßß ÿ. ñandú! ŝ ﬁn İ <|x Ab aB", "e\u0301te\u0301 été", "a" * 3000, "ä" * 500 + "."]
    for k in range(0, len(texts), 10):
        split = [packing.chunks_of(t) for t in texts[k : k + 10]]
        encoder.learn(set().union(*split))
        for t, chunks in zip(texts[k : k + 10], split):
            assert b"".join(map(encoder.known.__getitem__, chunks)) == array("I", encoder.tokenizer.encode(t or "", add_special_tokens=False).ids).tobytes()


def test_forward_equals_all_paths():
    rng = np.random.default_rng(2)
    model = hmm.Hmm(*(rng.dirichlet(np.ones(n), size) if size else rng.dirichlet(np.ones(n)) for n, size in ((2, None), (2, 2), (4, 2))), np.full(4, 0.25))
    texts = [np.array(t, np.int32) for t in ([0], [1, 2, 3], [3, 3, 0, 1, 2], [2, 1])]
    want, starts, emits = [], np.zeros(2), np.zeros((4, 2))
    for t in texts:
        total, gamma = 0.0, np.zeros((len(t), 2))
        for path in itertools.product(range(2), repeat=len(t)):
            p = model.start[path[0]] * np.prod([model.move[a, b] for a, b in itertools.pairwise(path)]) * np.prod([model.emit[s, x] for s, x in zip(path, t)])
            total += p
            for k, s in enumerate(path):
                gamma[k, s] += p
        want.append(np.log(total))
        starts += gamma[0] / total
        np.add.at(emits, t, gamma / total)
    assert hmm.log_likelihoods(model, texts) == pytest.approx(want)
    got = hmm.expected_counts(model, texts)
    assert got[0] == pytest.approx(starts) and got[2] == pytest.approx(emits) and got[3] == pytest.approx(sum(want))
    assert got[1].sum() == pytest.approx(sum(len(t) - 1 for t in texts))
    for cells in (1, 2, 3):
        parts = hmm.expected_counts(model, texts, cells)
        assert all(x == pytest.approx(y) for x, y in zip(parts, got))
    better = model.updated(*got[:3])
    assert hmm.log_likelihoods(better, texts).sum() > sum(want) - 1


def test_language_model(spark, small, odd, none):
    counts, ends = Counter(), 0
    for doc, text in small.items():
        if zlib.crc32(str(doc).encode()) % 10:
            counts.update(words(text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    # Few counted words, so that the join of rare words is used too.
    rows = hmm.language_model_scores(load(spark, SMALL, "documents", "doc_id", "text"), counted=500, symbols=200, states=3).collect()
    assert len(rows) == len(small)
    gain = 0.0
    for r in rows:
        tokens = words(small[r["doc_id"]])
        want = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens) + np.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert r["base_score"] == pytest.approx(want) and r["n_tokens"] == len(tokens) + 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens) + 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        gain += (r["score"] - r["base_score"]) * r["held_out"]
    assert gain > 0
    again = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a g"), (2, "a a a")], "doc_id long, text string")
    counts = Counter("abcdefabcdefagaaa")
    total = 17 + 4 + 0.1 * (7 + 1 + 1)
    for r in hmm.language_model_scores(again, counted=2, symbols=1, states=2).collect():
        text = {1: "abcdef", 2: "aaa", None: "ag"}[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.1) / total) for w in text) + np.log10(4.1 / total))
        assert r["n_known"] == len(text) + 1 and r["held_out"] is False and r["train_tokens"] == 21
    assert hmm.language_model_scores(odd).count() == len(ODD) + 1 and hmm.language_model_scores(none).count() == 0


def test_language_model_scores_by_all_paths(spark, monkeypatch):
    """Whole scores of a tiny table, by adding up the paths of a fixed model, with words that are no symbols and words never seen."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(hmm, "train", lambda texts, prior, states, rounds: hmm.Hmm(rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet(np.ones(len(prior)), 2), prior))
    fixed = hmm.train(None, np.ones(5), 2, 0)
    monkeypatch.setattr(hmm, "train", lambda texts, prior, states, rounds: fixed)
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 10][:4] + [next(k for k in range(40) if zlib.crc32(str(k).encode()) % 10 == 0)]
    texts = ["a a a b B c", "a b", "c d e a b", "", "a zz c e"]
    rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    counts = Counter(w for t in texts[:4] for w in t.lower().split())
    head = sorted(counts, key=lambda w: (-counts[w], w))[:3]
    rest = {w: n for w, n in counts.items() if w not in head}
    total = sum(rest.values()) + 0.1 * (len(rest) + 1)
    for r in hmm.language_model_scores(rows, counted=4, symbols=3, states=2).collect():
        w = texts[ids.index(r["doc_id"])].lower().split()
        symbols = [head.index(x) if x in head else 3 for x in w] + [4]
        p = sum(
            fixed.start[path[0]] * np.prod([fixed.move[a, b] for a, b in itertools.pairwise(path)]) * np.prod([fixed.emit[s, x] for s, x in zip(path, symbols)])
            for path in itertools.product(range(2), repeat=len(symbols))
        )
        inside = sum(np.log10((rest.get(x, 0) + 0.1) / total) for x in w if x not in head)
        assert r["score"] == pytest.approx(np.log10(p) + inside)
    with pytest.raises(ValueError):
        hmm.language_model_scores(rows, counted=10, symbols=20)


def test_training_on_long_texts(spark):
    """A corpus of long texts only is trained on, over more than 16 bits of symbols, and beats its base."""
    pattern = "the cat sat on a mat and then the dog ran to an old red barn while it rained all day long".split()
    rng = random.Random(8)
    rows = [(k, " ".join(w if rng.random() > 0.1 else f"x{rng.randrange(30)}" for _ in range(230) for w in pattern)) for k in range(12)]
    assert all(len(t.split()) > hmm.START_LENGTH for _, t in rows)
    out = hmm.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string"), counted=80_000, symbols=70_000).collect()
    assert all(r["score"] > 0.9 * r["base_score"] for r in out) and all(r["score"] > r["base_score"] + 100 for r in out)


def test_many_symbols(spark):
    """Words beyond the 65536th keep their symbol."""
    words = [f"w{k:05d}" for k in range(70_000)]
    index = {w.encode(): k for k, w in enumerate(words)}
    counts = hmm.Counts(index, np.ones(len(words)), len(words) + 1, len(words) + 1, 1, len(words))
    symbols = np.frombuffer(counts.encoded("w00003 w69999 none")[4], hmm.SYMBOL)
    assert symbols.tolist() == [3, 69_999, 70_000, 70_001]


def test_quality(spark, small, odd, none):
    for r in queries.op5_quality_rules(spark, SMALL).collect():
        text = small[r["doc_id"]] or ""
        w = re.findall(f"[^{SPACE}]+", text)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    again = spark.createDataFrame([(1, "short", 1), (1, "plain words of a good text " * 9 + "and more", 2), (None, "other words of a good text so far, one two three four five six seven", 3)], "doc_id long, text string, counts int")
    assert [quality.keep_good(d).columns for d in (again, odd, none)] == [again.columns, odd.columns, odd.columns] and quality.keep_good(none).count() == 0
    assert [(r["doc_id"], r["counts"]) for r in quality.keep_good(again).collect()] == [(None, 3)]
    labels = load(spark, MIDDLE, "labels").join(queries.op5_quality_rules(spark, MIDDLE).drop("quality"), "doc_id").where("not base_failed")
    good, bad = (labels.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.99 and bad < 0.05
    # Good votes outweigh some bad ones: passing all rules is another verdict, and a worse one.
    votes = quality.text_counts(load(spark, MIDDLE, "documents")).select("doc_id", *[v.alias(n) for n, v in quality.rules().items()])
    passed = F.least(*quality.rules()) >= 0
    both = labels.join(votes, "doc_id").withColumn("passed", passed)
    assert both.where("kept and not passed and quality = 1").count() > 0
    assert both.where("quality = 1").agg(F.avg(F.col("passed").cast("int"))).first()[0] < good
    assert quality.judged(odd).count() == len(ODD) + 1 and quality.judged(none).count() == 0


def test_latent_classes():
    """Expectation-maximisation and the posterior against plain loops."""
    rng = random.Random(12)
    kinds = [[0, 1], [2, 3]]
    patterns = list(Counter(tuple(rng.choice((-1, 0, 1, 1, 1)) for _ in range(4)) for _ in range(800)).items())
    start = quality.LatentClasses.start(4, kinds)
    shares, bad = start.shares.tolist(), start.bad.tolist()
    assert bad == [[0.02] * 4, [0.6, 0.6, 0.02, 0.02], [0.02, 0.02, 0.6, 0.6]]

    def belongs(votes):
        each = []
        for c in range(3):
            p = shares[c]
            for r, v in enumerate(votes):
                p *= bad[c][r] if v < 0 else 1 - bad[c][r] if v > 0 else 1
            each.append(p)
        return [p / sum(each) for p in each]

    for _ in range(4):
        size, down, cast = [0.0] * 3, [[0.0] * 4 for _ in range(3)], [[0.0] * 4 for _ in range(3)]
        for votes, n in patterns:
            for c, p in enumerate(belongs(votes)):
                size[c] += n * p
                for r, v in enumerate(votes):
                    down[c][r] += n * p * (v < 0)
                    cast[c][r] += n * p * (v != 0)
        k = 0.02 * 800
        shares = [(size[c] + 10 * start.shares[c]) / 810 for c in range(3)]
        bad = [[(down[c][r] + k * start.bad[c, r]) / (cast[c][r] + k) for r in range(4)] for c in range(3)]
    model = quality.estimate(patterns, 4, kinds, 4)
    assert model.shares == pytest.approx(shares) and model.bad == pytest.approx(np.array(bad))
    votes = np.array([p for p, _ in patterns])
    assert model.belongs(votes)[:, 0] == pytest.approx([belongs(v)[0] for v in votes.tolist()])


def test_good_votes_outweigh_a_weak_bad_one(spark):
    """A rule that fires on good documents too is outvoted; one that only fires with others of its kind is not."""
    patterns = [((1, 1, 1, 1), 9000), ((-1, 1, 1, 1), 500), ((1, 1, -1, -1), 300), ((1, 1, -1, 0), 60), ((-1, -1, 1, 1), 100)]
    model = quality.estimate(patterns, 4, [[0, 1], [2, 3]])
    good = dict(zip([p for p, _ in patterns], model.belongs(np.array([p for p, _ in patterns]))[:, 0]))
    assert good[-1, 1, 1, 1] > 0.9 and good[1, 1, -1, -1] < 0.1 and good[1, 1, -1, 0] < 0.5 and good[-1, -1, 1, 1] < 0.5
    every = list(itertools.product((-1, 0, 1), repeat=4))
    table = spark.createDataFrame(every, "a int, b int, c int, d int")
    got = {tuple(r[:4]): r["p"] for r in table.withColumn("p", quality.posterior(model, [F.col(c) for c in "abcd"])).collect()}
    assert [got[v] for v in every] == pytest.approx(model.belongs(np.array(every))[:, 0].tolist())


def test_exact(spark, odd, none):
    rows = exact.duplicate_groups(odd, capacity=1).collect()
    groups = defaultdict(list)
    for k, t in [*enumerate(ODD), (3, ODD[3])]:
        groups[lower(t)].append(k)
    want = sorted((k, max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
    assert Counter(r["text_sha256"] for r in rows if r["kept"]) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}) and all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    # Ids that repeat or are missing: one row of each text stays.
    some = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (7, "A", 3), (None, "c", 4), (None, "c", 5), (7, "A", 6), (None, "b", 7)], "doc_id long, text string, row int")
    kept = exact.keep_largest(some)
    assert kept.columns == some.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "c"), (5, "b"), (7, "A")]
    assert exact.duplicate_groups(none).count() == 0 and exact.keep_largest(odd).columns == odd.columns
    keys = spark.range(1000).select(F.xxhash64("id").alias("h"))
    dirs = {r["prefix"]: (r["depth"], r["bits"]) for r in exact.directory(keys, 50, 3, 5).collect()}
    held = Counter(dirs[r["h"] & 255] for r in keys.collect())
    assert max(held.values()) <= 50 and all(bits == prefix & ((1 << depth) - 1) for prefix, (depth, bits) in dirs.items())


def test_licences(spark, odd, none):
    mit = licences.TEMPLATES["MIT"]
    rows = [(1, f"word\n{mit.upper()}\nmore"), (2, "Licensed under the Apache License Version 2.0"), (3, mit[:200]), (4, None), (5, "head\n\nReleased under\nthe MIT License.\n\ntail")]
    got = {r["doc_id"]: r["licences"] for r in licences.licences_by_document(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0-line", 3: "", 4: "", 5: "MIT-line"}
    lost = spark.createDataFrame([(None, "Released under the MIT License."), (1, None), (1, None)], "doc_id long, text string")
    assert sorted(r["n_matches"] for r in licences.licences_by_document(lost).collect()) == [0, 0, 1]
    units = {(r["kind"], r["number"]) for r in licences.licence_matches(spark.createDataFrame([(1, "x\n\nReleased under\nthe MIT License.\n\nReleased under the MIT License.")], "doc_id long, text string")).collect()}
    assert units == {("block", 1), ("line", 5), ("text", 0)}
    assert licences.licences_by_document(odd).count() == len(ODD) + 1 and licences.licences_by_document(none).count() == 0


def test_licence_anchors():
    """Texts that reach the coefficient with a template, by dropping and adding words, always hold an anchor."""
    pattern = re.compile(licences.anchors(licences.TEMPLATES))
    rng = random.Random(5)
    for text in licences.TEMPLATES.values():
        tokens = re.findall("[a-z0-9]+", text.lower())
        whole = set(itertools.pairwise(tokens))
        for _ in range(40):
            some = [w if rng.random() > 0.15 else "zzz" for w in tokens]
            got = set(itertools.pairwise(some))
            if 2 * len(got & whole) >= licences.DICE * (len(got) + len(whole)):
                assert pattern.search(" ".join(some))


def test_licences_long_text(spark):
    """A text of over a megabyte, every line of it with an anchor."""
    text = "\n".join(f"the software of line {k} and more\n" * 2 for k in range(16000))
    assert len(text) > 1_000_000
    row = licences.licences_by_document(spark.createDataFrame([(1, text + "\nReleased under the MIT License.")], "doc_id long, text string")).first()
    assert row["n_matches"] == 1


def slow_print(text, n=4):
    w = words(text)
    shingles = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, small, odd, none):
    rows = queries.op8_simhash_near_dedup(spark, SMALL).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    assert prints == {k: slow_print(t) for k, t in small.items()}
    ids = sorted(prints)
    root = {k: k for k in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {r["doc_id"]: r["component_id"] for r in rows} == {k: find(k) for k in ids}
    lost = spark.createDataFrame([(None, "same text", 1), (None, "same text", 2), (4, "same text", 3), (4, "same text", 4), (None, "b c d e f g h", 5)], "doc_id long, text string, row int")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one_of_each(lost).collect()) == [(0, "b c d e f g h"), (4, "same text")]
    assert simhash.keep_one_of_each(lost).columns == lost.columns and simhash.keep_one_of_each(none).count() == 0
    assert simhash.near_duplicate_classes(odd).count() == len(ODD) + 1 and simhash.near_duplicate_classes(none).count() == 0


def test_simhash_components(spark):
    """Clouds of near fingerprints: what the chains and leaders find equals all pairs."""
    rng = random.Random(4)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    want = defaultdict(set)
    for p in prints:
        want[find(p)].add(p)
    table = spark.createDataFrame([(simhash._signed(p), 1) for p in prints], "fp long, n long")
    got = defaultdict(set)
    for r in simhash.link_components(table).collect():
        got[r["root"]].add(r["fp"] % (1 << 64))
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_pigeonring_covers_all_differences():
    ring, keys, budgets = simhash.ring_masks(), simhash.key_masks(), simhash.chain_budgets()
    rng = random.Random(9)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(d & keys[3 * s + left] == 0 and all((d & sum(ring[(s + k) % 13] for k in range(n))).bit_count() <= b for n, b in budgets) for s in range(13) for left in range(3))


def test_pieces(spark, small, odd, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    model = pieces.PieceModel(pieces.model_path())
    texts = [t or "" for t in small.values()] + ["", " ", "  Hello  world\nnew é ☃ ", "日本語 テキスト", "aaaa" * 60, "<s> <0x0A> <unk>"]
    for text, ids in zip(texts, model.encode_batch(texts)):
        assert list(array("I", ids)) == library.encode(text) and model.decode(ids) == text
    assert pieces.encoded(odd, decode=True).count() == len(ODD) + 1 and pieces.encoded(none).count() == 0
    assert {r["text"] for r in pieces.decoded(pieces.encoded(odd)).collect()} == {t or "" for t in ODD}


def test_viterbi_equals_all_cuts():
    rng = random.Random(6)
    scores = {"".join(rng.choices("ab", k=rng.randint(1, 4))): -rng.random() * 5 for _ in range(14)} | {"a": -4.0, "b": -4.5}
    vocabulary = {p: (k, s) for k, (p, s) in enumerate(scores.items())}
    encoder = pieces.SharedPrefixEncoder(vocabulary, False, None, 99)
    strings = {"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(60)}
    by_id = {k: s for k, s in vocabulary.values()}
    for word, ids in encoder.encode_words(strings):
        cuts = ([word[i:j] for i, j in itertools.pairwise((0, *c, len(word)))] for n in range(len(word)) for c in itertools.combinations(range(1, len(word)), n))
        assert sum(by_id[i] for i in ids) == pytest.approx(max(sum(scores[p] for p in c) for c in cuts if all(p in scores for p in c)))


def plain_models(texts, shares, discount, ratio):
    """P_c(w) and P_c(w | v) of both classes by the docstring's formulas, with plain counters; texts are (text, class)."""
    runs = [{(a, v, w) for text, y in texts if y == c for a, v, w in zip(["", "", *text.split()], ["", *text.split()], text.split())} for c in (0, 1)]
    pair = [Counter((v, w) for _, v, w in r) for r in runs]
    single = [Counter(w for _, w in p) for p in pair]
    total = [sum(s.values()) for s in single]
    after = [Counter() for _ in (0, 1)]
    for c in (0, 1):
        for (v, _), n in pair[c].items():
            after[c][v] += n
    seen = set(single[0]) | set(single[1])
    shared = {w: sum(shares[c] * single[c][w] / (total[c] + 1) for c in (0, 1)) for w in seen}
    own = [{w: max(single[c][w] - ratio * total[c] * shared[w] - discount, 0) / max(total[c], 1) for w in seen} for c in (0, 1)]
    rest = [1 - sum(o.values()) for o in own]

    def low(c, w):
        return own[c].get(w, 0) + rest[c] * shared.get(w, 1 - sum(shared.values()))

    def of(counts, key):
        return sum(shares[c] / (total[c] + 1) * counts[c][key] for c in (0, 1))

    def own_pair(c, v, w):
        n = pair[c][v, w]
        return max(n - ratio * after[c][v] * of(pair, (v, w)) / of(after, v) - discount, 0) / after[c][v] if n else 0.0

    def high(c, v, w):
        kept = sum(own_pair(c, v, x) for x in seen)
        return own_pair(c, v, w) + (1 - kept) * low(c, w)

    return low, high, seen


def test_kneser_ney(spark, monkeypatch):
    """Both classes' probabilities against plain ones, their sums, and the differences of texts."""
    monkeypatch.setattr(toxicity, "DISCOUNT", 1.0)
    rng = random.Random(3)
    rows = [(" ".join(rng.choices("abcdef" if toxic == 0 else "abcxyx", k=rng.randint(0, 25))), toxic, half) for toxic in (0, 1) for half in (0, 1) for _ in range(8)]
    sample = spark.createDataFrame(rows, "text string, toxic int, half int")
    shares = [0.8, 0.2]
    ratio = toxicity.excess(shares)
    assert ratio == 2.0 and toxicity.excess([0.5, 0.5]) == 1.5 and toxicity.excess([0.0, 1.0]) == 2.0
    fitted = toxicity.models(sample, exact.Scratch(spark, "test"), shares)
    texts = ["", "a", "x y x", "a b c d e f", "unseen words x", "x x y unseen y x a b"]
    for name, halves in (("all", {0, 1}), ("half0", {0}), ("half1", {1})):
        low, high, seen = plain_models([(t, y) for t, y, h in rows if h in halves], shares, 1.0, ratio)
        for c in (0, 1):
            assert sum(low(c, w) for w in seen) + low(c, "unseen") == pytest.approx(1)
            for v in ["", *seen]:
                assert sum(high(c, v, w) for w in seen) + high(c, v, "unseen") == pytest.approx(1)
        want = []
        for t in texts:
            w = t.split()
            each = [np.log(high(1, v, x) / high(0, v, x)) for v, x in zip(["", *w], w)]
            want.append(np.mean(each) if each else np.log(low(1, "unseen") / low(0, "unseen")))
        assert fitted[name].differences(texts) == pytest.approx(want)
    assert len(fitted["all"].pairs.keys) and fitted["all"].differences(["x y x"])[0] > fitted["all"].differences(["a b c"])[0]
    assert toxicity.fit(sample.select("text", F.monotonically_increasing_id().alias("doc_id")).where("false"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) in (0.0, 1.0)


def test_smallest(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    for most in (1, 10, 700, 6000):
        got, want = sorted(r[0] for r in toxicity.smallest(keys, F.col("h"), most).collect()), sorted(r[0] for r in keys.collect())
        assert got == want[: len(got)] and min(most, 5000) <= len(got) <= 2 * most
    table = spark.createDataFrame([(f"w{k}", k % 3 + 1) for k in range(900)], "word string, n long")
    for most in (10, 300, 500, 2000):
        got = hmm.most_frequent(table, most).collect()
        assert 0.7 * min(most, 900) - 5 <= len(got) <= most and (len(got) >= 300 or {r["n"] for r in got} <= {3})


def test_toxicity(spark, odd, none):
    big = "/root/testdata/sf0.1"
    docs, marks = load(spark, big, "documents", "doc_id", "text"), load(spark, big, "labels")
    rows = queries.op10_toxicity(spark, big).join(marks, "doc_id").where("held_out")
    seen = rows.join(docs, "doc_id").select("score", "toxic", "predicted", "text").toPandas()

    def auc(x):
        pos, neg = (x[seen.toxic == k] for k in (1, 0))
        return ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()).item()

    assert auc(seen.score.to_numpy()) > 0.94 and (seen[seen.predicted == 1].toxic == 1).mean() > 0.95 and seen[seen.toxic == 1].predicted.mean() > 0.85
    # The score is the curve of the comparison and nothing else, and rises with it.
    model, curve = toxicity.fit(docs, marks)
    x = model.differences(seen.text.tolist())
    assert len(curve) == 2 and curve[1] > 0 and seen.score.to_numpy() == pytest.approx(1 / (1 + np.exp(-(curve[0] + curve[1] * x))))
    labels = load(spark, SMALL, "labels")
    assert toxicity.toxicity_scores(odd, labels).count() == len(ODD) + 1 and toxicity.toxicity_scores(none, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0.0}


def test_numbered_rows(spark, tmp_path):
    """Any set of numbers goes, over several blocks and buckets, and the rows themselves are not shuffled."""
    from sparklode.llm import rows as R

    rng = random.Random(2)
    docs = spark.range(0, 100_000, 1, 3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("Row"), F.lit(None).cast("string").alias("bits"))
    kept, row = R.with_row(docs, exact.Scratch(spark, "test"))
    numbers = {r[0]: r[1] for r in kept.select(row, "doc_id").collect()}
    assert len(numbers) == 100_000 and kept.columns[:3] == docs.columns
    gone = set(rng.sample(sorted(numbers), 40_000)) | {0, 32767, 32768}
    left = R.without(kept, row, spark.createDataFrame([(g,) for g in gone], "row long"))
    assert left.columns == docs.columns and {r[0] for r in left.select("doc_id").collect()} == {d for n, d in numbers.items() if n not in gone}
    plan = left._jdf.queryExecution().executedPlan().toString()
    rows_side = plan[plan.index("Join") : plan.index("FileScan")]
    assert "Bucketed: true" in plan and "Exchange" not in rows_side
    assert R.without(kept, row, spark.createDataFrame([], "row long")).count() == 100_000


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = load(spark, SMALL, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.judged(docs).where("kept").collect()}
    last = {}
    for k in kept:
        last[lower(texts[k])] = max(k, last.get(lower(texts[k]), k))
    rest = sorted(last.values())
    prints = {k: slow_print(texts[k]) for k in rest}
    root = {k: k for k in rest}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(rest, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {k for k in rest if find(k) == k}
    out = p.run(spark, SMALL)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == want
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == load(spark, SMALL, "documents").columns
    assert all(not base_secrets(r["text"]) for r in docs.collect())


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    """Every stage takes missing and repeated ids, clashing columns, empty tables and a text of over a megabyte."""
    import corpus_pipeline as p

    long = " ".join(f"word{k} of{k % 977}" for k in range(90_000))
    more = spark.createDataFrame([(None, long, "x", 1), (3, long, "y", 2), (None, None, None, None)], odd.schema)
    docs = odd.unionByName(more).withColumn("__kept", F.lit(1)).withColumn("row", F.lit(2)).withColumn("counts", F.lit("c"))
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    kept = p.exact_dedup(spark, p.quality_rules(spark, docs, SMALL), SMALL)
    assert [r["doc_id"] for r in kept.where("length(text) > 1000000").collect()] == [3]
    pieces_of = p.best_fit_packing(spark, docs, SMALL)
    assert pieces_of.where("piece = 0").count() == docs.count() and p.best_fit_packing(spark, docs.limit(0), SMALL).count() == 0
