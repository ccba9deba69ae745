"""Indexes, joins of similar texts, live rooms and scratch folders against brute force."""

from __future__ import annotations

import itertools
import os
import random
import subprocess
import sys
import textwrap

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparklode.functions import text as T
from sparklode.operators import neighbours, setjoin
from sparklode.plans import live
from sparklode.sources import load
from sparklode.sources.scratch import Scratch, application_dir, discard
from tests.conftest import ROOT, SMALL


def test_scratch_without_a_setting(tmp_path):
    """A local session whose configuration names no shared folder still has scratch tables, and discards them."""
    code = """
        import os
        from sparklode.session import build_session
        from sparklode.sources.scratch import Scratch, application_dir, discard, shared_dir
        spark = build_session("local[1]", 1, "bare")
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        kept = Scratch(spark, "some").keep(spark.range(3), "t")
        assert kept.count() == 3 and shared_dir(spark) == shared_dir(spark)
        place = application_dir(spark).removeprefix("file://")
        assert os.path.isdir(place)
        discard(spark)
        assert not os.path.exists(place)
        print("fine")
    """
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def nearest_by_force(vectors, offered, k):
    ids = np.array(sorted(vectors))
    v = np.stack([vectors[i] for i in ids]).astype(float)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    sims = np.round(v @ v.T, 9)
    out = {}
    for row, i in zip(sims, ids):
        order = sorted((-s, j) for s, j in zip(row, ids.tolist()) if j != i and offered[j])[:k]
        out[int(i)] = [(j, -s) for s, j in order]
    return out


@pytest.mark.parametrize("shelf,asked", [(20_000, 20_000), (40, 25)])
def test_nearest_to_all(spark, shelf, asked):
    """Clusters, equal and zero vectors, rows that only ask, cells split over shelves: the answers of all pairs."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 4
    vectors = {k: (centres[k % 6] + rng.normal(size=8) * 0.3).astype("float32") for k in range(150)}
    vectors |= {k: vectors[3] for k in range(200, 290)} | {k: np.zeros(8, "float32") for k in (300, 301)}
    offered = {k: k % 7 != 0 for k in vectors}
    rows = spark.createDataFrame([(k, v.tolist(), offered[k]) for k, v in vectors.items()], "k long, e array<float>, ok boolean")
    got = {}
    for r in neighbours.nearest_to_all(rows, "k", "e", 4, F.col("ok"), shelf, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], pytest.approx(r["similarity"])))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == nearest_by_force(vectors, offered, 4)
    assert neighbours.nearest_to_all(rows.limit(0), "k", "e", 3).count() == 0
    assert neighbours.nearest_to_all(rows, "k", "e", 3, F.lit(False)).count() == 0


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 6)) * 5
    v = np.concatenate([c + rng.normal(size=(60, 6)) * 0.2 for c in centres])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pivots = neighbours.fitted_pivots(v, 30)
    far = neighbours.distances(v, pivots)
    cell = far.argmin(axis=1)
    cells = neighbours.Cells(pivots, {c: (int((cell == c).sum()), float(far[cell == c, c].max())) for c in set(cell.tolist())})
    bounds, all_ = cells.bounds(v), neighbours.distances(v, v)
    for c in set(cell.tolist()):
        assert (all_[:, cell == c].min(axis=1) >= bounds[:, c] - 1e-6).all()
    shelf = pd.DataFrame({"id": np.arange(len(v)), "cell": cell, "v": list(v)})
    found, pairs = neighbours.compared(cells, shelf, shelf.assign(worst=-np.inf), 6)
    assert len(found) == 6 * len(v) and pairs < len(v) ** 2 / 3


def test_shelves():
    """Every row of a cell is on one of the cell's shelves, and none holds more than its size but by the hash's spread."""
    rng = np.random.default_rng(2)
    sizes = {c: (int(rng.integers(1, 400)), 1.0) for c in range(50) if c % 9}
    cells = neighbours.Cells(np.zeros((50, 2)), sizes, 100)
    rows = np.concatenate([np.full(n, c) for c, (n, _) in sizes.items()])
    at = cells.home(rows, np.concatenate([np.arange(n) for n, _ in sizes.values()]))
    assert at.max() + 1 == cells.shelves and np.bincount(at).max() <= 100
    for c, (n, _) in sizes.items():
        assert len(set(at[rows == c])) == -(-n // 100) if n > 100 else len(set(at[rows == c])) == 1


def sets_by_force(sets, least):
    out = {}
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if x and y and len(x & y) >= least * len(x | y):
            out[a, b] = pytest.approx(len(x & y) / len(x | y))
    return out


def test_similar_sets(spark):
    rng = random.Random(3)
    base = [rng.sample(range(300), rng.randint(1, 40)) for _ in range(12)]
    sets = {k: {str(x) for x in base[k % 12] if rng.random() > 0.08} | {str(x) for x in rng.sample(range(300), rng.choice([0, 0, 1, 3]))} for k in range(140)}
    sets[500] = set()
    rows = spark.createDataFrame([(k, sorted(s) + sorted(s)[:1]) for k, s in sets.items()], "id long, set array<string>")
    for least in (0.5, 0.8, 1.0):
        got = {(r["a"], r["b"]): r["jaccard"] for r in setjoin.similar_sets(rows, least).collect()}
        assert got == sets_by_force(sets, least)
    assert setjoin.similar_sets(rows.limit(0), 0.8).count() == 0


def test_similar_trigrams_of_documents(spark):
    """Trigrams of all documents' texts: the prefix filter loses no pair that all pairs have."""
    texts = {r["doc_id"]: (r["text"] or "").lower() for r in load(spark, SMALL, "documents").collect()}
    sets = {k: {t[i : i + 3] for i in range(len(t) - 2)} if len(t) > 2 else {t} for k, t in texts.items()}
    rows = load(spark, SMALL, "documents").select(F.col("doc_id").alias("id"), T.trigrams(F.lower("text")).alias("set"))
    got = {(r["a"], r["b"]) for r in setjoin.similar_sets(rows, 0.8).select("a", "b").collect()}
    assert got == set(sets_by_force(sets, 0.8))


def ratio_by_table(a, b):
    """The longest common subsequence by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def test_similar_texts(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    texts = {k: " ".join(rng.choices(words, k=30)) for k in range(8)}
    for k in range(8, 40):
        w = texts[rng.randrange(8)].split(" ")
        w[rng.randrange(len(w))] = rng.choice(["new", "7", "more words"])
        texts[k] = " ".join(w)
    texts |= {50: texts[9], 51: texts[9], 52: "", 53: None, 54: "one two", 55: "one two"}
    rows = spark.createDataFrame(list(texts.items()), "id long, flat string")
    pairs, members = setjoin.similar_texts(rows, setjoin.shingles(F.col("flat"), 2), 0.6, 0.9)
    first = {}
    for k in sorted(texts):
        first.setdefault(texts[k], k)
    assert {r["id"]: r["root"] for r in members.collect()} == {k: first[t] for k, t in texts.items() if t}
    runs = {k: set(map(" ".join, itertools.pairwise(t.split(" ")))) or {t} for t, k in first.items() if t}
    near = sets_by_force(runs, 0.6)
    digits = {k: sorted(w.strip("w") for w in texts[k].split(" ") if any(c.isdigit() for c in w)) for k in runs}
    want = {p: ratio_by_table(*(texts[k] for k in p)) for p in near if digits[p[0]] == digits[p[1]]}
    assert {(r["a"], r["b"]): r["ratio"] for r in pairs.collect()} == {p: pytest.approx(x) for p, x in want.items() if x >= 0.9}
    assert setjoin.similar_texts(rows.limit(0), F.split("flat", " "), 0.8)[0].count() == 0


def rooms_by_fold(events, countdown, cooldown):
    """The rooms' messages event by event, with plain dictionaries."""
    state, out = {}, []
    for room, event, player, kind, points, ms in sorted(events, key=lambda e: (e[5], e[1])):
        s = state.setdefault(room, {"start": None, "in": {}, "score": {}, "last": {}})
        say = lambda k, at=None, score=None: out.append((room, event, player, k, at, score))  # noqa: B023, E731
        if kind == "join":
            if player not in s["in"] and len(s["in"]) >= 2:
                say("refused")
                continue
            if not s["in"].get(player):
                s["in"][player] = True
                s["score"].setdefault(player, 0)
                say("join")
            if s["start"] is None and list(s["in"].values()).count(True) == 2:
                s["start"] = ms + 1000 * countdown
                say("start", s["start"])
        elif not s["in"].get(player):
            continue
        elif kind == "leave":
            s["in"][player] = False
            say("leave")
        elif kind == "hello":
            say("board", None, sum(v for p, v in s["score"].items() if p != player))
            if s["start"] is not None:
                say("start", s["start"])
        elif kind == "emoji" and ms - s["last"].get(player, -(10**15)) >= 1000 * cooldown:
            s["last"][player] = ms
            say("emoji")
        elif kind == "answer" and s["start"] is not None and ms >= s["start"]:
            s["score"][player] += points
            say("score", None, s["score"][player])
    return out


def messages(frame):
    key = ["room", "event_id", "player", "kind", "at", "score"]
    return sorted(tuple(r[k] for k in key) for r in frame.select(key).collect() if r["kind"] != "closed")


def order(rows):
    return sorted(rows, key=str)


def test_duel_rooms(spark):
    events = load(spark, SMALL, "events").selectExpr(*live.ROOMS).selectExpr("room", "event_id", "player", "kind", "points", "unix_millis(ts) as ms").collect()
    got = live.duel_rooms(spark, SMALL).collect()
    want = rooms_by_fold([tuple(e) for e in events], 5, 36_000)
    assert order([tuple(r) for r in got]) == order(want) and {k for *_, k, _, _ in want} >= {"join", "leave", "start", "board", "emoji", "score", "refused"}


def test_rooms_expire(spark, tmp_path):
    """An idle room is closed once the watermark has passed its limit, and its state is gone: the next start is a new one."""
    stamp = lambda h: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)
    rows = [(0, 0, "view"), (1, 1, "view"), (60, 9, "view"), (120, 0, "view"), (121, 1, "view")]
    for k, (hour, user, kind) in enumerate(rows):
        pd.DataFrame({"event_id": [k], "ts": [stamp(hour)], "user_id": [user], "event_type": [kind], "value": [1.0], "props": [""]}).astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/{k}.parquet")
    got = live.room_messages(spark, f"{tmp_path}/", "1 minute", 10 * 3600, 2).where("room = 0").orderBy("at").collect()
    at = [r["at"] for r in got if r["kind"] == "start"]
    assert len(at) == 2 and at[1] - at[0] == 120 * 3_600_000
    closed = [r["at"] for r in got if r["kind"] == "closed"]
    assert closed[:1] == [int(stamp(11).timestamp() * 1000)]


def test_discard(spark):
    kept = Scratch(spark, "gone").keep(spark.range(2), "t")
    assert kept.count() == 2 and application_dir(spark) in kept.inputFiles()[0].replace("file:///", "file:///")
    assert callable(discard)


def test_event_log_goes_on(spark, tmp_path):
    """Rows with faults are refused, and a batch that can't be written is told of, while the stream ends well."""
    from sparklode.streaming import counters

    for k in range(3):
        pd.DataFrame({"event_id": [2 * k, 2 * k + 1], "ts": [pd.Timestamp("2024-01-01")] * 2, "user_id": [k, k], "event_type": ["view", "odd"], "value": [1.0, None], "props": ["", ""]}).astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/in-{k}.parquet")
    faults = {"kind": F.col("event_type") == "odd", "value": F.col("value") > 5, "boom": F.when(F.col("event_id") == 2, F.raise_error(F.lit("no")).cast("boolean"))}
    counters.event_log(counters.event_stream(spark, f"{tmp_path}/"), faults, f"{tmp_path}/log", f"{tmp_path}/checkpoint")
    refused = spark.read.parquet(f"{tmp_path}/log/refused").collect()
    assert {(r["event_id"], tuple(r["faults"])) for r in refused} == {(1, ("kind",)), (5, ("kind",))}
    assert len(spark.read.parquet(f"{tmp_path}/log/failed").collect()) == 1


def test_latest_result(spark, tmp_path):
    """Over several batches the newest whole result is what is read, and only it and the one before stay."""
    from sparklode.streaming import counters

    rows = pd.DataFrame({"event_id": range(40), "ts": [pd.Timestamp("2024-01-01")] * 40, "user_id": [k % 3 for k in range(40)], "event_type": ["purchase"] * 40, "value": [1.0] * 40, "props": [""] * 40}).astype({"ts": "datetime64[us]"})
    os.makedirs(f"{tmp_path}/in")
    for k in range(4):
        rows[k * 10 : k * 10 + 10].to_parquet(f"{tmp_path}/in/{k}.parquet")
    stream = counters.counters(counters.event_stream(spark, f"{tmp_path}/in/"))
    assert counters.latest(spark, f"{tmp_path}/out", stream.schema).count() == 0
    counters.latest_result(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {r["item"]: r["shown"] for r in counters.latest(spark, f"{tmp_path}/out", stream.schema).collect()}
    assert got == {0: 14, 1: 13, 2: 13} and len([d for d in os.listdir(f"{tmp_path}/out") if not d.startswith((".", "_"))]) == 2
