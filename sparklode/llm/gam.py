"""A quality classifier: a generalised additive model with pairwise interactions.

A text's features are shares and logarithms of plain counts over the whole text (`FEATURES`). Each is put into one of at most
`BINS` bins at quantiles of the sample. The model adds an intercept, one lookup table per feature and one per chosen pair of
features, in log-odds:

    score = 1 / (1 + exp(-(b + sum of T_f[bin_f] + sum of T_fg[bin_f, bin_g])))

The tables are learned by cyclic boosting: in every round each feature in turn gets one shallow tree of at most three leaves on
its own bins, fitted to the gradient of the log-loss and shrunk by `RATE`, so that no feature takes what another explains as
well. The pairs whose best four-leaf tree gains most on what the single features leave are then boosted in the same way, with
trees that cut both features once. Trees only ever add to a table, so scoring is binning and adding.

Features are computed once for every document and written. The model is fitted on at most `SAMPLE` labelled documents, those
with the smallest hashes of doc_id, whose numbers (not texts) go to the driver. Rows whose crc32(doc_id as text) mod 4 is 2
are held out. A doc_id with several labels is good only if all say so; one with several rows trains with the row that has
the smallest features. Null and empty texts have all features 0 and are scored like others. Where one class has no labelled
rows, every score is the share of good labels, 0 if there are none. Repeated rows score alike; rows without doc_id are
scored and not held out; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.llm.quality import SYMBOLS, repeated_words
from sparklode.llm.toxicity import smallest
from sparklode.sources.scratch import Scratch

SAMPLE, FOLDS, HELD_OUT = 20_000, 4, 2
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE, LEAST = 32, 80, 40, 6, 0.15, 1.0, 5.0
FEATURES = ("words", "word_length", "symbols", "upper", "distinct", "repeats", "dup_lines", "line_words", "digits", "sentences", "same_as_before", "short_words")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def features_of(text: str | None) -> tuple[float, ...]:
    """The features of one text, in the order of FEATURES: of words (runs without ASCII white space) the logarithm of their
    number, mean bytes, `#*$%&|<>` and `!` per word, capitals per letter, distinct ones, those in repeated windows of five;
    repeated lines; logarithm of words per line; digits and sentence ends per word; words equal to the one before; words of
    at most two bytes."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)

    def count(these: bytes) -> int:
        return len(raw) - len(raw.translate(None, these))

    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    upper, lower = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"abcdefghijklmnopqrstuvwxyz")
    sizes = list(map(len, words))
    return (
        float(np.log1p(n)),
        sum(sizes) / n,
        count(SYMBOLS + b"!") / n,
        upper / max(1, upper + lower),
        len(set(words)) / n,
        repeated_words(words) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        count(b"0123456789") / n,
        count(b".?") / n,
        sum(map(bytes.__eq__, words[1:], words)) / n,
        sum(s <= 2 for s in sizes) / n,
    )


def text_features(docs: DataFrame) -> DataFrame:
    """(doc_id and FEATURES) of docs (doc_id, text), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([features_of(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def edges_of(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Lower edges of all bins but the first: distinct quantiles of `values`."""
    found = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))
    return found[found > values.min()]


def gain(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What a leaf with these sums takes off the loss; nothing below the least weight."""
    return np.where(weight >= LEAST, gradient**2 / (weight + RIDGE), -np.inf)


def best_cut(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """Gain of the best cut of bins into those before and from it on, against no cut; (0, 0) if none gains."""
    if len(gradient) < 2:
        return 0.0, 0
    left, below = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    total, all_ = gradient.sum(), weight.sum()
    gains = gain(left, below) + gain(total - left, all_ - below) - total**2 / (all_ + RIDGE)
    k = int(np.argmax(gains))
    return (float(gains[k]), k + 1) if gains[k] > 0 else (0.0, 0)


def shallow_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The value of each bin under a tree of at most three leaves: the best cut, then the better of the best cuts of its sides."""
    n = len(gradient)
    _, first = best_cut(gradient, weight)
    cuts = [0, n]
    if first:
        cuts = [0, first, n]
        sides = [best_cut(gradient[a:b], weight[a:b]) for a, b in itertools.pairwise(cuts)]
        side = int(sides[1][0] > sides[0][0])
        if sides[side][1]:
            cuts = sorted({*cuts, cuts[side] + sides[side][1]})
    out = np.zeros(n)
    for a, b in itertools.pairwise(cuts):
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + RIDGE)
    return out


def crossed_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best tree that cuts rows once and columns once, from sums by cell."""
    g, w = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (gradient, weight))
    rows, columns = gradient.shape
    if rows < 2 or columns < 2:
        return 0.0, np.zeros(gradient.shape)

    def quarters(s: np.ndarray) -> list[np.ndarray]:
        inner, right, below = s[1:rows, 1:columns], s[1:rows, columns:], s[rows:, 1:columns]
        return [inner, right - inner, below - inner, s[rows, columns] - right - below + inner]

    gs, ws = quarters(g), quarters(w)
    gains = sum(x**2 / (y + RIDGE) for x, y in zip(gs, ws)) - g[rows, columns] ** 2 / (w[rows, columns] + RIDGE)
    r, c = np.unravel_index(int(np.argmax(gains)), gains.shape)
    top, out = float(gains[r, c]), np.zeros(gradient.shape)
    if top <= 0:
        return 0.0, out
    places = [(slice(0, r + 1), slice(0, c + 1)), (slice(0, r + 1), slice(c + 1, None)), (slice(r + 1, None), slice(0, c + 1)), (slice(r + 1, None), slice(c + 1, None))]
    for place, x, y in zip(places, gs, ws):
        out[place] = x[r, c] / (y[r, c] + RIDGE)
    return top, out


@dataclass
class AdditiveModel:
    """Bin edges by feature, an intercept, a table per feature and a table per chosen pair of features."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        out = np.full(len(x), self.intercept)
        for table, b in zip(self.tables, at):
            out += table[b]
        for (f, g), table in self.pairs.items():
            out += table[at[f], at[g]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
    """The model of rows `x` with classes `y`, both of which occur."""
    share = y.mean()
    model = AdditiveModel([edges_of(c) for c in x.T], float(np.log(share / (1 - share))), [])
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    at = model.bins(x)
    odds = np.full(len(y), model.intercept)

    def sums(cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return np.bincount(cell, y - p, cells), np.bincount(cell, p * (1 - p), cells)

    for _ in range(rounds):
        for f, n in enumerate(sizes):
            step = RATE * shallow_tree(*sums(at[f], n))
            model.tables[f] += step
            odds += step[at[f]]

    def crossed(f: int, g: int) -> tuple[float, np.ndarray]:
        shape = sizes[f], sizes[g]
        return crossed_tree(*(s.reshape(shape) for s in sums(at[f] * sizes[g] + at[g], sizes[f] * sizes[g])))

    gains = {fg: crossed(*fg)[0] for fg in itertools.combinations(range(len(sizes)), 2)}
    chosen = [fg for fg in sorted(gains, key=lambda fg: (-gains[fg], fg))[:pairs] if gains[fg] > 0]
    model.pairs = {(f, g): np.zeros((sizes[f], sizes[g])) for f, g in chosen}
    for _ in range(pair_rounds):
        for f, g in chosen:
            step = RATE * crossed(f, g)[1]
            model.pairs[f, g] += step
            odds += step[at[f], at[g]]
    return model


def fit(features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel | float:
    """The model of a sample of labelled rows, or the share of good labels where one class has none."""
    seen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    seen = seen.agg((F.min("quality") > 0).cast("int").alias("good")).where(~held_out())
    held = features.join(seen, "doc_id").groupBy("doc_id").agg(F.first("good").alias("good"), F.min(F.struct(*FEATURES)).alias("x"))
    key = F.xxhash64("doc_id")
    held = Scratch(features.sparkSession, "gam-labels").keep(held, "labelled")
    rows = smallest(held, key, sample).orderBy(key, "doc_id").limit(sample).select("good", "x.*").toPandas()
    y = rows["good"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    return boosted(rows[list(FEATURES)].to_numpy(float), y)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features = Scratch(docs.sparkSession, "gam").keep(text_features(slim), "features")
    fitted = fit(features, labels, sample)
    if isinstance(fitted, float):
        scored = features.select("doc_id", F.lit(fitted).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(fitted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))], names=["doc_id", "score"])

        scored = features.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
