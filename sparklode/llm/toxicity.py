"""Toxicity by two class-conditional Kneser-Ney models.

Words are runs of non-white-space (ASCII white space) with A-Z lower-cased; in counts each is its XXH64. For each class c,
toxic and ordinary, the probability of a word w after the word v is

    P_c(w | v) = own_c(v, w) / N_c(v) + g_c(v) * P_c(w),     own_c(v, w) = max(n_c(v, w) - r * E_c(v, w) - D, 0)
    P_c(w)     = own_c(w) / N_c + g_c * S(w),                own_c(w)    = max(n_c(w) - r * E_c(w) - D, 0)

n_c(v, w) and n_c(w) are continuation counts: the different words that come before the pair or word in class c, so copies
of a text don't raise them. N are their sums. S is the backoff that both classes share: the classes' continuation shares,
weighted by how many labelled rows each has, unseen words together counting as one more word. E_c is the count that the
shared rates explain: N_c * S(w), and N_c(v) times the share of w among what follows v in both classes. A class so keeps a count of its
own only for what it says more than r times as often as all text does, beyond the discount D; everything else, and every rare expression,
backs off to the same shared probability in both. g is the mass that is left, so each P_c(. | v) is a distribution. r is
`EXCESS`, but at most half way to the rate of an expression that only the smaller class has.

The score is a logistic curve of one number, the difference of the two length-normalised log-likelihoods of the whole text, toxic less
ordinary. Words and pairs without counts of their own add log(g_toxic / g_ordinary) whatever they are, so only expressions
with counts of their own leave the tables: each has more than D different words before it.

The models are fitted on at most `PER_CLASS` labelled rows of each class, those with the smallest hashes of doc_id; no word of
theirs is left out. The curve is fitted on the same rows, each half of them compared by the models of the other half, weighted to the
shares of all labelled rows. Rows whose crc32(doc_id as text) mod 5 is 0 are held out from both. A doc_id with several
labels is toxic if any says so. Null and empty texts score like texts whose words are all shared; without labelled rows of
both classes every score is the share of toxic labels, 0 if there are none. Repeated rows score alike; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.sources.scratch import Scratch

DISCOUNT, EXCESS, PER_CLASS, FOLDS, RIDGE = 3.0, 2.0, 4000, 5, 0.1
#: What stands before a text's first word, and a factor that makes one number of two words.
START, MIX = 0, 0x9E3779B97F4A7C15


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    """Whether the id's crc32 falls into the fold that is kept out of training; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def hashes_of(text: str | None) -> np.ndarray:
    """The words of a text as XXH64."""
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def before(words: np.ndarray) -> np.ndarray:
    """The word before each word."""
    return np.concatenate([np.array([START], np.uint64), words[:-1]])


def pairs_of(left: np.ndarray, words: np.ndarray) -> np.ndarray:
    return left * np.uint64(MIX) ^ words


class Lookup:
    """Rows of numbers by key, and a row for missing keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: list[float]) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.vstack([values.reshape(-1, len(missing))[order], missing])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        missing = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        return self.values[np.where(missing, len(self.values) - 1, at)]


@dataclass
class Model:
    """What is a class's own (ordinary, toxic): of words own_c(w) / N_c and S(w), of pairs own_c(v, w) / N_c(v), of left words
    g_c(v); and g_c."""

    words: Lookup
    pairs: Lookup
    lefts: Lookup
    rest: np.ndarray

    @classmethod
    def of(cls, words: pd.DataFrame, pairs: pd.DataFrame) -> Model:
        """words: w, own_0, own_1, shared of all words with own counts or own pairs; pairs: v, w, own_0, own_1."""

        def number(frame: pd.DataFrame, name: str) -> np.ndarray:
            return frame[name].to_numpy(np.int64).view(np.uint64)

        own = pairs[["own_0", "own_1"]].to_numpy(float)
        lefts, at = np.unique(number(pairs, "v"), return_inverse=True)
        held = np.zeros((len(lefts), 2))
        np.add.at(held, at, own)
        alone = words[["own_0", "own_1", "shared"]].to_numpy(float)
        # A word that has no row has no counts of its own; its shared probability cancels, so any stands for it.
        return cls(Lookup(number(words, "w"), alone, [0, 0, 1]), Lookup(pairs_of(number(pairs, "v"), number(pairs, "w")), own, [0, 0]), Lookup(lefts, 1 - held, [1, 1]), 1 - alone[:, :2].sum(axis=0))

    def single(self, words: np.ndarray) -> np.ndarray:
        """P_c(w) of each word, by class; times a number that both classes share where a word has no row."""
        found = self.words(words)
        return found[:, :2] + self.rest * found[:, 2:]

    def after(self, left: np.ndarray, words: np.ndarray) -> np.ndarray:
        """P_c(w | v) of each word after its left word, by class; as in `single`."""
        return self.pairs(pairs_of(left, words)) + self.lefts(left) * self.single(words)

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """Each text's difference of length-normalised log-likelihoods, toxic less ordinary. The texts go together."""
        split = [hashes_of(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        out = np.full(len(texts), np.log(self.rest[1]) - np.log(self.rest[0]))
        some = np.nonzero(sizes)[0]
        if len(some):
            words = np.concatenate([split[k] for k in some])
            left = np.concatenate([before(split[k]) for k in some])
            p = self.after(left, words)
            out[some] = np.add.reduceat(np.log(p[:, 1]) - np.log(p[:, 0]), np.cumsum(sizes[some]) - sizes[some]) / sizes[some]
        return out


def together(texts: list[str | None], characters: int = 200_000) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about so many characters, so that a task holds the words of few of them at a time."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if held >= characters:
            yield part
            part, held = [], 0
    if part:
        yield part


def scores(model: Model, curve: np.ndarray, texts: list[str | None]) -> np.ndarray:
    parts = [model.differences(part) for part in together(texts)]
    return 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * np.concatenate(parts), -500, 500))) if parts else np.zeros(0)


def logistic(features: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 40) -> np.ndarray:
    """Intercept and slopes of a ridge-penalised weighted logistic regression, by Newton steps."""
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(features)), (features - mean) / spread])
    w, penalty = np.zeros(x.shape[1]), ridge * np.array([1e-6] + [1.0] * features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - penalty * w)
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    slopes = w[1:] / spread
    return np.concatenate([[w[0] - slopes @ mean], slopes])


def smallest(table: DataFrame, key: Column, most: int, bits: int = 12) -> DataFrame:
    """The `most` rows with the smallest `key`, a spread 64-bit hash, and no more than as many again, unless keys repeat.

    Histograms of the key's leading bits, each of the part that the one before cuts, find the limit. They have at most
    2^bits rows, whatever the input, and nothing of the rows themselves goes to the driver.
    """
    spread = key.bitwiseXOR(F.lit(-(1 << 63)))
    inside, below = table, 0
    for shift in range(64 - bits, -1, -bits):
        part = F.shiftrightunsigned(spread, shift)
        for place, n in sorted(tuple(r) for r in inside.groupBy(part.alias("part")).count().collect()):
            if below + n >= most:
                break
            below += n
        else:
            return table
        if n <= most or shift < bits:
            return table.where(part <= place)
        inside = table.where(part == place)
    return table


def sampled_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, list[int]]:
    """(text, toxic, half) of the labelled rows the models are fitted on, and how many labelled rows each class has."""
    seen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    seen = seen.where(~held_out())
    held = {r["toxic"]: r["count"] for r in seen.groupBy("toxic").count().collect()}
    key = F.xxhash64("doc_id")
    chosen = [smallest(seen.where(F.col("toxic") == k), key, per_class).orderBy(key, "doc_id").limit(per_class) for k in (0, 1)]
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half")
    sample = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("text", "toxic", half)
    return sample, [held.get(0, 0), held.get(1, 0)]


def triples(sample: DataFrame) -> DataFrame:
    """(toxic, half, a, v, w): each different run of two words before a word, as numbers, of sample (text, toxic, half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = hashes_of(text.as_py())
                if len(words):
                    left = before(words)
                    runs = np.unique(np.column_stack([before(left), left, words]), axis=0).view(np.int64)
                    same = [pa.array(np.full(len(runs), x, np.int32)) for x in (toxic, half)]
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(np.ascontiguousarray(c)) for c in runs.T)], names=["toxic", "half", "a", "v", "w"])

    return sample.mapInArrow(run, "toxic int, half int, a long, v long, w long")


#: Which rows a set of counts is taken from: all, or one half; and the classes.
TAKEN, CLASSES = ("all", "half0", "half1"), (0, 1)


def _taken(name: str) -> Column:
    return F.lit(True) if name == "all" else F.col("in" + name[-1])


def continuation_counts(sample: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Word counts (w, and by set and class) and pair counts (v, w, and by set and class) of the sample; written."""
    where = [F.max(F.col("half") == k).alias(f"in{k}") for k in (0, 1)]
    runs = scratch.keep(triples(sample).groupBy("toxic", "a", "v", "w").agg(*where), "runs")
    each = [F.count_if((F.col("toxic") == c) & _taken(t)).cast("double").alias(f"{t}_{c}") for t in TAKEN for c in CLASSES]
    pairs = scratch.keep(runs.groupBy("v", "w").agg(*each), "pairs")
    lefts = runs.groupBy("toxic", "v", "w").agg(*[F.max(f"in{k}").alias(f"in{k}") for k in (0, 1)])
    return scratch.keep(lefts.groupBy("w").agg(*each), "words"), pairs


def excess(shares: list[float]) -> float:
    return min(EXCESS, (1 + 1 / max(min(shares), 1e-9)) / 2)


def own_counts(words: DataFrame, pairs: DataFrame, taken: str, shares: list[float]) -> tuple[DataFrame, DataFrame]:
    """(w, own_0, own_1, shared) and (v, w, own_0, own_1) of one set, only what has counts of its own or is part of such a pair."""
    name = [f"{taken}_{c}" for c in CLASSES]
    ratio = excess(shares)
    totals = words.agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in name]).first()
    shared = sum(F.lit(shares[c] / (totals[c] + 1)) * F.col(name[c]) for c in CLASSES)
    more = lambda n, expected, total: F.greatest(n - ratio * expected - DISCOUNT, F.lit(0.0)) / F.greatest(total, F.lit(1.0))
    alone = [more(F.col(name[c]), totals[c] * shared, F.lit(totals[c])).alias(f"own_{c}") for c in CLASSES]

    # What follows a left word, by class; only pairs with more than the discount can have a count of their own.
    after = pairs.groupBy("v").agg(*[F.sum(name[c]).alias(f"after_{c}") for c in CLASSES])
    often = pairs.where(F.greatest(*name) > DISCOUNT).join(after, "v")
    rate = lambda of: sum(F.lit(shares[c] / (totals[c] + 1)) * F.col(of[c]) for c in CLASSES)
    afters = [f"after_{c}" for c in CLASSES]
    share = rate(name) / rate(afters)
    paired = often.select("v", "w", *[more(F.col(name[c]), F.col(afters[c]) * share, F.col(afters[c])).alias(f"own_{c}") for c in CLASSES])
    paired = paired.where("own_0 + own_1 > 0")
    ends = paired.select("w", F.lit(True).alias("ends")).distinct()
    told = words.select("w", *alone, shared.alias("shared")).join(ends, "w", "left").where("own_0 + own_1 > 0 or ends").drop("ends")
    return told, paired


def models(sample: DataFrame, scratch: Scratch, shares: list[float]) -> dict[str, Model]:
    """The models of all sampled rows and of each half; `shares` are the classes' shares of the labelled rows."""
    words, pairs = continuation_counts(sample, scratch)
    return {t: Model.of(*(table.toPandas() for table in own_counts(words, pairs, t, shares))) for t in TAKEN}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Model, np.ndarray] | float:
    """The model of all sampled rows and the curve, or the share of toxic labels where one class has none."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample, held = sampled_rows(docs, labels, per_class)
    if not all(held):
        return held[1] / max(1, sum(held))
    sample = scratch.keep(sample, "sample")
    fitted = models(sample, scratch, [h / sum(held) for h in held])
    shared = docs.sparkSession.sparkContext.broadcast((fitted["half0"], fitted["half1"]))

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, y, halves = (c.to_pylist() for c in batch.columns)
            for half in (0, 1):
                mine = [k for k, h in enumerate(halves) if h == half]
                for part in together([texts[k] for k in mine]):
                    done, mine = mine[: len(part)], mine[len(part) :]
                    yield pa.RecordBatch.from_arrays([pa.array([float(y[k]) for k in done]), pa.array(shared.value[1 - half].differences(part))], names=["y", "x"])

    seen = sample.mapInArrow(crossed, "y double, x double").toPandas().to_numpy(float)
    shared.unpersist()
    y = seen[:, 0]
    have = np.array([(y == 0).sum(), (y == 1).sum()])
    if not have.all():
        return held[1] / sum(held)
    weight = np.where(y == 1, held[1] / have[1], held[0] / have[0]) * len(y) / sum(held)
    return fitted["all"], logistic(seen[:, 1:], y, weight)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fitted = fit(slim, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), per_class)
    if isinstance(fitted, float):
        scored = slim.select("doc_id", F.lit(fitted).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(fitted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = scores(*shared.value, batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

        scored = slim.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
