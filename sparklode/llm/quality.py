"""Quality rules by weak supervision.

Words are runs of non-white-space (ASCII white space); null text has none. Counts of each whole text: n_words,
word_chars (code points in words), n_symbols (characters of `#*$%&|<>`), n_dup_lines (lines with a word that equal an
earlier line), n_repeat_words (words in 5-word windows that occur twice or more, the first occurrence included).

Rules vote good (1), bad (-1) or abstain (0) on those counts and a few more; where counts of a short text say little, rules
abstain. How they vote is a latent-class model: a document is good, or bad in one of the few `KINDS`, each of which several
rules speak for, as texts that fail by noise need not fail by repetition. In each class every rule has its own probability of voting
bad, given that it votes; an abstaining rule says nothing. These accuracies and the classes' shares are estimated without
labels by expectation-maximisation over the table of vote patterns, which has at most 3^rules rows whatever the input. A kind
starts where its own rules vote bad more often than not and the others as on good documents, and these rates, added as the votes
of `ANCHOR` of all documents, keep a kind from turning into the failure of a single rule.

The posterior probability of being good, not the passing of all rules, decides: a document is kept when it does not fail the base
rule and its posterior is at least one half. One bad vote of a rule that also fires on good documents is so outweighed by the
good votes of the others, while one that good documents never get is enough. Without documents the model is its start. Null
and empty texts have all counts 0 and fail the base rule. An empty table gives no rows; equal texts and repeated rows get equal results,
whatever their ids, also where those are missing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparklode.llm.rows import sliced, spare
from sparklode.sources.scratch import Scratch

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_ends", "n_distinct", "n_short")
#: The bad kinds, and the rules that speak for each.
KINDS = {"noise": ("symbols", "mean_word", "short_words"), "repetition": ("repeats", "dup_lines", "distinct"), "shape": ("length", "upper", "ends")}
#: Where estimation starts: the share of good documents, and how often a rule votes bad on them and on a kind it speaks for. The
#: start counts as the votes of so large a share of all documents, and of `PSEUDO_VOTES` at least.
START_GOOD, BAD_ON_GOOD, BAD_ON_ITS_KIND, ANCHOR, PSEUDO_VOTES, ROUNDS = 0.85, 0.02, 0.6, 0.02, 10.0, 60
#: Under so many words the rules on words and line ends abstain.
ENOUGH_WORDS = 30


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur at least twice in `words`."""
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    keys, kinds = ids, len(seen)
    n = len(ids) - window + 1
    for k in range(1, window):
        keys = keys[:-1] * len(seen) + ids[k:]
        kinds *= len(seen)
        if k + 1 < window and kinds > (1 << 62) // len(seen):
            _, keys = np.unique(keys, return_inverse=True)
            kinds = len(keys)
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.zeros(len(ids) + 1, np.int64)
    again = np.nonzero(count[place] > 1)[0]
    starts[again] += 1
    np.subtract.at(starts, again + window, 1)
    assert len(place) == n
    return int((np.cumsum(starts)[:-1] > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of NAMES."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [line for line in raw.split(b"\n") if not line.isspace() and line]
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = upper + len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        letters,
        sum(line.rstrip()[-1:] in (b".", b"!", b"?", b":", b";") for line in lines),
        len(set(words)),
        sum(len(w) <= 3 for w in words),
    )


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id and the counts of NAMES), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([counts_of(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in table.T)], names=["doc_id", *NAMES])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES))


def base_failed(of: dict[str, Column] | None = None) -> Column:
    """Whether the base rule fails; `of` gives the counts by name where they are not columns of their own."""
    words, repeats = (of[n] if of else F.col(n) for n in ("n_words", "n_repeat_words"))
    return (words < 10) | (100 * repeats > 20 * words)


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rules(of: dict[str, Column] | None = None) -> dict[str, Column]:
    """Votes by name; the thresholds between good and bad are where a rule abstains. `of` as in `base_failed`."""
    of = of or {n: F.col(n) for n in NAMES}
    words = of["n_words"]
    per_word = lambda n: of[n] / F.greatest(words, F.lit(1))
    per_line = lambda n: of[n] / F.greatest(of["n_lines"], F.lit(1))
    symbols, mean, repeats, distinct, short = map(per_word, ("n_symbols", "word_chars", "n_repeat_words", "n_distinct", "n_short"))
    repeated, ends = map(per_line, ("n_dup_lines", "n_ends"))
    upper = of["n_upper"] / F.greatest(of["n_letters"], F.lit(1))
    enough = lambda vote: F.when(words < ENOUGH_WORDS, 0).otherwise(vote)
    return {
        "length": _vote(words, words >= 60, words < 30),
        "symbols": _vote(symbols, symbols < 0.05, symbols > 0.2),
        "mean_word": enough(_vote(mean, (mean > 4) & (mean < 6.5), (mean < 3.5) | (mean > 7))),
        "repeats": _vote(repeats, repeats < 0.1, repeats > 0.2),
        "dup_lines": _vote(repeated, repeated < 0.2, repeated > 0.4),
        "upper": enough(_vote(upper, upper < 0.1, upper > 0.25)),
        "ends": enough(_vote(ends, ends > 0.9, ends < 0.7)),
        "distinct": _vote(distinct, distinct > 0.5, distinct < 0.3),
        "short_words": enough(_vote(short, (short > 0.1) & (short < 0.45), (short < 0.03) | (short > 0.55))),
    }


def spoken_for(names: Sequence[str], kinds: dict[str, Sequence[str]] = KINDS) -> list[list[int]]:
    """For each kind the places of its rules among `names`."""
    return [[names.index(r) for r in rules_] for rules_ in kinds.values()]


@dataclass
class LatentClasses:
    """shares: of the classes, good first; bad: class x rule, how often the rule votes bad on the class when it votes."""

    shares: np.ndarray
    bad: np.ndarray

    @classmethod
    def start(cls, rules: int, kinds: list[list[int]]) -> LatentClasses:
        bad = np.full((len(kinds) + 1, rules), BAD_ON_GOOD)
        for k, own in enumerate(kinds, 1):
            bad[k, own] = BAD_ON_ITS_KIND
        return cls(np.array([START_GOOD, *[(1 - START_GOOD) / len(kinds)] * len(kinds)]), bad)

    def belongs(self, votes: np.ndarray) -> np.ndarray:
        """P(class | votes) of each row of `votes`."""
        log = np.log(self.shares) + (votes < 0) @ np.log(self.bad).T + (votes > 0) @ np.log1p(-self.bad).T
        likelihood = np.exp(log - log.max(axis=1, keepdims=True))
        return likelihood / likelihood.sum(axis=1, keepdims=True)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, kinds: list[list[int]], rounds: int = ROUNDS) -> LatentClasses:
    """The model of `patterns`, distinct vote vectors with their numbers of documents, by expectation-maximisation."""
    start = model = LatentClasses.start(rules, kinds)
    if not patterns:
        return model
    votes = np.array([p for p, _ in patterns])
    weight = np.array([w for _, w in patterns], float)
    added = max(PSEUDO_VOTES, ANCHOR * weight.sum())
    for _ in range(rounds):
        here = model.belongs(votes) * weight[:, None]
        shares = here.sum(axis=0) + PSEUDO_VOTES * start.shares
        down, cast = here.T @ (votes < 0), here.T @ (votes != 0)
        model = LatentClasses(shares / shares.sum(), (down + added * start.bad) / (cast + added))
    return model


def posterior(model: LatentClasses, votes: list[Column]) -> Column:
    """P(good | votes)."""
    logs = []
    for share, bad in zip(model.shares.tolist(), model.bad.tolist()):
        terms = [F.when(v < 0, float(np.log(b))).when(v > 0, float(np.log1p(-b))).otherwise(0.0) for v, b in zip(votes, bad)]
        logs.append(sum(terms, F.lit(float(np.log(share)))))
    # One-element arrays hold the logarithms and their largest, so that each is worked out once.
    parts = F.transform(F.array(F.array(*logs)), lambda ls: F.transform(ls, lambda x: F.exp(x - F.array_max(ls))))[0]
    return F.transform(F.array(parts), lambda p: p[0] / F.aggregate(p, F.lit(0.0), lambda s, x: s + x))[0]


def _fitted(counted: DataFrame, names: dict[str, Column]) -> Column:
    """P(good) of each row of `counted`, which holds the counts, with the model estimated from all of them."""
    rows = counted.select(*[v.alias(n) for n, v in names.items()]).groupBy(*names).count().collect()
    model = estimate([(tuple(r[n] for n in names), r["count"]) for r in rows], len(names), spoken_for(list(names)))
    return posterior(model, list(names.values()))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts, base_failed, quality, kept): quality is the posterior probability of a good document."""
    scratch = Scratch(docs.sparkSession, "quality")
    counted = scratch.keep(text_counts(docs, id_col, text_col), "counts")
    scored = counted.withColumn("base_failed", base_failed()).withColumn("quality", _fitted(counted, rules()))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, that are kept, each judged by its own text whatever its id.

    The rows are written once with their counts beside them, so that the verdict needs no join.
    """
    (name,) = spare(docs.columns, "counts")
    at = docs.columns.index(text_col)
    kind = StructType([StructField(n, LongType()) for n in NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            table = np.array([counts_of(t.as_py()) for t in batch.column(at)], np.int64).reshape(-1, len(NAMES))
            yield batch.append_column(name, pa.StructArray.from_arrays([pa.array(c) for c in table.T], names=list(NAMES)))

    counted = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, kind)]))
    rows = Scratch(docs.sparkSession, "quality").keep(counted, "rows")
    of = {n: F.col(f"`{name}`.{n}") for n in NAMES}
    kept = ~base_failed(of) & (_fitted(rows.select(name), rules(of)) >= 0.5)
    return rows.where(kept).drop(name)


def pattern_table(votes: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
    """The distinct vote vectors of a list with their counts."""
    return list(Counter(votes).items())
