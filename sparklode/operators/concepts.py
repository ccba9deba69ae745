"""A closed dictionary of concepts: finding its names in texts, and how much two rows share.

A name is found where its words stand in a row, whatever their case, in either of two readings of the text: words with
their inner hyphens, and words cut at hyphens. All names that stand there are found, not only the longest. Symbols of several
characters are found as they are written, anywhere. Nothing is matched by likeness.

All names go into one Aho-Corasick automaton, built once and sent to the tasks, so that a text is read once for each
reading, however many names there are. A dictionary of more than `MOST` characters isn't sent; it is joined instead, by all
runs of words up to its longest name.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.functions import text as T
from sparklode.operators.search import best_by_bounds
from sparklode.operators.textquality import ngrams

MOST = 20_000_000
WHOLE, CUT = re.compile(T.WORD), re.compile("[a-z0-9à-ÿ]+")
#: What a shared concept and a shared tag weigh; fixed values.
CONCEPT_WEIGHT, TAG_WEIGHT = 2, 1


def readings(text: str) -> tuple[str, str]:
    """The words of a text in both readings, each between single spaces."""
    low = text.lower()
    return tuple(f" {' '.join(m[0] for m in pattern.finditer(low))} " for pattern in (WHOLE, CUT))


def automaton(names: list[str], symbols: list[str]) -> bytes:
    """The pickled automata of names (in each reading) and of symbols; a name without a word is left out."""
    words, signs = ahocorasick.Automaton(), ahocorasick.Automaton()
    keys: dict[str, set[str]] = {}
    for name in names:
        for key in readings(name):
            if key.strip():
                keys.setdefault(key, set()).add(name)
    for key, known in keys.items():
        words.add_word(key, tuple(sorted(known)))
    for symbol in symbols:
        signs.add_word(symbol, symbol)
    for made in (words, signs):
        if len(made):
            made.make_automaton()
    return pickle.dumps((words, signs))


def found_in(text: str | None, words: ahocorasick.Automaton, signs: ahocorasick.Automaton) -> list[str]:
    """The names and symbols of a text, sorted."""
    found: set[str] = set()
    if text and len(words):
        whole, cut = readings(text)
        for reading in (whole,) if whole == cut else (whole, cut):
            for _, names in words.iter(reading):
                found.update(names)
    if text and len(signs):
        found.update(symbol for _, symbol in signs.iter(text))
    return sorted(found)


def concepts_of(texts: DataFrame, names: DataFrame, symbols: list[str], most: int = MOST) -> DataFrame:
    """(id, concept), distinct, of texts (id, text): the dictionary's names (name) and symbols found in each."""
    known = names.where("name <> ''").select("name").distinct()
    size = known.agg(F.coalesce(F.sum(F.length("name") + 8), F.lit(0))).first()[0]
    if size > most:
        return _joined(texts, known, symbols)
    shared = texts.sparkSession.sparkContext.broadcast(automaton(sorted(r["name"] for r in known.collect()), symbols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signs = pickle.loads(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([found_in(t.as_py(), words, signs) for t in batch.column(1)], pa.list_(pa.string()))], names=["id", "concepts"])

    listed = texts.select("id", "text").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, concepts array<string>")
    return listed.select("id", F.explode("concepts").alias("concept"))


def _joined(texts: DataFrame, names: DataFrame, symbols: list[str]) -> DataFrame:
    """The same by a join on runs of words."""

    def words(text, pattern):
        return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)

    keyed = names.select("name", F.explode(F.array_distinct(F.array(*[F.array_join(words(F.col("name"), p), " ") for p in (T.WORD, CUT.pattern)]))).alias("gram")).where("gram <> ''")
    longest = keyed.agg(F.coalesce(F.max(F.size(F.split("gram", " "))), F.lit(1))).first()[0]
    both = texts.select("id", "text", F.explode(F.array(*[words(F.col("text"), p) for p in (T.WORD, CUT.pattern)])).alias("w"))
    grams = both.select("id", F.explode_outer(F.array_distinct(F.flatten(F.array(*[ngrams(F.col("w"), n) for n in range(1, longest + 1)])))).alias("gram"))
    found = grams.join(keyed, "gram").select("id", F.col("name").alias("concept"))
    signs = texts.select("id", F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.contains("text", F.lit(s)), s) for s in symbols]))).alias("concept"))
    return found.unionByName(signs).distinct()


def matched(given: DataFrame, names: DataFrame) -> DataFrame:
    """(id, concept, position, known): names as given, (id, position, raw), against the dictionary by normal form.

    Case, white space and the dots on e are no difference. A name given twice stays once, where it came first; names that
    aren't in the dictionary keep their own form and are not known. Empty names are dropped."""
    form = lambda c: F.translate(T.collapse(c), "ё", "е")
    canon = names.where("name <> ''").groupBy(form(F.col("name")).alias("key")).agg(F.min("name").alias("name"))
    keyed = given.select("id", "position", "raw", form(F.col("raw")).alias("key")).where("key <> ''").join(canon, "key", "left")
    shown = keyed.select("id", F.coalesce("name", "raw").alias("concept"), "position", F.col("name").isNotNull().alias("known"))
    return shown.groupBy("id", "concept", "known").agg(F.min("position").alias("position"))


def overlap_top(queries: DataFrame, concepts: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the `k` rows that share most with each query, itself left out: concepts count twice.

    queries: (query_id); concepts (id, concept) and tags (id, tag) of all rows, distinct. They are added up in blocks like a
    search's words, so common ones aren't joined with all queries."""
    marks = concepts.select(F.col("id"), F.concat(F.lit("c:"), "concept").alias("term"), F.lit(float(CONCEPT_WEIGHT)).alias("w"))
    marks = marks.unionByName(tags.select("id", F.concat(F.lit("t:"), "tag").alias("term"), F.lit(float(TAG_WEIGHT)).alias("w")))
    asked = marks.join(queries.select(F.col("query_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), "term")
    found = best_by_bounds(marks, asked, k + 1).where("id <> query_id")
    from sparklode.operators.search import top

    return top(found.drop("rank"), k).withColumn("score", F.col("score").cast("long"))
