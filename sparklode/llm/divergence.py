"""How far the sources of a language differ in their terms.

Terms of a text are runs of ASCII letters and non-ASCII characters, with only A-Z lower-cased. Of each language the V terms
that at least `MIN_DOCS` of its documents hold are kept. In a (language, source) group, and in the language as a whole, a kept
term found `count` times has

    p = 1 + floor(1000000000 * (count + 5) / (N + 5 * V)),   N: the count's sum over the kept terms,

all in whole numbers. Two sources differ by the sum of |p - q| over all kept terms; a group's own terms are the kept ones
that it holds and whose p exceeds the language's q, the largest differences first.

Tokenizing: a task looks every byte of its concatenated UTF-8 texts up in a table, which gives term bytes and their
lower case, and finds the terms' bounds where the table's answer changes or a text ends. Terms are grouped by XXH64; every
term's bytes are then compared with those of its group's first, and terms that differ from it are grouped by their bytes.
Texts go through windows of `WINDOW` bytes, cut between terms, so memory doesn't grow with a text. A task sends each (language,
source, term) once per `HELD` distinct ones.

Distances: kept counts are dealt out by language and a hash of the term into blocks of about `CELLS` counts. In a block the
counts are a CSR matrix of sources by terms; a source is laid out densely and `np.add.reduceat` sums over all other rows what
their entries change against the value that an absent term has. Partial sums meet in one aggregation. What is written for
each pair of sources is the result itself; a language's sources are also listed once a block.

Null texts, languages and sources count as ''. A group without any term still gets its rows. Repeated rows count each. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklode.sources.scratch import Scratch

MIN_DOCS, SCALE, ADD, TOP = 30, 1_000_000_000, 5, 50
WINDOW, HELD, CELLS = 1 << 21, 600_000, 400_000

#: Which bytes belong to terms, and each byte's lower case.
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of texts that lie one after another in `data`, text k at offsets[k]:offsets[k + 1]."""
    inside = TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's group, and each group's bytes: grouped by hash, then held against the bytes of the group's first."""
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    terms = [raw[starts[k] : ends[k]] for k in first.tolist()]
    lengths = ends - starts
    differs = lengths != lengths[first][group]
    same = np.flatnonzero(~differs)
    if len(same):
        n = lengths[same]
        begin = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(begin, n)
        equal = data[np.repeat(starts[same], n) + step] == data[np.repeat(starts[first][group][same], n) + step]
        differs[same] = ~np.logical_and.reduceat(equal, begin)
    if differs.any():
        number: dict[bytes, int] = {}
        for k in np.flatnonzero(differs).tolist():
            term = raw[starts[k] : ends[k]]
            if term not in number:
                number[term] = len(terms)
                terms.append(term)
            group[k] = number[term]
    return group, terms


def windows(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of about `size` bytes each that cut no term, though one term may be longer than a window."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and TERM[data[end]]:
            rest = np.flatnonzero(~TERM[data[end : end + size]])
            end = min(len(data), end + (int(rest[0]) if len(rest) else size))
        yield at, end
        at = end


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and each column of values added up by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(v[order], at) if len(keys) else v for v in values)


class TermCounter:
    """Counts and numbers of documents by (group, term) of what one task has read so far."""

    BITS = 32

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.clear()

    def clear(self) -> None:
        self.group_of: dict[tuple[str, str], int] = {}
        self.term_of: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, langs: list[str], sources: list[str], texts: pa.Array) -> None:
        groups = np.array([self.group_of.setdefault(g, len(self.group_of)) for g in zip(langs, sources)], np.int64)
        texts = pc.cast(texts, pa.large_binary())
        _, places, body = texts.buffers()
        offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        found = [self._window(data[a:b], np.unique(np.clip(offsets, a, b)) - a, a, offsets) for a, b in windows(data, self.window)]
        if not found:
            return
        # A text over several windows has its counts of a term added before it counts as one document.
        keys, n = summed(*(np.concatenate(c) for c in zip(*found)))
        by_group = groups[keys >> self.BITS] << self.BITS | keys & (1 << self.BITS) - 1
        self.parts.append(summed(by_group, n, np.ones(len(n), np.int64)))
        self.size += len(self.parts[-1][0])
        if self.size > HELD and len(self.parts) > 1:
            self.parts = [summed(*(np.concatenate(c) for c in zip(*self.parts)))]
            self.size = len(self.parts[0][0])

    def _window(self, data: np.ndarray, cuts: np.ndarray, at: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text << BITS | term, count) of a window that starts at byte `at`."""
        starts, ends = bounds(data, cuts)
        group, terms = grouped(LOWER[data], starts, ends)
        number = np.array([self.term_of.setdefault(t, len(self.term_of)) for t in terms], np.int64)
        text = np.searchsorted(offsets, starts + at, "right") - 1
        return summed(text << self.BITS | (number[group] if len(group) else group), np.ones(len(group), np.int64))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs), and one row without a term for each group; the counter is empty afterwards."""
        names = list(self.group_of)
        lang, source = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
        zeros = pa.array(np.zeros(len(names), np.int64))
        yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(names), pa.string()), zeros, zeros], names=FIELDS)
        if self.parts:
            keys, n, docs = summed(*(np.concatenate(c) for c in zip(*self.parts)))
            terms = pa.array(list(self.term_of), pa.binary()).cast(pa.string())
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                at = pa.array(part >> self.BITS)
                columns = [lang.take(at), source.take(at), terms.take(pa.array(part & (1 << self.BITS) - 1))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n[k : k + 50_000]), pa.array(docs[k : k + 50_000])], names=FIELDS)
        self.clear()


FIELDS = ["lang", "source", "term", "n", "docs"]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs (lang, source, text), none of them null; a null term marks that a group occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter()
        for batch in batches:
            counter.add(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
            if counter.size > HELD:
                yield from counter.rows()
        if counter.group_of:
            yield from counter.rows()

    rows = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(count: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """p of counts, exactly: floor(10^9 a / b) by three divisions in base 1000, as the product may exceed 64 bits."""
    rest, base = np.asarray(count, np.int64) + ADD, np.asarray(total + ADD * kinds, np.int64)
    out, rest = rest // base, rest % base
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // base, rest % base
    return out + 1


def smoothed_column(count: Column, total: Column, kinds: Column) -> Column:
    """p as a column, in decimals of 38 digits."""
    a = (count + ADD).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", a, (total + ADD * kinds).cast("decimal(20,0)")) + 1


def block_distances(source: np.ndarray, term: np.ndarray, count: np.ndarray, total: np.ndarray, kinds: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each source i in turn, and all later ones j, the sum over the block's terms of |p - q| less |p0_i - p0_j|, with p0 what
    an absent term has. source, term and count are the block's entries; total has each source's N."""
    sources, terms = len(total), int(term.max()) + 1 if len(term) else 0
    order = np.lexsort((term, source))
    source, term, count = source[order], term[order], count[order]
    start = np.searchsorted(source, np.arange(sources + 1))
    p = smoothed(count, total[source], kinds)
    absent = smoothed(np.zeros(sources, np.int64), total, kinds)
    for i in range(sources - 1):
        own = p[start[i] : start[i + 1]]
        dense = np.full(terms, absent[i])
        dense[term[start[i] : start[i + 1]]] = own
        later = absent[i + 1 :]
        # First as if no later source had any of the terms, by prefix sums over this source's values in order ...
        ranked = np.sort(own)
        below = np.append(0, np.cumsum(ranked))
        k = np.searchsorted(ranked, later)
        out = later * (2 * k - len(ranked)) + below[-1] - 2 * below[k] - len(own) * np.abs(later - absent[i])
        # ... then what each entry of a later source changes.
        at = start[i + 1]
        if at < len(p):
            here = dense[term[at:]]
            change = np.abs(p[at:] - here) - np.abs(absent[source[at:]] - here)
            some = np.flatnonzero(np.diff(start[i + 1 :]))
            out[some] += np.add.reduceat(change, start[i + 1 :][some] - at)
        yield i, out


def flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def pair_sums(entries: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    """(lang, a, b, value) for each two sources a before b of a language.

    entries (lang, source, term, n) are the kept counts; groups (lang, source, total, kinds) are all groups."""
    none = {"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long")}
    listed = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("lang", "block", "source", *[v.alias(k) for k, v in none.items()], "total", "kinds")
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")
    missing = F.lit(None).cast("long")
    dealt = entries.select("lang", block, "source", "term", "n", missing.alias("total"), missing.alias("kinds"))

    def distances(table: pa.Table) -> pa.Table:
        absent = pc.is_null(table["term"])
        names = table.filter(absent).sort_by("source")
        held = table.filter(pc.invert(absent))
        sources, total, kinds = flat(names["source"]), names["total"].to_numpy(), names["kinds"][0].as_py()
        term = flat(held["term"]).dictionary_encode().indices.to_numpy().astype(np.int64)
        source = pc.index_in(flat(held["source"]), sources).to_numpy().astype(np.int64)
        left, right = np.triu_indices(len(sources), 1)
        value = np.zeros(len(left), np.int64)
        if kinds and len(left):
            value = np.concatenate([out for _, out in block_distances(source, term, held["n"].to_numpy(), total, kinds)])
            if names["block"][0].as_py() == 0:
                # Over all kept terms sources differ by p0 first; the blocks add what their entries change.
                base = smoothed(np.zeros(len(total), np.int64), total, kinds)
                value += kinds * np.abs(base[left] - base[right])
        lang = pa.array([names["lang"][0].as_py()] * len(left), pa.string())
        return pa.table({"lang": lang, "a": sources.take(pa.array(left)), "b": sources.take(pa.array(right)), "value": pa.array(value)})

    parts = dealt.unionByName(listed).groupBy("lang", "block").applyInArrow(distances, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergences(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS
) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language, farthest first, and part
    `term` the group's own terms up to rank `top`."""
    scratch = Scratch(docs.sparkSession, "divergence")
    columns = {"lang": lang_col, "source": source_col, "text": text_col}
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in columns.items()])
    counts = scratch.keep(term_counts(slim), "counts")
    vocabulary = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    vocabulary = scratch.keep(vocabulary.where(F.col("docs") >= min_docs).drop("docs"), "vocabulary")
    entries = scratch.keep(counts.where("term is not null").join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "entries")

    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("lang_n").alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0)
    groups = scratch.keep(groups, "groups")

    blocks = max(1, -(-entries.count() // cells))
    pairs = pair_sums(entries, groups.select("lang", "source", "total", "kinds"), blocks)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", ways.alias("x"), "value").select("lang", "x.source", "x.item", "value")

    p, q = (smoothed_column(F.col(n), F.col(total), F.col("kinds")) for n, total in (("n", "total"), ("lang_n", "lang_total")))
    terms = entries.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    shown = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.select("*", place, F.lit("pair").alias("part"))
        .select(shown)
        .unionByName(terms.select("*", place, F.lit("term").alias("part")).where(F.col("rank") <= top).select(shown))
    )
