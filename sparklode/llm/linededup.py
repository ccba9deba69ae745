"""Line de-duplication over levelled sorted runs of line hashes.

A text is split at line feeds (null or empty: one empty line). A line's key is the line with ASCII white space stripped
at both ends and A-Z lower-cased. Keys of at least `MIN_LENGTH` code points found in at least `MIN_DOCS` documents lose
all their lines except in the largest doc_id that holds them, where all of them stay; other lines stay. Rows of one doc_id
are one document for the count. Rows without doc_id keep all their lines and count for none. Other columns are ignored,
whatever their names; an empty table gives no rows.

Runs: documents come in batches of about `BATCH_DOCS`, `BATCHES` at least, here by ranges of doc_id that hold about as many rows each,
the largest ids first. A batch's keys are counted once a
document and combined where they were read. The batch is merge-anti-joined with each run: keys that no run holds are new,
and the batch's largest doc_id is their holder, which no later batch can exceed; only these make the batch's own run, so a
key is in one run only. Keys that a run holds already add to a table of further counts. A run is a table bucketed and
sorted by key, in as many buckets as the session has shuffle partitions, so that a batch just counted meets it, and runs
meet each other, without moving the run. When a level has `FANOUT` runs, they are merged bucket by bucket into one of the
next level, so a key is rewritten once a level. Keys are 128-bit hashes (two XXH64 with different seeds).

A document's dropped lines are found by their places, which are set against all places of its text at once, so the work on a text
grows with its lines and not with their square.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.llm.exact import LOWER, UPPER
from sparklode.sources.scratch import Scratch

MIN_LENGTH, MIN_DOCS, FANOUT, BATCHES, BATCH_DOCS = 20, 3, 2, 3, 100_000_000
KEY = ["h1", "h2"]
#: Lets a scan of a bucketed table with one file a bucket count as sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    """Stripped of [\\x20\\x09-\\x0D] and lower-cased in A-Z."""
    return F.translate(F.trim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")


def long_keys(docs: DataFrame, min_length: int) -> DataFrame:
    """(doc_id, h1, h2): each long enough key once per row of docs (doc_id, text)."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_length))
    return docs.select("doc_id", F.explode(keys).alias("key")).select("doc_id", *hashes(F.col("key")))


class SortedRuns:
    """Sorted runs (h1, h2, n_docs, holder) in levels, no key in two of them; bucketed tables in the shared folder."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT) -> None:
        self.scratch, self.fanout, self.spark = scratch, fanout, scratch.spark
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.more: list[DataFrame] = []
        self.written = 0

    def _write(self, run: DataFrame) -> str:
        """One file for each bucket: a key's rows are in one task already, and the conf lets readers rely on the files' order."""
        name = f"{self.prefix}_{self.written}"
        self.written += 1
        before = self.spark.conf.get(ORDERED, "false")
        self.spark.conf.set(ORDERED, "true")
        try:
            out = run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.scratch.path(name))
            out.mode("overwrite").saveAsTable(name)
        finally:
            self.spark.conf.set(ORDERED, before)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """Add a batch (doc_id, h1, h2), all of whose doc_ids are smaller than those of the batches before."""
        batch = self._write(keys.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("holder")))
        if held := self.tables():
            counted = fresh = self.spark.table(batch)
            for run in held:
                fresh = fresh.join(run.select(*KEY), KEY, "left_anti")
            own = self._write(fresh)
            again = counted.join(self.spark.table(own).select(*KEY), KEY, "left_anti").select(*KEY, "n_docs")
            self.more.append(self.scratch.keep(again, f"more-{self.written}"))
            self._forget([batch])
            batch = own
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(batch)
        self._compact()

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                old = self.levels[k]
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self.merged(old)))
                self.levels[k] = []
                self._forget(old)

    def merged(self, names: list[str]) -> DataFrame:
        """All entries of some runs, which share no key, merged bucket by bucket."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnsRenamed({"n_docs": "n_docs_", "holder": "holder_"})
            out = out.join(other, KEY, "full_outer").select(*KEY, F.coalesce("n_docs", "n_docs_").alias("n_docs"), F.coalesce("holder", "holder_").alias("holder"))
        return out

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
        self.scratch.drop(*names)

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, holder) of the keys that at least `min_docs` documents hold."""
        held = [run.select(*KEY, "n_docs", "holder") for run in self.tables()]
        if self.more:
            more = self.more[0]
            for part in self.more[1:]:
                more = more.unionByName(part)
            more = more.groupBy(*KEY).agg(F.sum("n_docs").alias("further"))
            held = [run.join(more, KEY, "left").withColumn("n_docs", F.col("n_docs") + F.coalesce("further", F.lit(0))) for run in held]
        out = held[0].where(F.col("n_docs") >= min_docs).select(*KEY, "holder")
        for run in held[1:]:
            out = out.unionByName(run.where(F.col("n_docs") >= min_docs).select(*KEY, "holder"))
        return out

    def close(self) -> None:
        """Delete all runs."""
        for level in self.levels:
            self._forget(level)
        self.levels = []


def batch_ends(docs: DataFrame, batches: int) -> list[int]:
    """The largest doc_id of each batch but the last, in falling order, by approximate quantiles; fewer where ids repeat a lot."""
    at = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], F.lit(10_000))).first()[0] if batches > 1 else []
    return sorted(set(at or []), reverse=True)


def repeated_keys(docs: DataFrame, scratch: Scratch, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """(h1, h2, holder): keys found in at least `min_docs` documents, with the largest doc_id that holds each; a written table."""
    n, different = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    runs = SortedRuns(scratch)
    ends = batch_ends(docs, max(BATCHES, -(-n // batch_docs)))
    for k in range(len(ends) + 1):
        part = docs.where(F.col("doc_id").isNotNull())
        part = part.where(F.col("doc_id") > ends[k]) if k < len(ends) else part
        part = part.where(F.col("doc_id") <= ends[k - 1]) if k else part
        keys = long_keys(part, min_length)
        runs.add(keys.distinct() if n > different else keys)
    out = scratch.keep(runs.repeated(min_docs), "repeated")
    runs.close()
    return out


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): the text that is left of every row."""
    scratch = Scratch(docs.sparkSession, "lines")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeated = repeated_keys(slim, scratch, min_length, min_docs, batch_docs)
    # Rows of one doc_id may have different texts: a row is known by its id and its text's hash, and rows equal in both fare alike.
    named = slim.withColumn("of", F.xxhash64("text"))
    placed = named.select("doc_id", "of", F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("place", "key")).where(F.length("key") >= min_length)
    found = placed.select("doc_id", "of", "place", *hashes(F.col("key"))).join(repeated, KEY).where(F.col("doc_id") < F.col("holder"))
    dropped = found.groupBy("doc_id", "of").agg(F.collect_list("place").alias("gone"))
    lines = named.join(dropped, ["doc_id", "of"], "left").select("doc_id", lines_of(F.col("text")).alias("lines"), "gone")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(places, lambda k: F.get("lines", k)))
    left = lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return left.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
