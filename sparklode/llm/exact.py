"""Exact de-duplication through an extendible-hash index on shared files.

Two texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts one row stays:
the one with the largest doc_id, a missing id being the smallest, and of rows with one id and text any single one. Other
columns are ignored, whatever their names. An empty table gives an empty result.

Index: every text has a 64-bit hash, and a directory maps the hash's low bits to buckets. The directory starts as deep as
the number of distinct hashes calls for; while a bucket holds more of them than its capacity, it is split by one more bit,
and the directory doubles when the bucket was as deep as it. `SPARE_BITS` doublings are looked at, far more than hashes
that are spread evenly need; a bucket that is still overfull then stays as it is and nothing is lost. The directory grows
with the input (about 2^SPARE_BITS entries a bucket), so it is broadcast only when it is small and else joined by a shuffle.

A hash that one row has needs no comparison. Rows with a common hash meet in their owner task, combined first where they
were read: grouping there by the text itself compares the bytes, and different texts of one hash form a chain, numbered
from 1. The entries (bucket, hash, chain, SHA-256, the row that stays, size) are written to the shared folder, dealt to
tasks by bucket. Every row then finds its bucket through the directory and walks the hash's chain there to the entry of its
SHA-256; should two texts of a chain share that as well, the rows are told apart by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparklode.llm.rows import with_row, without
from sparklode.sources.scratch import Scratch

#: Distinct hashes a bucket holds before it is split, doublings of the directory beyond its start, and the largest
#: directory that is broadcast.
CAPACITY, SPARE_BITS, BROADCAST_ENTRIES = 1 << 16, 4, 1 << 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def start_depth(n_keys: int, capacity: int = CAPACITY) -> int:
    """The bits by which `n_keys` evenly spread hashes fill buckets of `capacity` to a half at least."""
    return max(0, (max(1, n_keys) // capacity).bit_length())


def directory(keys: DataFrame, capacity: int = CAPACITY, start: int = 0, spare: int = SPARE_BITS) -> DataFrame:
    """(prefix, depth, bits): the bucket of every value of the low `start + spare` bits that occurs.

    keys: (h), one row per distinct hash. A bucket is named by its depth and its `depth` low bits.
    """
    leaves = keys.groupBy(F.col("h").bitwiseAND(F.lit((1 << start + spare) - 1)).alias("prefix")).agg(F.count("*").alias("n"))
    low = F.expr("prefix & (shiftleft(1L, depth) - 1)")
    levels = leaves.select("prefix", "n", F.explode(F.sequence(F.lit(start), F.lit(start + spare))).alias("depth")).withColumn("bits", low)
    held = levels.groupBy("depth", "bits").agg(F.sum("n").alias("held"))
    fits = levels.join(held, ["depth", "bits"]).where((F.col("held") <= capacity) | (F.col("depth") == start + spare))
    return fits.groupBy("prefix").agg(F.min("depth").alias("depth")).withColumn("bits", low)


class Index:
    """The directory and the entries it leads to."""

    def __init__(self, scratch: Scratch, keys: DataFrame, capacity: int = CAPACITY, spare: int = SPARE_BITS) -> None:
        """keys: (row, doc_id, h, sha), one row per input row, in a written table."""
        self.scratch, self.keys = scratch, keys
        self.held = scratch.keep(keys.groupBy("h").agg(F.count("*").alias("n")), "hashes")
        self.bits = start_depth(self.held.count(), capacity) + spare
        self.directory = scratch.keep(directory(self.held.select("h"), capacity, self.bits - spare, spare), "directory")
        self.small = 1 << self.bits <= BROADCAST_ENTRIES
        self.entries: DataFrame | None = None

    def placed(self, rows: DataFrame) -> DataFrame:
        """`rows` (h and more) with the bucket that the directory names."""
        routes = F.broadcast(self.directory) if self.small else self.directory.hint("merge")
        prefix = F.col("h").bitwiseAND(F.lit((1 << self.bits) - 1)).alias("prefix")
        return rows.select("*", prefix).join(routes, "prefix").withColumn("bucket", F.concat_ws("-", "depth", "bits")).drop("prefix", "depth", "bits")

    def build(self, texts: DataFrame) -> None:
        """Write the entries. texts: (row, doc_id, text) of the same rows, the text normalised."""
        stays = F.max(F.struct("doc_id", "row")).alias("top")
        several = self.held.where("n > 1").select("h")
        # Shuffled at every size, here and below: a broadcast of the hashes would be chosen on small inputs only, as they grow with the input.
        alone = self.keys.join(self.held.where("n = 1").select("h").hint("merge"), "h", "left_semi").select("h", "sha", F.struct("doc_id", "row").alias("top"), F.lit(1).cast("long").alias("group_size"))
        together = texts.withColumn("h", F.xxhash64("text")).join(several.hint("merge"), "h", "left_semi")
        compared = together.groupBy("h", "text").agg(stays, F.count("*").alias("group_size")).select("h", F.sha2("text", 256).alias("sha"), "top", "group_size")
        chain = F.row_number().over(W.partitionBy("bucket", "h").orderBy("sha", "top")).alias("chain")
        twins = F.count("*").over(W.partitionBy("bucket", "h", "sha")).alias("twins")
        owned = self.placed(alone.unionByName(compared)).repartition("bucket")
        self.entries = self.scratch.keep(owned.select("bucket", "h", "sha", chain, twins, "top", "group_size").sortWithinPartitions("bucket", "h", "chain"), "index")

    def lookup(self) -> DataFrame:
        """(row, doc_id, sha, top, group_size, twins) of every row, through its bucket and its hash's chain."""
        return self.placed(self.keys).join(self.entries.hint("merge"), ["bucket", "h", "sha"]).select("row", "doc_id", "sha", "top", "group_size", "twins")


def _groups(texts: DataFrame, scratch: Scratch, capacity: int, spare: int) -> DataFrame:
    """(row, doc_id, sha, top, group_size) of texts (row, doc_id, text): `top` is the (doc_id, row) that stays."""
    keys = scratch.keep(texts.select("row", "doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha")), "keys")
    index = Index(scratch, keys, capacity, spare)
    index.build(texts)
    found = index.lookup()
    twins = index.entries.where("twins > 1").select("sha").distinct()
    if twins.isEmpty():
        return found.drop("twins")
    unclear = texts.withColumn("sha", F.sha2("text", 256)).join(twins, "sha", "left_semi")
    groups = unclear.groupBy("sha", "text").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size"))
    return found.where("twins = 1").drop("twins").unionByName(unclear.join(groups, ["sha", "text"]).select("row", "doc_id", "sha", "top", "group_size"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, spare: int = SPARE_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row; `kept` holds for one row of each group."""
    scratch = Scratch(docs.sparkSession, "exact")
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.col(text_col)).alias("text"))
    out = _groups(scratch.keep(slim, "texts"), scratch, capacity, spare)
    return out.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_largest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, that stay: one of each group of equal texts."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows, row = with_row(docs, scratch)
    slim = rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.col(text_col)).alias("text"))
    return without(rows, row, _groups(slim, scratch, CAPACITY, SPARE_BITS).where("row <> top.row"))
