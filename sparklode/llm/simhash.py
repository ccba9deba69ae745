"""Near-duplicate detection by 64-bit SimHash with pigeonring filtering.

Fingerprints: A-Z lower-cased, words are runs of non-white-space (ASCII white space), shingles are `words` consecutive
words with repeats kept; a text of fewer words is one shingle, a text without words has fingerprint 0. A bit is 1 when
it is set in over half of the shingles' XXH64 (seed 42). Null text counts as empty; equal texts and repeated rows have
equal fingerprints and so one component; other columns of the input are ignored, whatever their names.

Pigeonring: cut the 64 bits into 13 boxes on a ring. If two fingerprints differ in at most 4 bits, some start on the
ring has, for every length l, at most floor(4 l / 13) differences in its first l boxes: none in 3 boxes, at most 1 in 6,
2 in 9, 3 in 12 and 4 in all. Of boxes 4 to 6 at least two are therefore equal, so each fingerprint is filed under
13 starts x 3 choices of the box left out (about 25 equal bits a key), and pairs that meet under a key must first pass
the whole chain, then the full Hamming check.

Pairs are never listed within a group. Under each key all members are compared with one leader; components of those
links leave few keys whose members still differ in component, and only there members outside the key's main component
are compared with the rest. Two members of one component need no link, so no component is lost.

Both sides of every join here grow with the input, so each is shuffled at every size: Spark takes a table of keys, 39 for each
fingerprint, for no larger than the fingerprints they are made of, and would broadcast it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.llm.rows import with_row, without
from sparklode.operators.graph import connected_components
from sparklode.sources.scratch import Scratch

BITS, DISTANCE, BOXES, SEED = 64, 4, 13, 42
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the shingles of a text, in order."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :])), np.uint64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    hashes = shingle_hashes(text, words)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), HASHES_AT_ONCE):
        block = hashes[k : k + HASHES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(slim: DataFrame, words: int = 4) -> DataFrame:
    """(row, doc_id, fp) of slim (row, doc_id, text); fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["row", "doc_id", "fp"])

    return slim.mapInArrow(run, "row long, doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring_masks(boxes: int = BOXES) -> list[int]:
    """The bits of each box on the ring."""
    edges = [round(BITS * k / boxes) for k in range(boxes + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def key_masks() -> list[int]:
    """The bits that make up key `3 * start + left_out`."""
    ring = ring_masks()
    out = []
    for start in range(BOXES):
        box = [ring[(start + k) % BOXES] for k in range(6)]
        out += [box[0] | box[1] | box[2] | sum(box[3 + k] for k in range(3) if k != left) for left in range(3)]
    return out


def chain_budgets(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(length, most differences) where the proportional budget is tightest."""
    budget = {n: n * distance // BOXES for n in range(1, BOXES + 1)}
    return [(n, b) for n, b in budget.items() if n == BOXES or budget[n + 1] > b]


def _linked(slot: Column, diff: Column, distance: int = DISTANCE) -> Column:
    """The chain from the key's start keeps within its budgets, and then the whole difference does."""
    ring = ring_masks()
    ok = F.lit(True)
    for length, most in chain_budgets(distance)[:-1]:
        masks = [_signed(sum(ring[(s + k) % BOXES] for k in range(length))) for s in range(BOXES)]
        mask = F.element_at(F.array(*map(F.lit, masks)), (F.floor(slot / 3) + 1).cast("int"))
        ok = ok & (F.bit_count(diff.bitwiseAND(mask)) <= most)
    return ok & (F.bit_count(diff) <= distance)


def link_components(prints: DataFrame) -> DataFrame:
    """(fp, root): for each distinct fingerprint with a partner, its component's smallest fingerprint.

    prints: (fp, n), distinct fingerprints with the number of rows that have each.
    """
    scratch = Scratch(prints.sparkSession, "simhash")
    # Dealt out before each fingerprint becomes many rows: read back from few files, few tasks would make them all.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = scratch.keep(prints, "prints").repartition(tasks, F.xxhash64("fp"))
    keyed = prints.select(
        "fp", "n", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in key_masks()])).alias("slot", "bits")
    )
    leader = F.max(F.struct("n", F.xxhash64("fp", "slot").alias("h"), "fp"))["fp"].alias("leader")
    shared = keyed.groupBy("slot", "bits").agg(leader, F.count("*").alias("members")).where("members > 1").drop("members")
    filed = scratch.keep(keyed.join(shared.hint("merge"), ["slot", "bits"]).select("slot", "bits", "fp", "leader"), "filed")

    x = F.col("fp").bitwiseXOR(F.col("leader"))
    stars = filed.where(F.col("fp") != F.col("leader")).where(_linked(F.col("slot"), x)).select("fp", "leader").distinct()
    roots = scratch.keep(connected_components(stars, "fp", "leader"), "roots")

    placed = filed.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("slot", "bits", "fp", F.coalesce("root", "fp").alias("root"))
    sizes = placed.groupBy("slot", "bits", "root").agg(F.count("*").alias("members"))
    mixed = sizes.groupBy("slot", "bits").agg(F.count("*").alias("roots"), F.max(F.struct("members", "root"))["root"].alias("main")).where("roots > 1").drop("roots")
    open_rows = scratch.keep(placed.join(mixed.hint("merge"), ["slot", "bits"]), "open")
    a, b = open_rows.where("root <> main").alias("a"), open_rows.hint("merge").alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    across = a.join(
        b,
        (F.col("a.slot") == F.col("b.slot"))
        & (F.col("a.bits") == F.col("b.bits"))
        & (F.col("a.root") != F.col("b.root"))
        & ((F.col("b.root") == F.col("b.main")) | (F.col("a.fp") < F.col("b.fp")))
        & _linked(F.col("a.slot"), diff),
    ).select(F.col("a.root").alias("x"), F.col("b.root").alias("y"))
    merged = scratch.keep(connected_components(across.distinct(), "x", "y"), "merged")
    scratch.drop("prints", "filed", "open")
    out = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge"), "root", "left").select(F.col("node").alias("fp"), F.coalesce("top", "root").alias("root"))
    alone = merged.join(roots.hint("merge"), "node", "left_anti").select(F.col("node").alias("fp"), "root")
    return out.unionByName(alone)


def _classes(slim: DataFrame, words: int) -> DataFrame:
    """(row, doc_id, fp, top) of slim (row, doc_id, text): `top` is the smallest (doc_id, row) of the row's class."""
    scratch = Scratch(slim.sparkSession, "simhash-docs")
    rows = scratch.keep(fingerprints(slim, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row"))
    prints = rows.groupBy("fp").agg(F.count("*").alias("n"), first.alias("first"))
    roots = link_components(prints.select("fp", "n"))
    placed = scratch.keep(prints.join(roots.hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("top"))
    by_print = placed.join(least.hint("merge"), "root").select("fp", "top")
    return rows.join(by_print.hint("merge"), "fp").select("row", "doc_id", "fp", "top")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row: component_id is the smallest doc_id reachable over links of at most 4 bits.

    Missing ids are passed over; a class of rows without ids has a null component_id.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _classes(slim, words).select("doc_id", "fp", F.col("top.doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """The rows of `docs`, all their columns: of each near-duplicate class one row, with the class's smallest doc_id; a missing id counts as the largest."""
    rows, row = with_row(docs, Scratch(docs.sparkSession, "simhash-rows"))
    slim = rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return without(rows, row, _classes(slim, words).where("row <> top.row"))
