"""Similarity joins of texts: pairs whose sets of pieces overlap enough, then whose texts agree in order.

A set's tokens are put in one order for the whole table: most by their hash, and the most common ones, at most `COMMON`, last, by how
many sets have them. Any one order is right; the common ones are counted over a part of the sets, which decides how much work there
is, never what is found. Two sets with Jaccard similarity t or more share a token among the first n - ceil(t * n) + 1 of each, so
only those, the prefixes, are joined; their sizes differ by no more than the factor t, and what may still follow a shared token
bounds the overlap by its position. Tokens in one prefix alone meet nothing and aren't joined; no other token of a set is shuffled. A
row of a prefix has at most `BESIDE` tokens beside it, whatever the text's length: a pair that shares one of those is found there
first and nowhere else, and the rest are made distinct, so each pair is verified once. Equal texts are one row before the join: what
comes out are pairs of different texts, and each text's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.functions import text as T
from sparklode.sources.scratch import Scratch


#: How many of a prefix's tokens stand beside each of them.
BESIDE = 16


#: How many of the most common tokens, at most, every task knows, and of how many sets one is counted for them.
COMMON, COUNTED = 1 << 18, 16


def common_tokens(hashed: DataFrame, scratch: Scratch, most: int) -> np.ndarray:
    """At most `most` tokens of hashed (id, set), the most common last: whole levels of what the counted sets have."""
    some = hashed.where(F.pmod(F.xxhash64("id", F.lit("counted")), F.lit(COUNTED)) == 0)
    # The outer form, as the other would make every set twice, to see first whether it is empty.
    tokens = some.select(F.explode_outer("set").alias("token"))
    df = scratch.keep(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1 and token is not null"), "common")
    level = F.floor(F.log2("df") * 8)
    taken, least = 0, None
    for r in sorted(df.groupBy(level.alias("level")).count().collect(), reverse=True):
        if (taken := taken + r["count"]) > most:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.int64)
    found = df.where(level >= least).toPandas()
    return found.sort_values(["df", "token"])["token"].to_numpy(np.int64)


def ordered_sets(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, tokens): each set of sets (id, set), its tokens' hashes by hash, the common ones last; empty sets are left out.

    Tokens go by their XXH64; two tokens of one hash would count as one, which can only make a candidate more."""
    hashed = sets.select("id", F.array_distinct(F.transform("set", lambda x: F.xxhash64(x))).alias("set"))
    common = common_tokens(hashed, scratch, COMMON)
    by_token = np.argsort(common)
    shared = scratch.spark.sparkContext.broadcast((common[by_token], by_token))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column(1)), 0), 0))
            tokens, size = batch.column(1).flatten().to_numpy(), pc.list_value_length(batch.column(1)).to_numpy()
            place = np.searchsorted(known, tokens)
            common = np.append(known, 0)[place] == tokens
            common &= place < len(known)
            at = np.where(common, np.append(rank, 0)[place], -1)
            order = np.lexsort((tokens, at, np.repeat(np.arange(len(size)), size)))
            offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(tokens[order]))], names=["id", "tokens"])

    return scratch.keep(hashed.mapInArrow(run, f"id {dict(sets.dtypes)['id']}, tokens array<bigint>"), "ordered")


def prefixes(ordered: DataFrame, least: float) -> DataFrame:
    """(id, n, place, token, prefix): the first tokens of each set that other sets have among theirs, one row each, with the first few
    of them beside it."""
    size = F.size("tokens")
    length = size - F.ceil(size * F.lit(least) - F.lit(1e-9)).cast("int") + 1
    rows = ordered.select("id", size.alias("n"), F.posexplode(F.slice("tokens", F.lit(1), length)).alias("place", "token"))
    often = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    # A set's own tokens come together again: a group is one set, never a token's rows. Both sides grow with the input.
    held = rows.join(often.hint("merge"), "token", "left_semi").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("held"))
    few = F.slice(F.transform("held", lambda x: x["token"]), 1, BESIDE)
    return held.select("id", "n", few.alias("prefix"), F.explode("held").alias("x")).select("id", "n", "x.place", "x.token", "prefix")


#: Places of a bitmap of ids that every task gets, and how many one of Spark's bitmaps has.
SLOTS, BITMAP = 1 << 24, 1 << 15


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id and more) whose id may be one of ids (id): all that are, and few others. Only a bitmap of a fixed size is sent."""
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    part, at = F.floor(slot / BITMAP).alias("part"), slot.bitwiseAND(F.lit(BITMAP - 1))
    maps = ids.groupBy(part).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("part", part).join(F.broadcast(maps), "part").where(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1).drop("part", "bits")


def both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def similar_sets(sets: DataFrame, least: float, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of sets (id, set) with at least that Jaccard similarity; ids are unique and not null."""
    scratch = scratch or Scratch(sets.sparkSession, "setjoin")
    ordered = ordered_sets(sets, scratch)
    parts = scratch.keep(prefixes(ordered, least), "prefixes")
    x, y = (parts.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("place").alias(f"p{k}"), F.col("prefix").alias(f"x{k}"), "token") for k in "ab")
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    needed = F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - F.lit(1e-9)
    seen = F.get(F.array_intersect("xa", "xb"), F.lit(0))
    met = x.join(y.hint("merge"), "token").where((F.col("a") < F.col("b")) & (small >= large * F.lit(least) - F.lit(1e-9)) & (seen.isNull() | (seen == F.col("token"))) & (most >= needed))
    pairs = scratch.keep(met.select("a", "b").distinct(), "candidates")
    tokens = among(ordered.select("id", "tokens"), both_ends(pairs))
    left, right = (tokens.select(F.col("id").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
    both = F.size(F.array_intersect("ta", "tb"))
    jaccard = both / (F.size("ta") + F.size("tb") - both)
    return pairs.join(left, "a").join(right, "b").select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= F.lit(least) - F.lit(1e-12))


def shingles(flat: Column, n: int = 5) -> Column:
    """Runs of `n` words of a collapsed text, joined by spaces; of fewer words the whole text."""

    def runs(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    # The one-element array holds the words, which else would be split once more for every run.
    return F.transform(F.array(F.split(flat, " ")), runs)[0]


def similar_texts(rows: DataFrame, pieces: Column, least: float, ratio: float | None = None, same_numbers: bool = True) -> tuple[DataFrame, DataFrame]:
    """(a, b, jaccard and, if asked for, ratio), pairs of the smallest ids of different texts, and (id, root), which text each row has.

    rows: (id, flat), flat being the text as it is compared. Pairs have a Jaccard similarity of their pieces of `least`, the same
    numbers as multisets if asked for, and an order-sensitive ratio of `ratio`. Null and empty texts belong to no pair.
    """
    scratch = Scratch(rows.sparkSession, "similar-texts")
    keyed = scratch.keep(rows.where("flat <> ''").select("id", "flat", F.sha2("flat", 256).alias("digest")), "keyed")
    roots = keyed.groupBy("digest").agg(F.min("id").alias("root"))
    members = scratch.keep(keyed.select("id", "digest").join(roots, "digest").select("id", "root"), "members")
    texts = scratch.keep(keyed.join(members.where("id = root"), "id", "left_semi").select("id", "flat"), "texts")
    scratch.drop("keyed")
    pairs = scratch.keep(similar_sets(texts.select("id", pieces.alias("set")), least, scratch), "pairs")
    marked = among(texts, both_ends(pairs)).select("id", "flat", F.array_sort(T.numbers(F.col("flat"))).alias("numbers"))
    left, right = (marked.withColumnsRenamed({"id": k, "flat": f"f{k}", "numbers": f"m{k}"}) for k in "ab")
    joined = pairs.join(left, "a").join(right, "b")
    if same_numbers:
        joined = joined.where("ma = mb")
    if ratio is None:
        return joined.select("a", "b", "jaccard"), members
    scored = joined.select("a", "b", "jaccard", T.indel_ratio(F.col("fa"), F.col("fb")).alias("ratio"))
    return scored.where(F.col("ratio") >= ratio), members
