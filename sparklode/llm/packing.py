"""Packing documents into fixed-length training sequences by the sum-of-squares rule.

Tokens: the text's ids by the given vocabulary file without special tokens, then one end id. White space never reaches a
token of that vocabulary, so a text is encoded piece by piece between ASCII white space, and each distinct piece once a
task. Null text counts as empty (one end token); rows with equal texts are packed one by one; only documents longer than
a sequence are cut. Other columns of the input are ignored, whatever their names.

Placement: open sequences are counted by residual gap, N(g). Each piece goes where the sum of N(g) squared becomes
smallest, counting a new sequence as one more choice; a full sequence is no longer counted. Pieces are dealt at random to
groups of about `GROUP` pieces and each group is packed in one task, longest piece first; the sequences a group leaves
short are packed again together with other groups' in a second round, so only one group's remainder is lost in each
`GROUP` pieces. No group grows with the input, only their number does.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.sources.scratch import Scratch, setting

SEQUENCE, END_ID, GROUP = 2048, 0, 8192
#: Bound on the chunks whose ids a task remembers; texts that are split, and chunks that are encoded, at once.
REMEMBERED, TEXTS, AT_ONCE = 600_000, 100, 4096
#: Whole texts that Arrow hands to a worker at once, on both sides.
HANDED = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
MARKS = b".,;:!?*#%&$|()"


def tokenizer_path() -> str:
    """The vocabulary file that comes with the machine image."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@cache
def _tokenizer(vocabulary: str) -> tuple[Any, np.ndarray]:
    """The tokenizer, one for all tasks of a worker, and which of its ids end a word."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    suffix = tokenizer.model.end_of_word_suffix or ""
    return tokenizer, np.array([bool(suffix) and (tokenizer.id_to_token(k) or "").endswith(suffix) for k in range(tokenizer.get_vocab_size())])


class ChunkEncoder:
    """Ids of chunks of text, remembered as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: str) -> None:
        assert array("I").itemsize == 4
        self.tokenizer, self.ends_word = _tokenizer(vocabulary)
        self.known: dict[bytes, bytes] = {}

    def _one_by_one(self, chunks: list[bytes]) -> None:
        for k in range(0, len(chunks), AT_ONCE):
            some = chunks[k : k + AT_ONCE]
            for chunk, got in zip(some, self.tokenizer.encode_batch_fast([c.decode() for c in some], add_special_tokens=False)):
                self.known[chunk] = array("I", got.ids).tobytes()

    def _words(self, words: list[bytes]) -> None:
        """Letters only, so each is one word of the vocabulary's rules and ends in one word-end token: one call does for all."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.nonzero(self.ends_word[ids])[0] + 1) * 4
        if len(ends) != len(words):
            self._one_by_one(words)
            return
        raw, ends = ids.tobytes(), ends.tolist()
        self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *ends], ends))))

    def learn(self, chunks: set[bytes]) -> None:
        """Put unseen chunks into `known`. Marks after letters are a word of their own, so letters and marks are joined."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        # Looks each chunk up; `chunks - self.known.keys()` would walk through all that is known instead.
        unseen = {c for c in chunks if c not in self.known}
        stems = {c: c.rstrip(MARKS) for c in unseen}
        marked = {c: w for c, w in stems.items() if w and w != c and w.decode().isalpha()}
        wanted = (unseen - marked.keys()) | set(marked.values()) | {c[len(w) :] for c, w in marked.items()}
        new = [c for c in wanted if c not in self.known]
        words = [c for c in new if c.decode().isalpha()]
        # The tokenizer holds hundreds of bytes for each word of a call.
        for k in range(0, len(words), AT_ONCE):
            self._words(words[k : k + AT_ONCE])
        self._one_by_one([c for c in new if c not in self.known])
        for chunk, stem in marked.items():
            self.known[chunk] = self.known[stem] + self.known[chunk[len(stem) :]]


def chunks_of(text: str | None) -> list[bytes]:
    """The text between ASCII white space, A-Z lower-cased as the vocabulary does, unless special strings may be in it."""
    raw = (text or "").encode()
    return (raw if b"<|" in raw else raw.lower()).split()


def tokenized_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): every document cut into runs of at most `length` ids, as little-endian bytes."""
    end, step = np.asarray([end_id], "<u4").tobytes(), 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        # What earlier tasks of this worker left free.
        pa.default_memory_pool().release_unused()
        encoder = ChunkEncoder(vocabulary)
        names = ["doc_id", "piece", "start", "length", "ids"]
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                split = [chunks_of(t) for t in part.column(1).to_pylist()]
                encoder.learn(set().union(*split))
                rows = []
                for doc, chunks in zip(part.column(0).to_pylist(), split):
                    ids = b"".join(map(encoder.known.__getitem__, chunks)) + end
                    for k, at in enumerate(range(0, len(ids), step)):
                        piece = ids[at : at + step]
                        rows.append((doc, k, at // 4, len(piece) // 4, piece))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)], names=names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def sum_of_squares_bins(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size in the given order, by the sum-of-squares rule; ties go to the smallest gap."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    out, bins = [], 0
    for size in sizes:
        here = count[size:]
        cost = 2 * (count[: capacity + 1 - size] - here) + 2
        cost[0] = 1 - 2 * here[0]
        cost[here == 0] = np.iinfo(np.int64).max
        at = int(cost.argmin())
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        if here[at] and cost[at] <= fresh:
            gap = size + at
            chosen = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, chosen, bins = capacity, bins, bins + 1
        if left := gap - size:
            open_bins[left].append(chosen)
            count[left] += 1
        out.append(chosen)
    return out


def _pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
    rows["bin"] = sum_of_squares_bins(rows["length"].tolist(), capacity)
    rows["offset"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
    rows["fill"] = rows.groupby("bin")["length"].transform("sum")
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE, group: int = GROUP, good: float = 1.0) -> DataFrame:
    """`pieces` (doc_id, piece, start, length and any more) with sequence_id and offset.

    Two rounds: sequences of the first that are less full than `good` are opened again and packed with those of other
    groups. An empty table gives no rows.
    """
    scratch = Scratch(pieces.sparkSession, "packing")
    with setting(scratch.spark, *HANDED):
        pieces = scratch.keep(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    slim = pieces.select("row", "length")
    fields = "row long, length long, grp long, bin long, offset long, fill long"

    def packed(rows: DataFrame, groups: int, salt: int) -> DataFrame:
        dealt = rows.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(groups)))
        return dealt.groupBy("grp").applyInPandas(lambda pdf: _pack_group(pdf, capacity)[[f.split()[0] for f in fields.split(", ")]], fields)

    groups = max(1, -(-slim.count() // group))
    first = scratch.keep(packed(slim, groups, 1), "first")
    done = first.where(F.col("fill") >= good * capacity).withColumn("round", F.lit(0))
    short = first.where(F.col("fill") < good * capacity)
    again = max(1, -(-short.count() // (2 * group)))
    second = packed(short.select("row", "length"), again, 2).withColumn("round", F.lit(1))
    placed = done.unionByName(second)
    number = (F.col("grp") * 2 + F.col("round")) * F.lit(1 << 32) + F.col("bin")
    # Shuffled at every size: the places are as many as the pieces.
    return pieces.join(placed.select("row", number.alias("sequence_id"), "offset").hint("merge"), "row").drop("row")


def best_fit_packing(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, digest: bool = False) -> DataFrame:
    """The pieces of all documents with their place: doc_id, piece, start, length, sequence_id, offset, and ids.

    With `digest`, ids_crc32 (of the little-endian 32-bit ids) stands in for the ids, which then never reach a table.
    """
    pieces = tokenized_pieces(docs, vocabulary or tokenizer_path(), id_col, text_col, length)
    if digest:
        pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(pieces, length)
