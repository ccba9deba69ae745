"""SentencePiece encoding and decoding with shared-prefix forward passes.

A text's spaces become the mark U+2581 and one mark is put before it. No piece holds a mark after another character, so a
text falls into marked words (marks, then other characters) that are encoded one by one. The distinct marked words of a
batch are sorted, which is a depth-first walk of their trie: the forward values of the prefix that a word shares with the
one before it are kept, and only the rest of the word is computed.

What is kept for each prefix depends on the kind of model. For a unigram model it is Viterbi's best score and the last
piece of the best path. For a model whose encoder merges pairs by score, as the given vocabulary file's does, the best
path by summed scores is not what the library returns; there the value is the last piece of the prefix's own encoding.
An encoding by merges is valid exactly if each pair of neighbours is the encoding of the two together, so every prefix
has one valid last piece, found from the values of shorter prefixes as in Viterbi's recursion. Whether two pieces are
valid neighbours is worked out once and remembered.

Characters outside the vocabulary become byte pieces, or the unknown id where the model has none. Decoding joins the
pieces, turns marks to spaces and takes the first one away; it gives the text back unless it held the mark itself. Null
and empty texts have no ids. Repeated rows are encoded each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Bounds on what a task remembers: marked words, and pairs of pieces.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 700_000, 600_000


def model_path() -> str:
    """The vocabulary file that comes with the machine image."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class SharedPrefixEncoder:
    """Encodes marked words of a vocabulary {piece: (id, score)}.

    merging: whether the model encodes by merging pairs (else by the best sum of scores).
    bytes_: ids of the 256 byte pieces, or None; unknown: the id of what has no piece.
    """

    def __init__(self, vocabulary: dict[str, tuple[int, float]], merging: bool, bytes_: list[int] | None, unknown: int) -> None:
        self.vocabulary, self.merging, self.bytes, self.unknown = vocabulary, merging, bytes_, unknown
        self.longest = max(map(len, vocabulary), default=1)
        self.worst = min((s for _, s in vocabulary.values()), default=0.0) - 10.0
        #: Of every string that ends a piece: 1 if it is one, plus 2 if a longer one ends so, plus 4 if it is one whose own
        #: encoding hasn't been looked at; 1 goes when that turns out to be something else.
        self.ends: dict[str, int] = {}
        for piece in vocabulary:
            self.ends[piece] = self.ends.get(piece, 0) | 5
            for k in range(1, len(piece)):
                self.ends[piece[k:]] = self.ends.get(piece[k:], 0) | 2
        self.neighbours: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding of a short string by merging the best-scored pair again and again, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                got = self.vocabulary.get(parts[k] + parts[k + 1])
                if got is not None and (best is None or got[1] > best):
                    best, at = got[1], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def valid(self, left: str, right: str) -> bool:
        """Whether both stay apart when encoded together, worked out and remembered."""
        if len(self.neighbours) >= REMEMBERED_PAIRS:
            self.neighbours.clear()
        found = self.neighbours[left, right] = self.merged(left + right) == [left, right]
        return found

    def alone(self, piece: str) -> bool:
        """Whether the encoding of the piece's text is the piece, worked out and remembered."""
        found = self.merged(piece) == [piece]
        self.ends[piece] = self.ends[piece] & 2 | found
        return found

    def ids_of(self, piece: str) -> list[int]:
        got = self.vocabulary.get(piece)
        if got is not None:
            return [got[0]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def _last_pieces(self, word: str, first: int, last: list[str]) -> None:
        """Appends to last, which holds the last pieces of the encodings of word[:k] for k < first, those of the longer prefixes."""
        kind_of, known = self.ends.get, self.neighbours.get
        for end in range(first, len(word) + 1):
            start, found = end, []
            while start:
                start -= 1
                part = word[start:end]
                kind = kind_of(part, 0)
                if kind & 1 and (kind < 4 or self.alone(part)):
                    found.append(part)
                if not kind & 2:
                    break
            while found:
                piece = found.pop()
                if len(piece) == end:
                    break
                left = last[end - len(piece)]
                fits = known((left, piece))
                if self.valid(left, piece) if fits is None else fits:
                    break
            else:
                piece = word[end - 1 : end]
            last.append(piece)

    def _best_step(self, word: str, end: int, best: list[tuple[float, str]]) -> tuple[float, str]:
        """The best score of word[:end] and its last piece; the longest of equals."""
        top = (best[end - 1][0] + self.worst, word[end - 1 : end])
        found = None
        for start in range(max(0, end - self.longest), end):
            got = self.vocabulary.get(word[start:end])
            if got is not None and (found is None or best[start][0] + got[1] > found[0]):
                found = (best[start][0] + got[1], word[start:end])
        return found or top

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of each distinct word, in sorted order."""
        before, last, best, vocabulary = "", [""], [(0.0, "")], self.vocabulary
        for word in sorted(set(words)):
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            if self.merging:
                del last[same + 1 :]
                self._last_pieces(word, same + 1, last)
            else:
                del best[same + 1 :]
                for end in range(same + 1, len(word) + 1):
                    best.append(self._best_step(word, end, best))
            before, at, pieces = word, len(word), []
            while at:
                piece = last[at] if self.merging else best[at][1]
                pieces.append(piece)
                at -= len(piece)
            ids: list[int] = []
            for piece in reversed(pieces):
                got = vocabulary.get(piece)
                if got is not None:
                    ids.append(got[0])
                else:
                    ids += self.ids_of(piece)
            yield word, ids


class PieceModel:
    """A SentencePiece vocabulary file as an encoder and a decoder."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=path)
        size = read.get_piece_size()
        special = [read.is_control(k) or read.is_unknown(k) or read.is_unused(k) for k in range(size)]
        bytes_ = {int(read.id_to_piece(k)[3:5], 16): k for k in range(size) if read.is_byte(k)}
        plain = {read.id_to_piece(k): (k, read.get_score(k)) for k in range(size) if not special[k] and not read.is_byte(k)}
        scores = sorted((s for _, s in plain.values()), reverse=True)
        # Merge files number their merges 0, -1, -2, ...; a unigram file holds log-probabilities.
        merging = all(float(s).is_integer() for s in scores)
        self.encoder = SharedPrefixEncoder(plain, merging, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None, read.unk_id())
        self.pieces = [b""] * size
        for piece, (k, _) in plain.items():
            self.pieces[k] = piece.replace(MARK, " ").encode()
        for b, k in bytes_.items():
            self.pieces[k] = bytes([b])
        self.pieces[read.unk_id()] = b" \xe2\x81\x87 "
        self.known: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        split = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        unseen = set().union(*split) - self.known.keys()
        for word, ids in self.encoder.encode_words(unseen):
            self.known[word] = array("I", ids).tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        numbers = array("I")
        numbers.frombytes(ids)
        text = b"".join(map(self.pieces.__getitem__, numbers)).decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, ids) with ids as little-endian 32-bit bytes, and with `decode` also their text again."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids = pieces.encode_batch(part.column(1).to_pylist())
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array(map(pieces.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][: len(columns)])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids binary" + ", text string" * decode)


def decoded(ids: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel(path)
        for batch in batches:
            texts = [pieces.decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
