"""Secret scans: fixed patterns, plus strings in a sensitive context that zstandard cannot compress.

Base kinds, leftmost and non-overlapping for each: `assign` (a password-like name, a separator and a value of at least 6
characters), `access` (AKIA and at least 16 more) and `hex` (at least 24 digits). Positions are code points, the end is
exclusive, and a span is the whole match. Null text counts as empty; an empty table gives no rows; repeated rows give
repeated results; other columns are ignored, whatever their names.

The method adds spans of kind `novel`: a run of at least `SHORTEST` key-like characters that mixes small letters, capitals and digits,
stands on a line with a sensitive word shortly before it, and overlaps no base span, is compressed by zstandard primed with
a dictionary of common identifiers, once with and once without it after the surrounding text. Its marginal bytes over its length
are its novelty; a string that the text around it or the dictionary explains costs few bytes and is not reported. Where the kinds
of characters change as often as in a random string (`DENSE`), `NOVELTY` is asked of it, else, with `MIN_DIGITS` digits and letters at
least, the larger `SPARSE_NOVELTY`, as names with numbers in them are novel too. Copies of the string itself don't explain it: a secret
that is written twice is reported twice. On planted random strings of nine kinds (base 62, 64 and 36, hexadecimal, UUIDs, three-part
tokens, 16 to 110 characters) in ten sensitive phrases the tests ask for nine in ten.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.llm.rows import sliced

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Words that make a line a sensitive context, and how many code points before a string they are looked for.
CONTEXT = re.compile(r"(?:auth|bearer|cookie|credential|login|passphrase|private|pwd|session|signature|signing|key|secret|token|password)", re.I | re.A)
CONTEXT_WORDS = (b"auth", b"bearer", b"cookie", b"credential", b"login", b"passphrase", b"private", b"pwd", b"session", b"signature", b"signing", b"key", b"secret", b"token", b"password")
BEFORE, AROUND = 48, 1024
SHORTEST, MIN_DIGITS, DENSE, NOVELTY, SPARSE_NOVELTY = 12, 3, 0.3, 0.45, 0.8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{%d,}={0,2}" % SHORTEST)
#: Where the kind of character changes: small letters, capitals, digits.
CHANGE = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")

#: What code around a secret consists of; raw content of the compression dictionary.
IDENTIFIERS = (
    "access_key account_id address admin api_key application args array async auth authorization await base64 bearer boolean "
    "bucket bytes cache callback certificate class client client_id client_secret cluster config configuration connection const "
    "content context cookie count create credentials data database debug decode default delete description digest dict domain "
    "double else email enable encode encoding endpoint environment error except export false field file filename final float "
    "format function global handler hash header host http https id import index init input insert instance integer interface "
    "item json key label length level list load local localhost logger login main map master message metadata method model "
    "module name namespace new node none null number object options output package parameter parse passphrase password path "
    "payload port prefix private private_key process production property protected proxy public public_key query queue read "
    "record region remote replace request response result return role root route schema scope script secret secret_key select "
    "self server service session session_token set sha256 signature source static status storage stream string struct table "
    "task test text thread time timeout timestamp token true type undefined update upload url user username uuid value var "
    "vector version void volume worker write yaml zone abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"
)


class Novelty:
    """Marginal compressed bytes of a string after its surroundings."""

    def __init__(self, dictionary: str = IDENTIFIERS) -> None:
        raw = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).replace(text[start:end], "").encode()
        alone = len(self.compressor.compress(around))
        both = len(self.compressor.compress(around + text[start:end].encode()))
        return (both - alone) / (end - start)


def wanted_novelty(string: str) -> float | None:
    """How novel a string must be to be reported; None if its characters aren't mixed enough for a key at all."""
    if len(string) < SHORTEST or string.isdecimal():
        return None
    if len(CHANGE.findall(string)) >= DENSE * (len(string) - 1):
        return NOVELTY
    digits, letters = sum(c.isdigit() for c in string), sum(c.isalpha() for c in string)
    return SPARSE_NOVELTY if digits >= MIN_DIGITS and letters >= MIN_DIGITS else None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, ordered."""
    found, low = [], text.encode().lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in low:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str | None, novelty: Novelty) -> list[tuple[int, int, int]]:
    """Base spans and novel ones, ordered by start, then kind."""
    text = text or ""
    base = base_spans(text)
    low = text.encode().lower()
    if not any(word in low for word in CONTEXT_WORDS):
        return base
    out = list(base)
    for m in CANDIDATE.finditer(text):
        s, e = m.start(), m.start() + len(m[0].rstrip("._-/"))
        least = wanted_novelty(text[s:e])
        if least is None or any(a < e and s < b for a, _, b in base):
            continue
        line = text[max(0, s - BEFORE) : s].rpartition("\n")[2]
        if CONTEXT.search(line) and novelty(text, s, e) >= least:
            out.append((s, 3, e))
    return sorted(out)


SPANS = "array<struct<kind:string,start:int,end:int>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row per input row, spans an array of (kind, start, end) ordered by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t.as_py(), novelty)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS_ARROW)], names=["doc_id", "spans"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id long, spans {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: str | None, novelty: Novelty, mask: str) -> str | None:
    """The text with every span, and what spans overlap into, replaced by the mask."""
    spans = all_spans(text, novelty)
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """`docs` with all their columns and rows, the secrets in their texts replaced; null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in sliced(batches):
            texts = pa.array([masked(t.as_py(), novelty, mask) for t in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)
