"""Text functions as column expressions; pandas only where Spark has no built-in (NFKC, indel ratio)."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructType

# The dashes that count as a hyphen, and Latin letters that look like Cyrillic ones.
DASHES = "‐‑‒–—−―"
LATIN, CYRILLIC = "aeocpxy", "аеосрху"
WORD = "[a-z0-9à-ÿ]+(-[a-z0-9à-ÿ]+)*"
NUMBER = "-?[0-9]+([.,][0-9]+)?"


def collapse(text: Column) -> Column:
    """White space runs become one space, ends are trimmed, letters lower-cased."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0b]+", " "))


def plain_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def label_form(text: Column) -> Column:
    """Labels compare equal whichever alphabet their look-alike letters are from, and with or without dots on e."""
    return F.translate(F.lower(F.trim(text)), "ё" + LATIN, "е" + CYRILLIC)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)


def statement_form(text: Column) -> Column:
    """For comparison only: NFKC, lower case, punctuation dropped, digits kept."""
    return F.trim(F.regexp_replace(F.translate(F.lower(nfkc(plain_dashes(text))), "ё", "е"), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """Words with inner hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def query_terms(text: Column, stop: list[str], limit: int = 6) -> Column:
    """Distinct words without stop words, abbreviations in capitals first, then short before long, then by order."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9À-ÿ]+"), 0))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(stop) & (F.length(w) > 1))
    keyed = F.transform(kept, lambda w, k: F.struct((w != F.upper(w)).cast("int").alias("low"), F.length(w).alias("n"), k.alias("k"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(keyed), 1, limit), lambda s: s["w"])


def numbers(text: Column) -> Column:
    """Signed numbers in order of appearance, decimal commas as points, without needless zeros."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), 0)
    return F.transform(found, canonical_number)


def canonical_number(token: Column) -> Column:
    """1,50 and 01.5 become 1.5, 2.0 becomes 2, -0 becomes 0."""
    point = F.regexp_replace(F.translate(token, ",", "."), r"^(-?)0+([0-9])", "$1$2")
    short = F.when(point.contains("."), F.regexp_replace(F.regexp_replace(point, "0+$", ""), r"\.$", "")).otherwise(point)
    return F.when(short.isin("-0", ""), "0").otherwise(short)


def trigrams(text: Column) -> Column:
    """Distinct character trigrams; a text of fewer than three characters stands for itself. One pass, whatever the length."""
    return F.array_distinct(F.when(F.length(text) < 3, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), 1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigram_jaccard_of(a: str, b: str) -> float:
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} or {t} for t in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both)


@F.pandas_udf(DoubleType())
def trigram_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """`jaccard` of the `trigrams` of two texts, whose sets exist for one pair at a time; null where either text is."""
    return pd.Series([trigram_jaccard_of(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")


#: Bits of a text's trigrams that stand for it in `trigram_bound`.
SKETCH = 2048


def trigram_sketch_of(text: str) -> tuple[int, bytes]:
    """How many trigrams a text has, and a bit for each trigram's hash; a text of one or two characters is its own."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) > 2:
        keys = np.unique(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:])
    else:
        keys = np.array([1 << 63 | sum(int(c) + 1 << 22 * k for k, c in enumerate(codes))], np.uint64)
    bits = np.zeros(SKETCH, bool)
    bits[(keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SKETCH.bit_length() + 1)] = True
    return len(keys), np.packbits(bits).tobytes()


@F.pandas_udf(StructType().add("n", LongType()).add("bits", BinaryType()))
def trigram_sketch(text: pd.Series) -> pd.DataFrame:
    """`trigram_sketch_of` each text; null where there is none."""
    rows = [trigram_sketch_of(t) if isinstance(t, str) else (None, None) for t in text]
    return pd.DataFrame({"n": pd.array([n for n, _ in rows], "Int64"), "bits": [b for _, b in rows]})


@F.pandas_udf(DoubleType())
def trigram_bound(na: pd.Series, a: pd.Series, nb: pd.Series, b: pd.Series) -> pd.Series:
    """What `trigram_jaccard` can be at most, by two texts' sketches: a bit of one alone is a trigram that the other hasn't."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if known.any():
        x, y = (np.frombuffer(b"".join(c[known]), np.uint8).reshape(known.sum(), -1) for c in (a, b))
        p, q = (c[known].to_numpy(float) for c in (na, nb))
        both = np.minimum(p - np.bitwise_count(x & ~y).sum(axis=1), q - np.bitwise_count(y & ~x).sum(axis=1))
        out[known] = both / (p + q - both)
    return pd.Series([v if k else None for v, k in zip(out, known)], dtype="object").astype("Float64")


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def number_verdict(a: Column, b: Column) -> Column:
    """How the number sets of two texts compare."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return (
        F.when((F.size(x) == 0) & (F.size(y) == 0), "none")
        .when((both == F.size(x)) & (both == F.size(y)), "equal")
        .when(both == 0, "disjoint")
        .when((both == F.size(x)) | (both == F.size(y)), "subset")
        .otherwise("overlap")
    )


def weak_numbers(a: Column) -> Column:
    """No numbers at all, or at most four different ones that are all digits 1 to 9: too little to tell texts apart."""
    d = F.array_distinct(a)
    return (F.size(d) == 0) | ((F.size(d) <= 4) & F.forall(d, lambda n: n.rlike("^[1-9]$")))


def shorten(text: Column, limit: int) -> Column:
    """At most `limit` characters of the collapsed text, cut after a whole word, with an ellipsis only if something was cut."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))
    head = F.regexp_extract(F.substring(flat, 1, limit), "^(.*) [^ ]*$", 1)
    whole = F.when(F.substring(flat, limit + 1, 1) == " ", F.substring(flat, 1, limit)).otherwise(F.when(head == "", F.substring(flat, 1, limit)).otherwise(head))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(whole, "[ ,.;:!?-]+$", ""), F.lit("…")))


def within_budgets(blocks: Sequence[tuple[int | None, Column]]) -> Column:
    """Blocks in order joined by spaces, each cut to its budget of characters if it has one; null and empty ones are left out."""
    return F.concat_ws(" ", *[F.nullif(block if budget is None else F.left(block, F.lit(budget)), F.lit("")) for budget, block in blocks])


def masked_numbers(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "#")


def script_language(text: Column) -> Column:
    """ru where Cyrillic letters are at least as many as Latin ones, else en."""
    cyrillic = F.length(F.regexp_replace(text, "[^а-яёА-ЯЁ]", ""))
    latin = F.length(F.regexp_replace(text, "[^a-zA-Z]", ""))
    return F.when((cyrillic > 0) & (cyrillic >= latin), "ru").otherwise("en")


def without_math(text: Column) -> Column:
    """Display and inline formulas become a space."""
    return F.regexp_replace(text, r"(?s)\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)", " ")


def cleaned(text: Column) -> Column:
    """Spaces before marks and doubled spaces go; a text whose signed numbers would change keeps its form."""
    fixed = F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+([,.;:!?])", "$1"), r"[ \t]{2,}", " "))
    return F.when(numbers(fixed) == numbers(text), fixed).otherwise(text)


def normal_url(url: Column) -> Column:
    """https, no www., no query or fragment, no closing slash, host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z]+://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/]*(.*)$", 1), "/+$", "")
    return F.concat(F.lit("https://"), host, path)


def formula_safe(cell: Column) -> Column:
    """An apostrophe before cells that a spreadsheet would take for a formula."""
    return F.when(cell.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Slavic plural by the last two digits."""
    last, two = n % 10, n % 100
    return F.when((last == 1) & (two != 11), one).when(last.between(2, 4) & ~two.between(12, 14), few).otherwise(many)


def parsed_number(text: Column) -> Column:
    """A decimal from digits with comma or point, a fraction a/b or a unicode minus; anything else is null."""
    flat = F.translate(F.trim(plain_dashes(text)), ", ", ".")
    top, bottom = (F.regexp_extract(flat, r"^(-?[0-9]+)/([0-9]+)$", k).try_cast("double") for k in (1, 2))
    plain = F.when(flat.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), flat.try_cast("double"))
    return F.coalesce(plain, F.when(bottom != 0, top / bottom))


def open_answer_right(correct: Column, given: Column, tolerance: Column) -> Column:
    """Numbers within the tolerance, else equal normalised texts."""
    a, b = parsed_number(correct), parsed_number(given)
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= tolerance + 1e-12), collapse(correct) == collapse(given), F.lit(False))


def label_set(raw: Column) -> Column:
    """Answer labels in any notation (`A, c`, `ac`, `A;C`, `a) c)`) as a sorted set of letters."""
    letters = F.regexp_extract_all(F.lower(raw), F.lit("[a-z]"), 0)
    return F.array_sort(F.array_distinct(letters))


def grade_numbers(text: Column) -> Column:
    """`7-11` or `9, 11` as sorted numbers; reversed bounds are swapped, other texts give an empty array."""
    flat = F.translate(plain_dashes(text), " ", "")
    parts = F.split(flat, ",")

    def part(p: Column) -> Column:
        a = F.regexp_extract(p, "^([0-9]{1,2})(-([0-9]{1,2}))?$", 1).try_cast("int")
        b = F.coalesce(F.regexp_extract(p, "^([0-9]{1,2})-([0-9]{1,2})$", 2).try_cast("int"), a)
        return F.when(a.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.least(a, b), F.greatest(a, b)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, part))))


def grade_text(numbers_: Column) -> Column:
    """Sorted numbers as ranges: 7, 8, 9, 11 gives `7-9, 11`."""
    zero = F.struct(F.lit("").alias("done"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def closed(s: Column) -> Column:
        run = F.when(s["first"] == s["last"], s["first"].cast("string")).otherwise(F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string")))
        return F.when(s["first"].isNull(), s["done"]).when(s["done"] == "", run).otherwise(F.concat(s["done"], F.lit(", "), run))

    def step(s: Column, n: Column) -> Column:
        grows = s["last"].isNotNull() & (n == s["last"] + 1)
        return F.struct(F.when(grows, s["done"]).otherwise(closed(s)).alias("done"), F.when(grows, s["first"]).otherwise(n).alias("first"), n.alias("last"))

    return F.aggregate(numbers_, zero, step, closed)


def indel_ratio_of(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|), by bit-parallel dynamic programming; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        met = state & masks.get(c, 0)
        state = ((state + met) | (state - met)) & full
    return 2 * (len(a) - state.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Order-sensitive similarity of two texts; null where either is."""
    return pd.Series([indel_ratio_of(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")


# English number words.
UNITS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
)
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_words(text: Column, most: int = 3000) -> Column:
    """The first chain of number words as a number: thousands and hundreds multiply; over `most` or none is null."""
    value = {w: k for k, w in enumerate(UNITS)} | {w: 20 + 10 * k for k, w in enumerate(TENS)} | {"hundred": 100, "thousand": 1000}
    lookup = F.create_map(*[F.lit(x) for pair in value.items() for x in pair])
    known = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0), lambda w: F.try_element_at(lookup, w))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("part"), F.lit(0).alias("phase"))

    def step(s: Column, v: Column) -> Column:
        going = (s["phase"] < 2) & v.isNotNull()
        part = F.when(v == 100, F.greatest(s["part"], F.lit(1)) * 100).when(v == 1000, F.lit(0)).otherwise(s["part"] + v)
        total = F.when(v == 1000, s["total"] + F.greatest(s["part"], F.lit(1)) * 1000).otherwise(s["total"])
        ended = (s["phase"] == 1) & v.isNull()
        return F.when(going, F.struct(total.alias("total"), part.alias("part"), F.lit(1).alias("phase"))).otherwise(
            F.struct(s["total"].alias("total"), s["part"].alias("part"), F.when(ended, 2).otherwise(s["phase"]).alias("phase"))
        )

    done = F.aggregate(known, zero, step)
    return F.when((done["phase"] > 0) & (done["total"] + done["part"] <= most), done["total"] + done["part"])
