"""Lines that a page layout broke, joined again: every boundary between two lines is judged, and texts are rewritten until
nothing changes.

A boundary is kept or glued by the first rule that holds (`RULES`): what a line is (a list item, a table row, a number, a
formula) forbids gluing first; then how the upper line ends and how the lower one begins decide. A glued boundary becomes one space.
Gluing may make a formula whole again or change what a line is, so the judged lines are joined and judged anew, only for
texts that changed, until none does; gluing a result again therefore changes nothing. A text with its lines is one row throughout. Nothing is joined across a hyphen: such
places are counted as doubtful.

A text with more than `MOST_GLUED` joins, or a new line of more than `LONGEST` characters, keeps its form and says why.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.sources.scratch import Scratch

# The limits, what ends and closes a sentence, the words that leave a line hanging, and the reasons' names below.
MOST_GLUED, LONGEST = 80, 2500
TERMINAL, CLOSERS = ".?!;…", ")]\"'»”"
HANGING = "a an the of in on at to for and or nor but is are was were be by with from as that which this these if than not und der die das et de la le y el en que con por"


@dataclass(frozen=True)
class Test:
    """A pattern that one of a boundary's parts must match: `above`, `below` (trimmed at the boundary), `upper`, `lower` (whole lines,
    trimmed), `tail` (above without closing marks). Patterns keep to what all regular-expression engines share."""

    part: str
    pattern: str


_STRONG = rf"([,(«„=+*/×·–—-]|(^|[\s(«„])({'|'.join(HANGING.split())}))$"
_WEAK = r"[\p{Ll},]$"
_NUMERIC = r"^[\d\s.,;:%()+*/^=<>≈±−–—-]*\d[\d\s.,;:%()+*/^=<>≈±−–—-]*$"
_QUANTITY = r"^\p{L}{1,6}\s*\(\s*\d{1,4}\s*\)\s*=\s*\??\s*[-+−]?\d*[.,]?\d*\s*[;,]?$"
_DISPLAY = r"^(\$\$|\\\[|\\begin\{)|(\$\$|\\\]|\\end\{[A-Za-z*]+\})\s*[.,;:]?$"
_TABLE = r"\\hline|^\|.*\||&.*&|\|.*\||^[\s:|-]+\|[\s:|-]*$"
_MARKER = r"^([•▪●◦*–—-]\s|\(?[ivxlcIVXLC]{2,5}[.)]|\(?\p{L}\)|\p{L}\.\s|\(?\d{1,3}\)|\d{1,3}\.\s|\\item)"
_LABEL = r"(?i)^\(?(solution|answer|given|find|note|hint|remark|question|task|problem|part|option|example|решение|ответ|дано|найти|задача|вопрос)\s*\d{0,3}\s*[:.)]"
_LABEL_NUMBER = r"^[^:]{1,80}:\s*[+−-]?[\d\s.,%]+$"
_DATA_ROW = r"^[^:.!?;]{1,60}\s[+−-]?\d[\d\s.,]*%?$"

#: (verdict, reason, alternatives): a rule holds if all tests of one of its alternatives do.
RULES: list[tuple[str, str, list[list[Test]]]] = [
    ("keep", "blank", [[Test("upper", "^$")], [Test("lower", "^$")]]),
    ("keep", "list_marker", [[Test("below", _MARKER)]]),
    ("keep", "service_label", [[Test("below", _LABEL)]]),
    ("keep", "list_quantity_item", [[Test("upper", _QUANTITY)], [Test("lower", _QUANTITY)]]),
    ("keep", "display_math", [[Test("upper", _DISPLAY)], [Test("lower", _DISPLAY)]]),
    ("keep", "table_row", [[Test("upper", _TABLE)], [Test("lower", _TABLE)]]),
    ("keep", "numeric_line", [[Test("upper", _NUMERIC)], [Test("lower", _NUMERIC)]]),
    ("keep", "label_number_pair", [[Test("upper", _LABEL_NUMBER), Test("lower", _LABEL_NUMBER)]]),
    ("keep", "data_row_pair", [[Test("upper", _DATA_ROW), Test("lower", _DATA_ROW)]]),
    ("keep", "empty_tail", [[Test("tail", "^$")]]),
    ("keep", "terminated", [[Test("tail", f"[{TERMINAL}]$")]]),
    ("keep", "colon_intro", [[Test("tail", ":$")]]),
    ("keep", "hyphen_doubt", [[Test("tail", r"\p{L}-$")]]),
    ("keep", "math_start", [[Test("below", r"^\$")]]),
    ("glue", "currency", [[Test("below", r"^\\\$\d"), Test("tail", _WEAK)], [Test("below", r"^\\\$\d"), Test("tail", _STRONG)]]),
    ("keep", "latex_command_start", [[Test("below", r"^\\")]]),
    ("glue", "lowercase", [[Test("below", r"^\p{Ll}")]]),
    ("glue", "punct_continuation", [[Test("below", "^[,;)»]")]]),
    ("glue", "operator", [[Test("below", "^=")]]),
    ("keep", "year_row", [[Test("below", r"^(19|20)\d\d\s*[—–-]")]]),
    ("glue", "digit_continuation", [[Test("below", r"^\d"), Test("tail", _WEAK)], [Test("below", r"^\d"), Test("tail", _STRONG)]]),
    ("keep", "digit_unclear", [[Test("below", r"^\d")]]),
    ("glue", "paren_continuation", [[Test("below", r"^\(\p{Ll}")]]),
    ("glue", "upper_after_strong", [[Test("below", r"^\p{Lu}"), Test("tail", _STRONG)]]),
    ("keep", "upper_start", [[Test("below", r"^\p{Lu}")]]),
]
#: Whole lines are searched for these patterns only where they have a character that each match has (`HAS`).
NEEDS = {_QUANTITY: "digit", _NUMERIC: "digit", _DATA_ROW: "digit", _LABEL_NUMBER: "colon", _DISPLAY: "marks", _TABLE: "marks"}
HAS = {"digit": r"\d", "colon": ":", "marks": r"[$\\|&]"}
#: What is trimmed, and the number of formula signs of a line, each pair of dollars being none.
BLANKS = " \t\r\f\x0b\u00a0"
SIGNS = r"\\.|\$\$|[^$]"
#: The same over all lines of a text at once, its line breaks left; and how much of a tail the rules look at, no less than their
#: longest word and what stands before it.
BREAKS_AND_SIGNS = r"\\.|\$\$|[^$\\\n]+|\\"
END = 12


def verdict(parts: dict[str, Column]) -> Column:
    """`keep:reason` or `glue:reason` of a boundary; parts as in `Test`, `inside`, whether a formula is open there, and whether
    upper and lower have what `NEEDS` names, as upper_marks and so on."""
    out = F.when(parts["inside"], F.lit("keep:inside_math"))
    for what, reason, alternatives in RULES:
        holds = F.lit(False)
        for tests in alternatives:
            every = F.lit(True)
            for test in tests:
                here = parts[test.part].rlike(test.pattern)
                if test.pattern in NEEDS:
                    here = parts[f"{test.part}_{NEEDS[test.pattern]}"] & here
                every = every & here
            holds = holds | every
        out = out.when(holds, F.lit(f"{what}:{reason}"))
    return out.otherwise(F.lit("keep:other_start"))


def judged(texts: DataFrame) -> DataFrame:
    """`texts` (lines and any more) with `verdicts`, one on the boundary after each line but a text's last; null lines have none."""
    # What is left of the whole text are its formula signs and line breaks; a break behind an odd number of signs is inside a formula.
    left = F.regexp_replace(F.array_join("lines", "\n"), BREAKS_AND_SIGNS, "")
    inside = F.flatten(F.transform(F.split(left, r"\$", -1), lambda breaks, k: F.array_repeat(k % 2 == 1, F.length(breaks))))
    blanks, closers = F.lit(BLANKS), F.lit(BLANKS + CLOSERS)

    def parts(line: Column, inside: Column) -> Column:
        below, tail = F.ltrim(line, blanks), F.right(F.rtrim(line, closers), F.lit(END))
        has = [line.rlike(pattern).alias(name) for name, pattern in HAS.items()]
        return F.struct(below.alias("below"), F.trim(line, blanks).alias("whole"), tail.alias("tail"), inside.alias("inside"), *has)

    def boundary(x: Column, y: Column) -> Column:
        has = {f"{part}_{name}": line[name] for part, line in (("upper", x), ("lower", y)) for name in HAS}
        # No rule looks at `above`.
        return verdict({"below": y["below"], "upper": x["whole"], "lower": y["whole"], "tail": x["tail"], "inside": x["inside"], **has})

    marked = texts.withColumn("parts", F.zip_with(F.col("lines"), inside, parts))
    others = F.size("lines") - 1
    return marked.withColumn("verdicts", F.zip_with(F.slice("parts", F.lit(1), others), F.slice("parts", F.lit(2), others), boundary)).drop("parts")


def joined(seen: DataFrame) -> DataFrame:
    """The texts (lines, made, glued, verdicts and any more) after one rewriting, and `changed`, whether it joined any lines; made
    tells of each line whether it was joined of several, glued counts the joins so far."""
    blanks = F.lit(BLANKS)
    marked = seen.withColumn("glue", F.transform("verdicts", lambda v: v.startswith("glue")))
    at = lambda k: F.coalesce(F.get("glue", k), F.lit(False))
    last = F.size("lines") - 1

    def piece(line: Column, k: Column) -> Column:
        left = F.when(at(k - 1), F.ltrim(line, blanks)).otherwise(line)
        return F.when(at(k), F.concat(F.rtrim(left, blanks), F.lit(" "))).when(k < last, F.concat(left, F.lit("\n"))).otherwise(left)

    whole = F.split(F.array_join(F.transform("lines", piece), ""), "\n", -1)
    first = F.filter(F.sequence(F.lit(0), last), lambda k: ~at(k - 1))
    made = F.transform(first, lambda k: F.get("made", k) | at(k))
    joins = F.size(F.filter("glue", lambda g: g))
    changed = F.coalesce(joins > 0, F.lit(False))
    new = {"lines": F.when(changed, whole).otherwise(F.col("lines")), "made": F.when(changed, made).otherwise(F.col("made")), "glued": F.col("glued") + joins, "changed": changed}
    return marked.withColumns(new).drop("glue")


def glue_lines(texts: DataFrame, most: int = MOST_GLUED, longest: int = LONGEST, rounds: int = 20) -> DataFrame:
    """(id, text, glued, doubtful, held): each text (id, text) with its broken lines joined, how many joins were made, how many
    doubtful hyphens there are, and `too_many_glues` or `giant_paragraph` where a guard holds the text back, which then stays as it was.

    A text stays one row with its lines as an array, so nothing is shuffled. A null text stays null. Two rounds at a time write the
    texts that the last one before changed, which few do twice; rounds are few, as each shortens a text."""
    scratch = Scratch(texts.sparkSession, "gluing")
    lines = texts.select("id", "text", F.split("text", "\n", -1).alias("lines"))
    now = lines.withColumn("made", F.transform("lines", lambda _: F.lit(False))).withColumn("glued", F.lit(0).cast("long"))
    settled: DataFrame | None = None
    for turn in range(1, rounds + 1, 2):
        seen = judged(now)
        if turn == 1:
            # Doubts are told of the text as it was given.
            seen = seen.withColumn("doubtful", F.size(F.filter("verdicts", lambda v: v == "keep:hyphen_doubt")).cast("long"))
        again = judged(joined(seen).drop("verdicts", "changed"))
        done = scratch.keep(joined(again).drop("verdicts"), str(turn))
        same, now = done.where(~F.col("changed")), done.where("changed")
        settled = same if settled is None else settled.unionByName(same)
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"gluing did not settle in {rounds} rounds")
    giant = F.exists(F.arrays_zip("lines", "made"), lambda x: x["made"] & (F.length(x["lines"]) > longest))
    held = F.when(F.col("glued") > most, "too_many_glues").when(giant, "giant_paragraph")
    text = F.when(F.col("held").isNull(), F.array_join("lines", "\n")).otherwise(F.col("text"))
    out = settled.withColumn("held", held)
    return out.select("id", text.alias("text"), F.coalesce("glued", F.lit(0)).alias("glued"), F.coalesce("doubtful", F.lit(0)).alias("doubtful"), "held")


def sql_verdict() -> str:
    """The same verdict as an SQL expression over above, below, upper, lower, tail and inside."""
    cases = ["when inside then 'keep:inside_math'"]
    for what, reason, alternatives in RULES:
        either = " or ".join("(" + " and ".join(f"regexp_matches({t.part}, '{t.pattern.replace(chr(39), chr(39) * 2)}')" for t in tests) + ")" for tests in alternatives)
        cases.append(f"when {either} then '{what}:{reason}'")
    return f"case {' '.join(cases)} else 'keep:other_start' end"
