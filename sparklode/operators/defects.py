"""Classes of defects of an item, markers with their places, signals, signs of damage between two versions, missing figures.

Everything is a pattern or a comparison over columns, so an item is judged in one pass. Patterns keep to what all
regular-expression engines share. "Outside formulas" means the text with its formulas made spaces of one character.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The classes and what each looks for, the markers, words and limits.
FORMULA = r"(?s)\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)"
LINK = r"(https?://|www\.)\S*"
#: Class -> (fields, outside formulas, pattern).
PATTERNS: dict[str, tuple[str, bool, str]] = {
    "A1": ("all", False, r"\\footnote\{"),
    "A2": ("all", True, r"(^|\n)[ \t]*%"),
    "A3": ("all", True, r"(^|[^\\])&"),
    "A4": ("all", True, r"p\{[0-9]+([.,][0-9]+)?(cm|mm)\}"),
    "A5": ("all", True, r"\\%"),
    "A6": ("plain", True, r"(^|[^0-9-])--([^0-9-]|$)"),
    "A7": ("all", True, r"\\(label|ref|cite)\{"),
    "A8": ("all", True, r"\\(textcolor|fcolorbox)\{"),
    "A9": ("title", False, r"^\[[0-9]+\]"),
    "A10": ("title", False, r"^(19|20)[0-9][0-9]\)"),
    "B5": ("statement", False, r"(?i)[aа]\)[^\n]{5,50}[bб]\)"),
    "B7": ("worked", False, r"(?i)(answer|ответ)[ \t]*:"),
    "C3": ("statement", False, r"[А-Яа-яЁё]{5}[A-Za-z]{5}|[A-Za-z]{5}[А-Яа-яЁё]{5}"),
}
TASK_WORDS = r"(?i)\?|find|compute|determine|prove|explain|draw|list|state|найд|опредeл|докаж|объясн"
CYRILLIC_LABEL, LATIN_LABEL = r"(?i)(^|[^\p{L}\p{N}])[абвгд]\)", r"(?i)(^|[^\p{L}\p{N}])[abcde]\)"
FIGURE_WORDS = r"(?i)in the figure|see figure|see graph|на рисунке|на графике|см\.\s*рис"
FIGURE_MARKS = r"\\includegraphics|!\[[^\]]*\]|\[(рис|figure)[^\]]*\]"
SHORT_TITLE, LONG_TITLE, LONG_STATEMENT, STUB, AROUND = 15, 200, 100, 40, 20

MARKERS: dict[str, tuple[bool, str]] = {
    "footnote": (False, r"\\footnote\{"),
    "latex_comment": (False, r"(?m)^[ \t]*%|\}%\S"),
    "pseudo_quotes": (True, r"<<|>>"),
    "bare_latex_cmds": (True, r"\\(emph|textbf|textit|underline|text|rule)\{|\\(hline|item)|\\begin\{(enumerate|itemize)\}"),
    "truncated": (False, r"[,:][ \t\n\r]*$|(^|[^\p{L}])(and|or|but|of|the|in|to|и|или|но|в|на|с)[ \t\n\r]*$"),
    "forum_traces": (False, r"(?i)please help|thanks in advance|помогите|подскажите|спасибо заранее"),
    "spam_links": (False, r"(?i)print version|log in or|t\.me/|vk\.com/|версия для печати|войдите или"),
}

BARE_COMMANDS = r"(^|[^\\A-Za-z])(cdot|times|leq|geq|frac|sqrt|infty)([^A-Za-z]|$)"
TABLE_MARKS = r"&|\\hline|\\begin\{tabular\}"
LIST_HEAD = r"(?im)^[ \t]*(options|questions?|answers|choose|parts|варианты|вопросы?|ответы|выберите)[ \t]*:"
LIST_START = r"^([•*–—-]|\(?[\p{L}\p{N}]{1,3}[).]\s)"
PARAGRAPH, COLLAPSED, SHRUNK = 150, 60, 0.85


def outside(text: Column) -> Column:
    return F.regexp_replace(text, FORMULA, " ")


def snippet(text: Column, pattern: str) -> Column:
    """The first match with up to `AROUND` characters of its line on either side."""
    start, match = F.length(F.regexp_extract(text, first_match(pattern), 1)), F.regexp_extract(text, first_match(pattern), 2)
    before = F.regexp_extract(F.right(F.left(text, start), F.lit(AROUND)), r"[^\n]*\z", 0)
    after = F.regexp_extract(F.substring(text, start + F.length(match) + 1, F.lit(AROUND)), r"\A[^\n]*", 0)
    return F.concat(before, match, after)


def sql_snippet(of: str, pattern: str) -> str:
    """The same as an SQL expression."""
    quoted = "'" + first_match(pattern).replace("'", "''") + "'"
    start, match = f"length(regexp_extract({of}, {quoted}, 1))", f"regexp_extract({of}, {quoted}, 2)"
    return f"(regexp_extract(right(left({of}, {start}), {AROUND}), '[^\\n]*\\z', 0) || {match} || regexp_extract(substr({of}, {start} + length({match}) + 1, {AROUND}), '\\A[^\\n]*', 0))"


def fields(item: Mapping[str, Column]) -> dict[str, Column]:
    """The texts that the patterns look at; item: title, statement, solution, answer, parts (all parts' texts)."""
    none = {k: F.coalesce(v, F.lit("")) for k, v in item.items() if k in ("title", "statement", "solution", "answer", "parts")}
    all_ = F.concat_ws("\n", none["statement"], none["solution"], none["answer"], none["parts"])
    return none | {"all": all_, "plain": F.regexp_replace(all_, LINK, " "), "worked": F.concat_ws("\n", none["statement"], none["solution"])}


def defect_classes(item: Mapping[str, Column]) -> Column:
    """Class -> snippet, of the twenty classes that an item falls into.

    item: the texts of `fields`, and is_test (boolean), n_parts, labels (the parts' labels in one text), n_files."""
    text = fields(item)
    # A one-element array holds the texts, and those without their formulas, so that each is made once and not for every pattern.
    held = F.struct(
        F.trim(text["title"]).alias("title"), text["statement"].alias("statement"), text["worked"].alias("worked"), text["all"].alias("all"),
        outside(text["all"]).alias("all_outside"), outside(text["plain"]).alias("plain_outside"),
    )
    return F.transform(F.array(held), lambda t: _classes(t, item))[0]


def _classes(t: Column, item: Mapping[str, Column]) -> Column:
    title, statement = t["title"], t["statement"]
    found: dict[str, Column] = {}
    for name, (field, plain, pattern) in PATTERNS.items():
        of = t[f"{field}_outside"] if plain else t[field]
        found[name] = F.when(of.rlike(pattern), snippet(of, pattern))
    pool = F.concat_ws("\n", statement, item["labels"])
    bare = F.trim(statement, F.lit(" \t\n\r"))
    found |= {
        "B1": F.when(F.length(title).between(1, SHORT_TITLE - 1), title),
        "B2": F.when(F.length(title) > LONG_TITLE, F.substring(title, 1, LONG_TITLE)),
        "B3": F.when((F.length(statement) > LONG_STATEMENT) & ~statement.rlike(TASK_WORDS) & ~item["is_test"], F.right(statement, F.lit(40))),
        "B4": F.when(item["is_test"] & (item["n_parts"] == 0), F.substring(statement, 1, 100)),
        "B6": F.when(pool.rlike(CYRILLIC_LABEL) & pool.rlike(LATIN_LABEL), F.concat_ws(" + ", snippet(pool, CYRILLIC_LABEL), snippet(pool, LATIN_LABEL))),
        "C1": F.when(statement.rlike(FIGURE_WORDS) & (item["n_files"] == 0), snippet(statement, FIGURE_WORDS)),
        "C2": F.when(F.length(bare).between(1, STUB - 1), bare),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in sorted(found.items())])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def markers(text: Column) -> Column:
    """(marker, start, end) of the first place of each marker that a text has; positions are code points, the end exclusive.

    An unpaired dollar is marked at the first single one. A null text has none."""
    places = []
    for name, (plain, pattern) in MARKERS.items():
        # Formulas are blanked at their own length, so places are those of the text itself.
        of = blanked(text) if plain else text
        start, size = (F.length(F.regexp_extract(of, first_match(pattern), k)) for k in (1, 2))
        places.append(F.when(of.rlike(pattern), F.struct(F.lit(name).alias("marker"), start.alias("start"), (start + size).alias("end"))))
    single = F.replace(text, F.lit("$$"), F.lit("  "))
    odd = F.length(F.regexp_replace(single, "[^$]", "")) % 2 == 1
    at = F.instr(single, F.lit("$")) - 1
    places.append(F.when(odd, F.struct(F.lit("unpaired_dollars").alias("marker"), at.alias("start"), (at + 1).alias("end"))))
    return F.array_sort(F.array_compact(F.array(*places)))


def first_match(pattern: str) -> str:
    """What stands before the first match, and the match."""
    flags = "".join(f for f in "im" if f"(?{f})" in pattern)
    return f"(?s{flags})\\A(.*?)({pattern.replace('(?i)', '').replace('(?m)', '')})"


def blanked(text: Column) -> Column:
    """The text with every character of its formulas a space."""
    pieces = F.split(text, FORMULA, -1)
    formulas = F.regexp_extract_all(text, F.lit(FORMULA), 0)
    spaces = F.transform(formulas, lambda f: F.repeat(F.lit(" "), F.length(f)))
    return F.array_join(F.flatten(F.zip_with(pieces, spaces, lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")


def signals(text: Column) -> dict[str, Column]:
    """The six signals of a spoilt text; formulas here are what stands between single dollars."""
    inner = F.array_join(F.regexp_extract_all(text, F.lit(r"\$([^$]*)\$"), 1), "\n")
    plain = F.regexp_replace(text, r"\$[^$]*\$", "\x01")
    odd = F.length(F.regexp_replace(text, "[^$]", "")) % 2 == 1
    found = {
        "glued_math": plain.rlike("\\p{L}\x01|\x01[\\p{L}\\p{N}]"),
        "bare_operator": inner.rlike(BARE_COMMANDS),
        "hyphen_break": plain.rlike(r"\p{L}-[ \t]*\n[ \t]*\p{Ll}"),
        "stray_root": plain.contains("√"),
        "odd_dollars": odd,
        "bracket_across_math": odd & text.rlike(r"\(\$[^$()\n]{1,25}\)"),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


def visible(text: Column) -> Column:
    """About what a reader sees: without delimiters, commands and braces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\$+|\\[\[\]()]|\\[A-Za-z]+|[{}]", " "), r"[ \t\n\r]+", " "))


def damage_signs(old: Column, new: Column) -> dict[str, Column]:
    """The six signs that a version is worse than the one before it; null counts as empty."""
    old, new = (F.coalesce(t, F.lit("")) for t in (old, new))
    count = lambda t, p: F.regexp_count(t, F.lit(p))

    def starts_badly(t: Column) -> Column:
        head = F.ltrim(t, F.lit(" \t\n\r"))
        return ~head.rlike(LIST_START) & head.rlike(r"^[,;:.)\]}»”…!?%]|^\p{Ll}")

    before, after = visible(old), visible(new)
    bare = lambda t: F.length(F.trim(t, F.lit(" \t\n\r")))
    return {
        "bare_table_markup": count(outside(new), TABLE_MARKS) > count(outside(old), TABLE_MARKS),
        "raw_latex_noslash": count(new, BARE_COMMANDS) > count(old, BARE_COMMANDS),
        "shrunk_15": (before != "") & (F.length(after) < F.length(before) * SHRUNK),
        "bad_start": starts_badly(new) & ~starts_badly(old),
        "collapsed_to_stub": (bare(new) < COLLAPSED) & (bare(old) >= PARAGRAPH),
        "lost_list_header": old.rlike(LIST_HEAD) & ~new.rlike(LIST_HEAD),
    }


def missing_figures(items: DataFrame, files: DataFrame) -> DataFrame:
    """(id, method, place, unsolvable) of items (id, statement, solution) that speak of a figure and have no file (id).

    Method A is markup of a figure, B a mention in words; an item counts by A where it has both. An item can't be solved when the
    markup is anywhere, or the mention in the statement; a mention in the solution alone is no loss."""
    without = items.join(files.select("id").distinct(), "id", "left_anti")
    has = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    a_in, b_in = ({c: has(c, p) for c in ("statement", "solution")} for p in (FIGURE_MARKS, FIGURE_WORDS))
    a, b = (x["statement"] | x["solution"] for x in (a_in, b_in))
    place = F.when(a, F.when(a_in["statement"], "statement").otherwise("solution")).otherwise(F.when(b_in["statement"], "statement").otherwise("solution"))
    found = without.where(a | b)
    return found.select("id", F.when(a, "A").otherwise("B").alias("method"), place.alias("place"), (a | b_in["statement"]).alias("unsolvable"))
