"""Numbers in names, faults of formulas, and option lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Environments that may stand in a formula, and words that begin a task rather than an option; the names of
# the reasons in tail_options are fixed too.
ENVIRONMENTS = "align aligned array cases matrix pmatrix gathered".split()
COMMANDS = (
    "begin end frac dfrac tfrac sqrt cdot times div pm mp le leq ge geq ne neq approx equiv sum prod int lim infty log ln exp sin cos tan max min left right text mathrm mathbf overline "
    "underline hat bar alpha beta gamma delta epsilon lambda mu pi sigma theta varepsilon Delta Pi Sigma Omega partial nabla to rightarrow Rightarrow quad qquad ldots dots cdots binom in cup cap subset"
).split()
TASK_WORDS = "find draw compute determine prove explain".split()
OPTION = r"^\s*([0-9]{1,2}|[A-Za-z])[.)]\s+(\S.*?)\s*$"


def number_in_name(name: Column) -> Column:
    """The number that names something; null without one.

    The name is split into words at white space and marks. A number word after the number sign wins; else it is the first word
    of one to four digits that the words after it do not make an age or anniversary. Decimals and joined words are none.
    """
    words = F.split(F.replace(name, F.lit("№"), F.lit(" № ")), r"[\s,;:()«»\"]+")
    next_word = lambda k, ahead: F.coalesce(F.get(words, k + ahead), F.lit(""))
    years = lambda word: word.startswith("лет")

    def names(word: Column, k: Column) -> Column:
        aged = years(next_word(k, 1)) | ((next_word(k, 1) == "й") & years(next_word(k, 2)))
        return F.when((F.length(word) <= 4) & word.rlike("^[0-9]+$") & ~aged, word)

    signed = F.filter(words, lambda word, k: (F.get(words, k - 1) == "№") & word.rlike("^[0-9]+$"))
    bare = F.filter(F.transform(words, names), lambda word: word.isNotNull())
    return F.coalesce(F.get(signed, F.lit(0)), F.get(bare, F.lit(0))).try_cast("int")


def formula_faults(body: Column) -> dict[str, Column]:
    """braces: one closes before it opens or stays open; environment: one of unknown name; unclosed: begins and ends differ in number;
    command: one of unknown name."""
    marks = F.regexp_extract_all(F.regexp_replace(body, r"\\[{}]", ""), F.lit("[{}]"), 0)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def step(s: Column, mark: Column) -> Column:
        depth = s["depth"] + F.when(mark == "{", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.least(s["low"], depth).alias("low"))

    names = F.regexp_extract_all(body, F.lit(r"\\begin\{([^}]*)\}"), 1)
    return {
        "braces": F.aggregate(marks, zero, step, lambda s: (s["depth"] != 0) | (s["low"] < 0)),
        "environment": F.exists(names, lambda n: ~n.isin(ENVIRONMENTS)),
        "command": F.exists(F.regexp_extract_all(body, F.lit(r"\\([A-Za-z]+)"), 1), lambda n: ~n.isin(COMMANDS)),
        "unclosed": F.size(names) != F.size(F.regexp_extract_all(body, F.lit(r"\\end\{"), 0)),
    }


def tail_options(statement: Column) -> Column:
    """(reason, options, stem): the lines `1. x` or `a) x` that end a text, of one style and counted without gaps; blank lines between are skipped.

    reason is `parsed`, or why there are no options: no_block (fewer than two such lines), mixed_style,
    verb_like_subquestion (a numbered line begins with a task word) or empty_stem. A null is an empty text.
    """
    lines = F.split(F.coalesce(statement, F.lit("")), "\n")
    option = lambda line: line.rlike(OPTION)
    # The place of the last line that is neither blank nor an option; all after it is the tail.
    last = F.aggregate(F.transform(lines, lambda line, k: F.when(option(line) | line.rlike(r"^\s*$"), -1).otherwise(k)), F.lit(-1), lambda a, b: F.greatest(a, b))
    parts = F.struct(lines.alias("lines"), (last + 1).alias("cut"))

    def read(p: Column) -> Column:
        block = F.filter(F.slice(p["lines"], p["cut"] + 1, F.greatest(F.size(p["lines"]), F.lit(1))), option)
        keys = F.transform(block, lambda line: F.lower(F.regexp_extract(line, OPTION, 1)))
        texts = F.transform(block, lambda line: F.regexp_extract(line, OPTION, 2))
        return F.struct(keys.alias("keys"), texts.alias("texts"), F.regexp_replace(F.array_join(F.slice(p["lines"], 1, p["cut"]), "\n"), r"\s+$", "").alias("stem"))

    def judge(b: Column) -> Column:
        size = F.size(b["keys"])
        numbered = b["keys"] == F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda k: k.cast("string"))
        lettered = b["keys"] == F.transform(F.sequence(F.lit(97), F.lit(96) + F.greatest(size, F.lit(1))), lambda k: F.char(k))
        task = F.exists(b["texts"], lambda t: F.lower(t).rlike("^(" + "|".join(TASK_WORDS) + ")"))
        reason = F.when(size < 2, "no_block").when(~numbered & ~lettered, "mixed_style").when(numbered & task, "verb_like_subquestion").when(b["stem"] == "", "empty_stem").otherwise("parsed")
        good = reason == "parsed"
        none = F.array().cast("array<string>")
        return F.struct(reason.alias("reason"), F.when(good, b["texts"]).otherwise(none).alias("options"), F.when(good, b["stem"]).alias("stem"))

    # One-element arrays hold each step's result, so that a lambda sees a value and not an expression to run again.
    return F.transform(F.transform(F.array(parts), read), judge)[0]
