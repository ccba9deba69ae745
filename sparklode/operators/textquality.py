"""Rule-based detectors of damaged texts, line statistics and corpus diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.functions import text as T
from sparklode.sources.scratch import Scratch

#: Detector name -> rule over a text column; each is a plain boolean expression, so all run in one pass.
FLAGS = {
    "newline": lambda t: t.contains("\n"),
    "bullet": lambda t: t.rlike(r"(^|\n)[*-] "),
    "numeric_list": lambda t: t.rlike(r"(^|\n)[0-9]+[.)] "),
    "latex_junk": lambda t: t.rlike(r"\\(begin|end|item|hline)"),
    "unpaired_dollar": lambda t: F.length(F.regexp_replace(t, "[^$]", "")) % 2 == 1,
    "truncated": lambda t: ~F.rtrim(t).rlike(r"[.!?:;)\"]$"),
    "too_long": lambda t: F.length(t) > 3000,
    "spam_link": lambda t: t.rlike(r"https?://"),
}

DEFECTS = {
    "bare_operator": lambda t: t.rlike(r"(^|\n)[=+*/] "),
    "hyphen_break": lambda t: t.rlike(r"[a-z]-\n[a-z]"),
    "odd_dollars": FLAGS["unpaired_dollar"],
    "doubled_mark": lambda t: t.rlike(r"[!?]{2}"),
    "table_marks": lambda t: t.rlike(r" \| "),
    "symbol_noise": lambda t: t.rlike(r"[%&*#$]{3}"),
}


def flags(text: Column, rules: dict = FLAGS) -> list[Column]:
    return [F.coalesce(rule(text), F.lit(False)).alias(name) for name, rule in rules.items()]


def flag_names(text: Column, rules: dict = DEFECTS) -> Column:
    """The names of the rules that fire, sorted, as an array."""
    return F.array_sort(F.array_compact(F.array(*[F.when(rule(text), F.lit(name)) for name, rule in rules.items()])))


def line_stats(df: DataFrame, text: str, by: str) -> DataFrame:
    """Per group: lines, characters, longest line, lines that end badly, list lines and empty lines."""
    lines = df.select(by, F.explode(F.split(F.col(text), "\n", -1)).alias("line"))
    bad = (F.trim("line") != "") & ~F.rtrim(F.col("line")).rlike(r"[.!?:;]$")
    return lines.groupBy(by).agg(
        F.count("*").alias("lines"),
        F.sum(F.length("line")).alias("chars"),
        F.max(F.length("line")).alias("longest"),
        F.count_if(bad).alias("bad_ends"),
        F.count_if(F.col("line").rlike(r"^([*-]|[0-9]+[.)]) ")).alias("list_lines"),
        F.count_if(F.trim("line") == "").alias("empty_lines"),
    )


def title_bucket(title: Column, statement: Column, limit: int = 60) -> Column:
    """The first that holds: unusable, equal to the statement, a truncation of it, a technical number, or kept."""
    stem = F.regexp_replace(title, r"^[0-9. ]+", "")
    cut = title.rlike("[-–—]$") | ((F.length(title) >= limit) & F.startswith(F.regexp_replace(statement, r"^[0-9. ]+", ""), stem))
    return (
        F.when(F.length(F.trim(title)) < 5, "unusable")
        .when(title == statement, "equal")
        .when(cut, "truncated")
        .when(title.rlike(r"^[0-9 ./-]+$"), "technical")
        .otherwise("keep")
    )


def damage(old: Column, new: Column) -> dict[str, Column]:
    """Signs that an edit spoiled a text."""
    return {
        "shrunk": F.length(new) < 0.85 * F.length(old),
        "bad_start": new.rlike(r"^[,.;:)]"),
        "stub": (F.length(new) < 20) & (F.length(old) > 100),
        "lost_lines": F.size(F.split(new, "\n", -1)) < F.size(F.split(old, "\n", -1)),
        "numbers_changed": T.numbers(old) != T.numbers(new),
    }


def quality_score(text: Column, quality: Column, toxic: Column) -> Column:
    """Additive score of weighted signs, four decimals."""
    one = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return F.round(
        one(quality == 1, 0.4) + one(toxic == 0, 0.2) + one(F.length(text) >= 200, 0.15) + one(~FLAGS["truncated"](text), 0.15) + one(~FLAGS["spam_link"](text), 0.1), 4
    )


# The nine components of a text's quality, their weights, and what each asks.
COMPONENTS: dict[str, tuple[float, str | None]] = {
    "reviewed": (0.2, None),
    "harmless": (0.15, None),
    "long_enough": (0.15, None),
    "ends_well": (0.1, r"[.!?:;)\"][ \t\n\r]*$"),
    "no_link": (0.1, r"https?://"),
    "even_dollars": (0.1, None),
    "no_noise": (0.1, r"[%&*#$]{3}"),
    "no_shouting": (0.05, r"[A-Z]{4,}[!]{2}"),
    "no_table": (0.05, r" \| "),
}


def quality_components(text: Column, quality: Column, toxic: Column) -> dict[str, Column]:
    """The points of each component; what can't be told gives none."""
    holds = {
        "reviewed": quality == 1,
        "harmless": toxic == 0,
        "long_enough": F.length(text) >= 200,
        "ends_well": text.rlike(COMPONENTS["ends_well"][1]),
        "even_dollars": F.length(F.regexp_replace(text, "[^$]", "")) % 2 == 0,
    } | {name: ~text.rlike(pattern) for name, (_, pattern) in COMPONENTS.items() if name.startswith("no_")}
    return {name: F.when(F.coalesce(holds[name], F.lit(False)), weight).otherwise(0.0) for name, (weight, _) in COMPONENTS.items()}


def component_sql() -> dict[str, tuple[float, str]]:
    """The weight and the SQL condition of each component, over text, quality and toxic."""
    plain = {"reviewed": "quality = 1", "harmless": "toxic = 0", "long_enough": "length(text) >= 200", "even_dollars": "length(regexp_replace(text, '[^$]', '', 'g')) % 2 = 0"}
    return {k: (w, plain.get(k) or ("not " if k.startswith("no_") else "") + f"regexp_matches(text, '{p}')") for k, (w, p) in COMPONENTS.items()}


def component_sum(parts: Column) -> Column:
    return F.round(F.aggregate(F.map_values(parts), F.lit(0.0), lambda s, x: s + x), 4)


def explained(mine: Column, theirs: Column, names: list[str]) -> Column:
    """The components in which two rows differ, each with + where the first has more, else -."""
    differ = [F.when(mine[n] > theirs[n], f"{n}+").when(mine[n] < theirs[n], f"{n}-") for n in names]
    return F.array_join(F.array_compact(F.array(*differ)), ",")


def document_frequency(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """In how many documents each term occurs; a document's terms are made distinct before they are shuffled."""
    terms = df.select(F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def ngrams(words: Column, n: int) -> Column:
    """Word n-grams joined by spaces; none in texts of fewer words. `words` should be a column: an expression would be worked out for every gram."""
    last = F.size(words) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    )


def exploded_grams(df: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """(id, gram): the different n-grams of each text. The explosion is an outer one, for from an inner one the optimiser infers
    a filter on the array, and would make tokens and grams once more below."""
    words = df.select(id_col, T.tokens(F.col(text)).alias("words"))
    return words.select(id_col, F.explode_outer(F.array_distinct(ngrams(F.col("words"), n))).alias("gram"))


def contaminated(df: DataFrame, id_col: str, text: str, benchmark: DataFrame, item_id: str, item_text: str, n: int = 8) -> DataFrame:
    """(id, item, shared): documents that share word n-grams with a benchmark item.

    The benchmark's grams are written first: then the planner knows their size, and if they are small enough broadcasts
    them, so that only grams in common are shuffled; if not, both sides are shuffled by gram.
    """
    right = Scratch(df.sparkSession, "grams").keep(exploded_grams(benchmark, item_id, item_text, n), "benchmark")
    shared = exploded_grams(df, id_col, text, n).join(right, "gram")
    return shared.groupBy(id_col, item_id).agg(F.count("*").alias("shared"))


def html_text(html: Column) -> Column:
    """The visible text: comments, scripts and styles go, other tags become spaces, five entities are decoded."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    flat = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        flat = F.replace(flat, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(flat, r"[ \t\n\r\f\x0b]+", " "))
