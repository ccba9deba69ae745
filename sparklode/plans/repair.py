"""Damaged texts: broken lines, classes of defects, signs of damage, missing figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.operators import defects as D
from sparklode.operators import gluing
from sparklode.plans.registry import Registry
from sparklode.sources import load

register = Registry()

#: Every twelfth space of a line becomes a line break, as a narrow page would have it.
WRAP = r"((?:[^ \n]+ ){11}[^ \n]+) "


def _glue_sql(rounds: int) -> str:
    """Rounds of judging and joining as chained tables; more rounds than any text needs change nothing."""
    blanks = "' ' || chr(9) || chr(13) || chr(12) || chr(11) || chr(160)"
    closers = f"{blanks} || '{gluing.CLOSERS.replace(chr(39), chr(39) * 2)}'"
    steps = [
        f"w as (select doc_id as id, text, regexp_replace(text, '{WRAP}', '\\1' || chr(10), 'g') as wrapped from documents)",
        "l0 as (select id, unnest(string_split(wrapped, chr(10))) as line, unnest(range(0, len(string_split(wrapped, chr(10))))) as k, 0 as glued from w)",
    ]
    for n in range(rounds):
        steps.append(f"""
m{n} as (select *, lead(line) over t as next, sum(length(regexp_replace(line, '{gluing.SIGNS}', '', 'g'))) over (partition by id order by k rows unbounded preceding) % 2 = 1 as inside
  from l{n} window t as (partition by id order by k)),
p{n} as (select *, rtrim(line, {blanks}) as above, ltrim(next, {blanks}) as below, trim(line, {blanks}) as upper, trim(next, {blanks}) as lower, rtrim(line, {closers}) as tail from m{n}),
v{n} as (select id, k, line, glued, case when next is not null then {gluing.sql_verdict()} end as verdict from p{n}),
g{n} as (select *, coalesce(starts_with(verdict, 'glue'), false) as glue, coalesce(starts_with(lag(verdict) over (partition by id order by k), 'glue'), false) as led from v{n}),
r{n} as (select *, sum(case when led then 0 else 1 end) over (partition by id order by k rows unbounded preceding) as run,
  case when led and glue then trim(line, {blanks}) when led then ltrim(line, {blanks}) when glue then rtrim(line, {blanks}) else line end as piece from g{n}),
l{n + 1} as (select id, min(k) as k, string_agg(piece, ' ' order by k) as line, sum(glued) + count(*) - 1 as glued from r{n} group by id, run)""")
    return f"""
with {", ".join(steps)},
d as (select id, count(*) filter (where verdict = 'keep:hyphen_doubt') as doubtful from v0 group by id),
o as (select id, string_agg(line, chr(10) order by k) as text, sum(glued)::bigint as glued, bool_or(glued > 0 and length(line) > 4000) as giant from l{rounds} group by id),
h as (select w.id, o.text, w.wrapped, o.glued, case when o.glued > 400 then 'too_many_glues' when giant then 'giant_paragraph' end as held from w join o using (id))
select id, sha1(case when held is null then text else wrapped end) as digest, glued, doubtful, held from h join d using (id)
"""


@register(_glue_sql(4))
def glued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document wrapped as by a narrow page, and its lines joined again."""
    texts = load(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), F.regexp_replace("text", WRAP, "$1\n").alias("text"))
    done = gluing.glue_lines(texts, 400, 4000)
    return done.select("id", F.sha1("text").alias("digest"), "glued", "doubtful", "held")


#: What is put into the texts, by doc_id, so that every class of defects occurs; each stands at the text's end.
INJECTED = [
    "", "\\footnote{x} here", "\n  % a comment", "one & two", "p{3cm} wide", "about 5\\% more", "one -- two", "\\label{eq} there", "\\textcolor{red}{x}",
    "a) first thing b) second", "Answer: 5", "словосочетаниеenglishword", "see figure 1", "а) слово d) word", "$a & b$ only", "https://x.org/a--b", "\\includegraphics{x}",
    "<<quoted>>", "\\textbf{x} and", "thanks in advance", "t.me/somewhere", "costs $5", "($L) of", "x$y$z", "$cdot x$", "√x", "bro-\nken", "\nOptions: a", "ending with,",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


INJECTED_SQL = f"([{', '.join(_quoted(x) for x in INJECTED)}])[doc_id % {len(INJECTED)} + 1]"
ITEMS = f"""
base as (select doc_id, text, {INJECTED_SQL} as inj, string_split(text, chr(10))[1] as head from documents),
items as (select doc_id, case doc_id % 9 when 0 then '[12] ' || head when 1 then '2021) ' || head when 2 then left(head, 9) when 3 then repeat(head || ' ', 9) else head end as title,
  case when doc_id % 17 = 0 then left(text, 30) else text || ' ' || inj end as statement, case when doc_id % 5 = 0 then inj || ' in the figure' else '' end as solution, case when doc_id % 7 = 0 then inj else '' end as answer,
  case when doc_id % 11 = 0 then inj else '' end as parts, doc_id % 4 = 0 as is_test, doc_id % 3 as n_parts, case when doc_id % 13 = 0 then 'б) a)' else '' end as labels, doc_id % 2 as n_files from base)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    inj = F.element_at(F.array(*map(F.lit, INJECTED)), (F.col("doc_id") % len(INJECTED) + 1).cast("int"))
    head, k = F.element_at(F.split("text", "\n", -1), 1), F.col("doc_id")
    title = F.when(k % 9 == 0, F.concat(F.lit("[12] "), head)).when(k % 9 == 1, F.concat(F.lit("2021) "), head)).when(k % 9 == 2, F.substring(head, 1, 9)).when(k % 9 == 3, F.repeat(F.concat(head, F.lit(" ")), 9)).otherwise(head)
    some = lambda n, value: F.when(k % n == 0, value).otherwise("")
    return load(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        title.alias("title"),
        F.when(k % 17 == 0, F.substring("text", 1, 30)).otherwise(F.concat("text", F.lit(" "), inj)).alias("statement"),
        some(5, F.concat(inj, F.lit(" in the figure"))).alias("solution"),
        some(7, inj).alias("answer"),
        some(11, inj).alias("parts"),
        (k % 4 == 0).alias("is_test"),
        (k % 3).alias("n_parts"),
        some(13, F.lit("б) a)")).alias("labels"),
        (k % 2).alias("n_files"),
    )


def _class_sql() -> str:
    out = lambda of: f"regexp_replace({of}, {_quoted(D.FORMULA)}, ' ', 'g')"
    snip = D.sql_snippet
    has = lambda of, p: f"regexp_matches({of}, {_quoted(p)})"
    cases = {}
    for name, (field, plain, pattern) in D.PATTERNS.items():
        of = out(f"f_{field}") if plain else ("trim(title)" if field == "title" else f"f_{field}")
        cases[name] = f"case when {has(of, pattern)} then {snip(of, pattern)} end"
    pool = "(statement || chr(10) || labels)"
    bare = "trim(statement, ' ' || chr(9) || chr(10) || chr(13))"
    cases |= {
        "B1": f"case when length(trim(title)) between 1 and {D.SHORT_TITLE - 1} then trim(title) end",
        "B2": f"case when length(trim(title)) > {D.LONG_TITLE} then left(trim(title), {D.LONG_TITLE}) end",
        "B3": f"case when length(statement) > {D.LONG_STATEMENT} and not {has('statement', D.TASK_WORDS)} and not is_test then right(statement, 40) end",
        "B4": "case when is_test and n_parts = 0 then left(statement, 100) end",
        "B6": f"case when {has(pool, D.CYRILLIC_LABEL)} and {has(pool, D.LATIN_LABEL)} then {snip(pool, D.CYRILLIC_LABEL)} || ' + ' || {snip(pool, D.LATIN_LABEL)} end",
        "C1": f"case when {has('statement', D.FIGURE_WORDS)} and n_files = 0 then {snip('statement', D.FIGURE_WORDS)} end",
        "C2": f"case when length({bare}) between 1 and {D.STUB - 1} then {bare} end",
    }
    texts = "statement || chr(10) || solution || chr(10) || answer || chr(10) || parts"
    listed = ", ".join(f"struct_pack(k := '{k}', v := {v})" for k, v in sorted(cases.items()))
    return f"""
with {ITEMS}, f as (select *, {texts} as f_all, regexp_replace({texts}, {_quoted(D.LINK)}, ' ', 'g') as f_plain, title as f_title, statement as f_statement, statement || chr(10) || solution as f_worked from items),
c as (select doc_id, list_filter([{listed}], lambda e: e.v is not null) as found from f)
select doc_id, array_to_string(list_transform(found, lambda e: e.k), ',') as classes, sha1(array_to_string(list_transform(found, lambda e: e.k || '=' || e.v), chr(10))) as snippets from c
"""


@register(_class_sql())
def defect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of defects of every document as an item, of twenty, and a digest of what was found."""
    items = _items(spark, sf_dir)
    names = ("title", "statement", "solution", "answer", "parts", "is_test", "n_parts", "labels", "n_files")
    found = F.map_entries(D.defect_classes({n: F.col(n) for n in names}))
    told = items.select("doc_id", found.alias("found"))
    pairs = F.transform("found", lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return told.select("doc_id", F.array_join(F.transform("found", lambda e: e["key"]), ",").alias("classes"), F.sha1(F.array_join(pairs, "\n")).alias("snippets"))


def _marker_sql() -> str:
    spaces = f"list_transform(regexp_extract_all(text, {_quoted(D.FORMULA)}, 0), lambda f: repeat(' ', length(f)))"
    blank = f"list_reduce(list_transform(list_zip(string_split_regex(text, {_quoted(D.FORMULA)}), {spaces}), lambda z: z[1] || coalesce(z[2], '')), lambda a, b: a || b)"
    cases = []
    for name, (plain, pattern) in D.MARKERS.items():
        of = "blank" if plain else "text"
        start, size = (f"length(regexp_extract({of}, {_quoted(D.first_match(pattern))}, {k}))" for k in (1, 2))
        cases.append(f"case when regexp_matches({of}, {_quoted(pattern)}) then '{name}:' || {start} || '-' || ({start} + {size}) end")
    single = "replace(text, '$$', '  ')"
    cases.append(f"case when length(regexp_replace({single}, '[^$]', '', 'g')) % 2 = 1 then 'unpaired_dollars:' || (instr({single}, '$') - 1) || '-' || instr({single}, '$') end")
    return f"""
with {ITEMS}, t as (select doc_id, statement as text from items), b as (select *, {blank} as blank from t)
select doc_id, array_to_string(list_sort(list_filter([{", ".join(cases)}], lambda x: x is not null)), ',') as markers from b
"""


@register(_marker_sql())
def statement_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight markers of every statement, each with the place where it stands first."""
    found = _items(spark, sf_dir).select("doc_id", D.markers(F.col("statement")).alias("m"))
    told = F.transform("m", lambda m: F.concat(m["marker"], F.lit(":"), m["start"].cast("string"), F.lit("-"), m["end"].cast("string")))
    return found.select("doc_id", F.array_join(F.array_sort(told), ",").alias("markers"))


def _signal_sql() -> str:
    plain, inner = "regexp_replace(s, '\\$[^$]*\\$', chr(1), 'g')", "array_to_string(regexp_extract_all(s, '\\$([^$]*)\\$', 1), chr(10))"
    odd = "length(regexp_replace(s, '[^$]', '', 'g')) % 2 = 1"
    return f"""
with {ITEMS}, t as (select doc_id, statement as s from items), p as (select *, {plain} as plain, {inner} as inner_ from t)
select doc_id, regexp_matches(plain, '\\p{{L}}\\x01|\\x01[\\p{{L}}\\p{{N}}]') as glued_math, regexp_matches(inner_, {_quoted(D.BARE_COMMANDS)}) as bare_operator,
 regexp_matches(plain, '\\p{{L}}-[ \\t]*\\n[ \\t]*\\p{{Ll}}') as hyphen_break, contains(plain, '√') as stray_root, {odd} as odd_dollars, {odd} and regexp_matches(s, '\\(\\$[^$()\\n]{{1,25}}\\)') as bracket_across_math from p
"""


@register(_signal_sql())
def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six signals of every statement."""
    return _items(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in D.signals(F.col("statement")).items()])


def _damage_sql() -> str:
    out = lambda c: f"regexp_replace({c}, {_quoted(D.FORMULA)}, ' ', 'g')"
    count = lambda of, p: f"len(regexp_extract_all({of}, {_quoted(p)}, 0))"
    seen = lambda c: f"trim(regexp_replace(regexp_replace({c}, '\\$+|\\\\[\\[\\]()]|\\\\[A-Za-z]+|[{{}}]', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
    blanks = "' ' || chr(9) || chr(10) || chr(13)"
    bad = lambda c: f"(not regexp_matches(ltrim({c}, {blanks}), {_quoted(D.LIST_START)}) and regexp_matches(ltrim({c}, {blanks}), '^[,;:.)\\]}}»”…!?%]|^\\p{{Ll}}'))"
    return f"""
with {ITEMS}, e as (select doc_id, statement as o, case doc_id % 7 when 0 then left(statement, 40) when 1 then ', ' || statement when 2 then replace(statement, 'Options:', '') when 3 then statement || ' x & y \\hline' when 4 then statement || ' frac 12' when 5 then lower(left(statement, length(statement) // 2)) else statement end as n from items)
select doc_id, {count(out("n"), D.TABLE_MARKS)} > {count(out("o"), D.TABLE_MARKS)} as bare_table_markup, {count("n", D.BARE_COMMANDS)} > {count("o", D.BARE_COMMANDS)} as raw_latex_noslash,
 {seen("o")} <> '' and length({seen("n")}) < length({seen("o")}) * {D.SHRUNK} as shrunk_15, {bad("n")} and not {bad("o")} as bad_start,
 length(trim(n, {blanks})) < {D.COLLAPSED} and length(trim(o, {blanks})) >= {D.PARAGRAPH} as collapsed_to_stub, regexp_matches(o, {_quoted(D.LIST_HEAD)}) and not regexp_matches(n, {_quoted(D.LIST_HEAD)}) as lost_list_header from e
"""


@register(_damage_sql())
def damage_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six signs of damage in seven kinds of edits."""
    k, old = F.col("doc_id") % 7, F.col("statement")
    new = (
        F.when(k == 0, F.substring(old, 1, 40)).when(k == 1, F.concat(F.lit(", "), old)).when(k == 2, F.replace(old, F.lit("Options:"), F.lit(""))).when(k == 3, F.concat(old, F.lit(" x & y \\hline")))
        .when(k == 4, F.concat(old, F.lit(" frac 12"))).when(k == 5, F.lower(F.left(old, F.floor(F.length(old) / 2).cast("int")))).otherwise(old)
    )
    return _items(spark, sf_dir).select("doc_id", *[v.alias(n) for n, v in D.damage_signs(old, new).items()])


@register(f"""
with {ITEMS}, w as (select doc_id as id, regexp_matches(statement, {_quoted(D.FIGURE_MARKS)}) as sa, regexp_matches(solution, {_quoted(D.FIGURE_MARKS)}) as la, regexp_matches(statement, {_quoted(D.FIGURE_WORDS)}) as sb, regexp_matches(solution, {_quoted(D.FIGURE_WORDS)}) as lb
  from items where doc_id not in (select doc_id from labels where toxic = 1))
select id, case when sa or la then 'A' else 'B' end as method, case when sa then 'statement' when la then 'solution' when sb then 'statement' else 'solution' end as place, sa or la or sb as unsolvable from w where sa or la or sb or lb
""")
def missing_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that speak of a figure and have none; files are what the labels call toxic, for want of any."""
    files = load(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return D.missing_figures(_items(spark, sf_dir).withColumnRenamed("doc_id", "id"), files)
