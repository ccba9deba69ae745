"""Text functions, detectors and corpus diagnostics over documents, pages, conversations and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.functions import text as T
from sparklode.operators import relational, textquality
from sparklode.plans.registry import Registry
from sparklode.sources import load

register = Registry()

WS = r"[ \t\n\r\f\v]+"
COLLAPSED = f"trim(regexp_replace(lower(text), '{WS}', ' ', 'g'))"
TOKENS = f"regexp_extract_all(lower(text), '{T.WORD}', 0)"


def numbers_sql(text: str) -> str:
    point = f"regexp_replace(translate(n, ',', '.'), '^(-?)0+([0-9])', '\\1\\2')"
    short = f"case when contains({point}, '.') then regexp_replace(regexp_replace({point}, '0+$', ''), '\\.$', '') else {point} end"
    return f"list_transform(regexp_extract_all({text}, '{T.NUMBER}', 0), lambda n: case when {short} in ('-0', '') then '0' else {short} end)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")


@register(f"select doc_id, sha1({COLLAPSED}) as fingerprint, length({COLLAPSED}) as n from documents")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = T.collapse(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.sha1(flat).alias("fingerprint"), F.length(flat).alias("n"))


@register(f"select doc_id, len({TOKENS}) as tokens, len(list_distinct({TOKENS})) as distinct_tokens from documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(words).alias("tokens"), F.size(F.array_distinct(words)).alias("distinct_tokens"))


@register(f"select term, count(*) as df from (select unnest(list_distinct({TOKENS})) as term from documents) group by term")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textquality.document_frequency(docs(spark, sf_dir), "doc_id", "text")


@register(f"select doc_id, array_to_string({numbers_sql('text')}, ' ') as numbers, len(list_distinct({numbers_sql('text')})) as kinds from documents")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.numbers(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.array_join(found, " ").alias("numbers"), F.size(F.array_distinct(found)).alias("kinds"))


def tri_sql(t: str) -> str:
    return f"list_distinct(case when length({t}) < 3 then [{t}] else list_transform(range(1, length({t}) - 1), lambda i: substr({t}, i, 3)) end)"


@register(f"""
with p as (select a.doc_id, a.text as x, b.text as y from documents a join documents b on b.doc_id = a.doc_id + 1),
t as (select *, {tri_sql("x")} as tx, {tri_sql("y")} as ty, {numbers_sql("x")} as nx, {numbers_sql("y")} as ny from p)
select doc_id, round(len(list_intersect(tx, ty)) / (len(tx) + len(ty) - len(list_intersect(tx, ty)))::double, 9) as jaccard, list_sort(nx) = list_sort(ny) as same_numbers, string_split(x, chr(10))[1] = string_split(y, chr(10))[1] as same_head, string_split(x, chr(10))[1] = string_split(y, chr(10))[1] and x <> y as header_clash,
 case when len(list_distinct(nx)) = 0 and len(list_distinct(ny)) = 0 then 'none' when len(list_intersect(list_distinct(nx), list_distinct(ny))) = len(list_distinct(nx)) and len(list_distinct(nx)) = len(list_distinct(ny)) then 'equal'
  when len(list_intersect(list_distinct(nx), list_distinct(ny))) = 0 then 'disjoint' when len(list_intersect(list_distinct(nx), list_distinct(ny))) in (len(list_distinct(nx)), len(list_distinct(ny))) then 'subset' else 'overlap' end as verdict
from t
""")
def neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram overlap and number agreement of each document with the next one, and whether they share their first line but not their text."""
    rows = docs(spark, sf_dir).select("doc_id", F.col("text").alias("x"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    same_head = F.get(F.split("x", "\n", -1), F.lit(0)) == F.get(F.split("y", "\n", -1), F.lit(0))
    pairs = rows.join(after, "doc_id").withColumns({"nx": T.numbers(F.col("x")), "ny": T.numbers(F.col("y"))})
    return pairs.select(
        "doc_id",
        F.round(T.trigram_jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"),
        T.same_multiset(F.col("nx"), F.col("ny")).alias("same_numbers"),
        same_head.alias("same_head"),
        (same_head & (F.col("x") != F.col("y"))).alias("header_clash"),
        T.number_verdict(F.col("nx"), F.col("ny")).alias("verdict"),
    )


@register(r"""
select doc_id, contains(text, chr(10)) as newline, regexp_matches(text, '(^|\n)[*-] ') as bullet, regexp_matches(text, '(^|\n)[0-9]+[.)] ') as numeric_list,
 regexp_matches(text, '\\(begin|end|item|hline)') as latex_junk, length(regexp_replace(text, '[^$]', '', 'g')) % 2 = 1 as unpaired_dollar,
 not regexp_matches(rtrim(text), '[.!?:;)"]$') as truncated, length(text) > 3000 as too_long, regexp_matches(text, 'https?://') as spam_link from documents
""")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", *textquality.flags(F.col("text")))


@register(r"""
select doc_id, array_to_string(list_sort(list_filter([case when regexp_matches(text, '(^|\n)[=+*/] ') then 'bare_operator' end, case when regexp_matches(text, '[a-z]-\n[a-z]') then 'hyphen_break' end,
 case when length(regexp_replace(text, '[^$]', '', 'g')) % 2 = 1 then 'odd_dollars' end, case when regexp_matches(text, '[!?]{2}') then 'doubled_mark' end,
 case when regexp_matches(text, ' \| ') then 'table_marks' end, case when regexp_matches(text, '[%&*#$]{3}') then 'symbol_noise' end], lambda x: x is not null)), ',') as defects from documents
""")
def defect_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.array_join(textquality.flag_names(F.col("text")), ",").alias("defects"))


@register(r"""
with l as (select source, unnest(string_split(text, chr(10))) as line from documents)
select source, count(*) as lines, sum(length(line))::bigint as chars, max(length(line)) as longest, count(*) filter (where trim(line) <> '' and not regexp_matches(rtrim(line), '[.!?:;]$')) as bad_ends,
 count(*) filter (where regexp_matches(line, '^([*-]|[0-9]+[.)]) ')) as list_lines, count(*) filter (where trim(line) = '') as empty_lines from l group by source
""")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textquality.line_stats(docs(spark, sf_dir), "text", "source")


TITLE = "left(string_split(text, chr(10))[1], 60)"


@register(rf"""
with t as (select doc_id, {TITLE} as title, text as statement from documents)
select doc_id, case when length(trim(title)) < 5 then 'unusable' when title = statement then 'equal'
 when regexp_matches(title, '[-–—]$') or (length(title) >= 60 and starts_with(regexp_replace(statement, '^[0-9. ]+', ''), regexp_replace(title, '^[0-9. ]+', ''))) then 'truncated'
 when regexp_matches(title, '^[0-9 ./-]+$') then 'technical' else 'keep' end as bucket from t
""")
def title_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with titles taken from the first line."""
    title = F.substring(F.element_at(F.split("text", "\n", -1), 1), 1, 60)
    return docs(spark, sf_dir).select("doc_id", textquality.title_bucket(title, F.col("text")).alias("bucket"))


@register(rf"""
with e as (select doc_id, text as old, case doc_id % 5 when 0 then left(text, 15) when 1 then ', ' || text when 2 then replace(text, chr(10), ' ') when 3 then replace(text, '1', '7') else text end as new from documents)
select doc_id, length(new) < 0.85 * length(old) as shrunk, regexp_matches(new, '^[,.;:)]') as bad_start, length(new) < 20 and length(old) > 100 as stub,
 len(string_split(new, chr(10))) < len(string_split(old, chr(10))) as lost_lines, {numbers_sql("old")} <> {numbers_sql("new")} as numbers_changed from e
""")
def revert_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of damage in five kinds of edits."""
    k, old = F.col("doc_id") % 5, F.col("text")
    new = F.when(k == 0, F.substring(old, 1, 15)).when(k == 1, F.concat(F.lit(", "), old)).when(k == 2, F.replace(old, F.lit("\n"), F.lit(" "))).when(k == 3, F.replace(old, F.lit("1"), F.lit("7"))).otherwise(old)
    return docs(spark, sf_dir).withColumn("new", new).select("doc_id", *[c.alias(n) for n, c in textquality.damage(F.col("text"), F.col("new")).items()])


@register("""
select lang, count(*) as n, round(avg(length(text)), 6) as mean_length, round(median(length(text)), 6) as median_length, max(length(text)) as longest,
 round(avg(case when length(text) > 2000 then 1.0 else 0.0 end), 9) as over_budget, round(sum(greatest(length(text) - 2000, 0)) / sum(length(text))::double, 9) as lost from documents group by lang
""")
def median_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length statistics and what a budget of 2000 characters would lose."""
    n = F.length("text")
    return docs(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("n"),
        F.round(F.avg(n), 6).alias("mean_length"),
        F.round(F.median(n), 6).alias("median_length"),
        F.max(n).alias("longest"),
        F.round(F.avg(F.when(n > 2000, 1.0).otherwise(0.0)), 9).alias("over_budget"),
        F.round(F.sum(F.greatest(n - 2000, F.lit(0))) / F.sum(n), 9).alias("lost"),
    )


@register("""
select source, count(*) as n, round(median(length(text)), 6) as median_length, round(avg((quality = 1)::int), 9) as good_share, round(avg((toxic = 1)::int), 9) as toxic_share, count(quality) as labelled
from documents left join labels using (doc_id) group by source
""")
def source_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = docs(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(
        F.count("*").alias("n"),
        F.round(F.median(F.length("text")), 6).alias("median_length"),
        F.round(F.avg((F.col("quality") == 1).cast("int")), 9).alias("good_share"),
        F.round(F.avg((F.col("toxic") == 1).cast("int")), 9).alias("toxic_share"),
        F.count("quality").alias("labelled"),
    )


def _component_sql() -> str:
    """Each component's points, by name, as an SQL list of structures."""
    conditions = textquality.component_sql()
    return "[" + ", ".join(f"struct_pack(k := '{k}', v := case when coalesce({c}, false) then {w} else 0 end)" for k, (w, c) in conditions.items()) + "]"


@register(f"""
with c as (select doc_id, {_component_sql()} as c from documents left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) using (doc_id)),
p as (select a.doc_id, a.c as a, b.c as b from c a join c b on b.doc_id = a.doc_id + 1)
select doc_id, round(list_sum(list_transform(a, lambda x: x.v)), 4)::double as score,
  array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i].v <> b[i].v), lambda i: a[i].k || case when a[i].v > b[i].v then '+' else '-' end), ',') as explained from p
""")
def quality_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine weighted components of each document's quality, and in which of them it is better or worse than the next document."""
    marks = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    parts = textquality.quality_components(F.col("text"), F.col("quality"), F.col("toxic"))
    scored = docs(spark, sf_dir).join(marks, "doc_id", "left").select("doc_id", F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]).alias("c"))
    after = scored.select((F.col("doc_id") - 1).alias("doc_id"), F.col("c").alias("d"))
    return scored.join(after, "doc_id").select("doc_id", textquality.component_sum(F.col("c")).alias("score"), textquality.explained(F.col("c"), F.col("d"), list(parts)).alias("explained"))


@register(r"""
with f as (select doc_id, case doc_id % 3 when 0 then 'fi 2 1⁄2 ' when 1 then 'No — ' else '' end || text as seen from documents)
select doc_id, sha1(trim(regexp_replace(translate(lower(translate(seen, '‐‑‒–—−―', '-------')), 'ё', 'е'), '[^\p{L}\p{N}]+', ' ', 'g'))) as statement_form from f
""")
def comparable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form in which statements are compared, of texts that begin with compatibility characters: ligature, exponent, fraction, sign."""
    seen = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ﬁ ² ½ "), F.col("text"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("№ — "), F.col("text"))).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.sha1(T.statement_form(seen)).alias("statement_form"))


@register(r"""
with l as (select doc_id, string_split(text, chr(10)) as l from documents)
select doc_id, sha1(regexp_replace(concat_ws(' ', nullif(left(l[1], 60), ''), nullif(left(l[2], 200), ''), nullif(left(array_to_string(l[3:], ' '), 400), '')), '[0-9]+', '#', 'g')) as digest from l
""")
def budgeted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of blocks, each within its budget of characters, empty ones left out, numbers masked."""
    lines = F.split("text", "\n", -1)
    blocks = [(60, F.get(lines, F.lit(0))), (200, F.get(lines, F.lit(1))), (400, F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(1))), " "))]
    return docs(spark, sf_dir).select("doc_id", F.sha1(T.masked_numbers(T.within_budgets(blocks))).alias("digest"))


@register(r"""
select doc_id, round(case when quality = 1 then 0.4 else 0 end + case when toxic = 0 then 0.2 else 0 end + case when length(text) >= 200 then 0.15 else 0 end
 + case when regexp_matches(rtrim(text), '[.!?:;)"]$') then 0.15 else 0 end + case when not regexp_matches(text, 'https?://') then 0.1 else 0 end, 4)::double as score
from documents left join labels using (doc_id)
""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = docs(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", textquality.quality_score(F.col("text"), F.col("quality"), F.col("toxic")).alias("score"))


def gram_sql(n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))"


@register(f"""
with d as (select doc_id, unnest({gram_sql(8)}) as gram from (select doc_id, {TOKENS} as w from documents)),
b as (select item_id, unnest({gram_sql(8)}) as gram from (select item_id, {TOKENS} as w from benchmark))
select doc_id, item_id, count(*) as shared from d join b using (gram) group by all
""")
def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark."""
    return textquality.contaminated(docs(spark, sf_dir), "doc_id", "text", load(spark, sf_dir, "benchmark"), "item_id", "text")


@register(f"""
with g as (select n, unnest(case n when 1 then {gram_sql(1)} when 2 then {gram_sql(2)} when 3 then {gram_sql(3)} else {gram_sql(4)} end) as gram from (select {TOKENS} as w from benchmark), (select unnest([1, 2, 3, 4]) as n))
select n, gram, count(*) as items from g group by all
""")
def ngram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that hold each gram of one to four words."""
    words = load(spark, sf_dir, "benchmark").select(T.tokens(F.col("text")).alias("w"))
    grams = [words.select(F.lit(n).alias("n"), F.explode(F.array_distinct(textquality.ngrams(F.col("w"), n))).alias("gram")) for n in (1, 2, 3, 4)]
    all_ = grams[0].unionByName(grams[1]).unionByName(grams[2]).unionByName(grams[3])
    return all_.groupBy("n", "gram").agg(F.count("*").alias("items"))


@register(f"""
with known as (select distinct unnest({TOKENS}) as term from benchmark), t as (select unnest({TOKENS}) as term from documents), c as (select term, count(*) as n from t group by 1)
select term, n from c where term not in (select term from known) order by n desc, term limit 50
""")
def out_of_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty most frequent words that the benchmark's vocabulary lacks."""
    known = load(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    counted = docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counted.join(known, "term", "left_anti").orderBy(F.desc("n"), "term").limit(50)


@register(f"""
with known as (select distinct unnest({TOKENS}) as term from benchmark), t as (select doc_id, unnest({TOKENS}) as term from documents)
select count(*) as tokens, count(known.term) as found, round(count(known.term) / count(*)::double, 9) as share from t left join known using (term)
""")
def dictionary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct().withColumn("hit", F.lit(True))
    counted = docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    joined = counted.join(known, "term", "left")
    found = F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0))
    return joined.agg(F.sum("n").alias("tokens"), found.alias("found"), F.round(found / F.sum("n"), 9).alias("share"))


URL = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://', '')"
NORMAL_URL = rf"'https://' || regexp_replace(lower(regexp_extract({URL}, '^([^/]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract({URL}, '^[^/]*(.*)$', 1), '/+$', '')"


@register(f"select page_id, {NORMAL_URL} as url from pages")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.normal_url(F.col("url")).alias("url"))


@register(f"""
with r as (select page_id, url, {NORMAL_URL} as norm from pages where page_id % 2 = 0),
l as (select page_id, case when page_id % 4 = 0 then url else replace(url, 'http://', 'https://') || '/?utm=1' end as u from pages), m as (select page_id, u, {NORMAL_URL.replace("url,", "u,")} as norm from l),
x as (select m.page_id, min(r.page_id) as match_id from m join r on m.u = r.url group by 1),
y as (select m.page_id, min(r.page_id) as match_id from m join r using (norm) where m.page_id not in (select page_id from x) group by 1)
select page_id, match_id, 'exact' as level from x union all select page_id, match_id, 'normalised' from y
""")
def url_two_level_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links found by their address as it is, and what is left by its normal form."""
    pages = load(spark, sf_dir, "pages", "page_id", "url")
    right = pages.where("page_id % 2 = 0").select(F.col("page_id").alias("right_id"), "url", T.normal_url(F.col("url")).alias("norm"))
    spoiled = F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(F.concat(F.replace("url", F.lit("http://"), F.lit("https://")), F.lit("/?utm=1")))
    left = pages.select("page_id", spoiled.alias("url")).withColumn("norm", T.normal_url(F.col("url")))
    return relational.two_level_join(left, right, "url", "norm", "right_id").select("page_id", "match_id", "level")


HTML_SQL = r"""
with a as (select page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') as t from pages),
b as (select page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as t from a)
select page_id, sha1(trim(regexp_replace(t, '[ \t\n\r\f\v]+', ' ', 'g'))) as digest from b
"""


@register(HTML_SQL)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.sha1(textquality.html_text(F.col("html"))).alias("digest"))


@register(r"""
select doc_id, sha1(case when length(f) <= 120 then f else regexp_replace(case when substr(f, 121, 1) = ' ' then left(f, 120) when regexp_extract(left(f, 120), '^(.*) [^ ]*$', 1) = '' then left(f, 120) else regexp_extract(left(f, 120), '^(.*) [^ ]*$', 1) end, '[ ,.;:!?-]+$', '') || '…' end) as digest
from (select doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) as f from documents)
""")
def word_safe_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha1(T.shorten(F.col("text"), 120)).alias("digest"))


@register(rf"""
with c as (select doc_id, text, trim(regexp_replace(regexp_replace(text, '[ \t]+([,.;:!?])', '\1', 'g'), '[ \t]{{2,}}', ' ', 'g')) as fixed from documents)
select doc_id, sha1(case when {numbers_sql("fixed")} = {numbers_sql("text")} then fixed else text end) as digest, sha1(regexp_replace(text, '[0-9]+', '#', 'g')) as masked from c
""")
def guarded_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing is repaired unless the text's numbers would change."""
    return docs(spark, sf_dir).select("doc_id", F.sha1(T.cleaned(F.col("text"))).alias("digest"), F.sha1(T.masked_numbers(F.col("text"))).alias("masked"))


@register(r"""
select conv_id, count(*) as turns, count(*) filter (where role = 'user') as user_turns, string_agg(left(role, 1), '' order by turn) as shape, sum(length(text))::bigint as chars from conversations group by 1
""")
def conversation_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").groupBy("conv_id")
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.substring("role", 1, 1).alias("r"))))
    return turns.agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.array_join(F.transform(ordered, lambda s: s["r"]), "").alias("shape"), F.sum(F.length("text")).alias("chars")
    )


@register(r"""
select doc_id, case when length(regexp_replace(text, '[^а-яёА-ЯЁ]', '', 'g')) > 0 and length(regexp_replace(text, '[^а-яёА-ЯЁ]', '', 'g')) >= length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) then 'ru' else 'en' end as script,
 length(regexp_replace(text, '(?s)\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)', ' ', 'g')) as without_math from documents
""")
def script_and_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.script_language(F.col("text")).alias("script"), F.length(T.without_math(F.col("text"))).alias("without_math"))


@register(r"""
select doc_id, case when regexp_matches(text, '^[=+@\t\r-]') then '''' || text else text end = text as safe, length(concat_ws(' ', lang, nullif(source, ''), left(text, 50))) as built from documents
""")
def csv_cells_and_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells guarded against formulas, and a text assembled from optional blocks."""
    built = F.concat_ws(" ", "lang", F.nullif(F.col("source"), F.lit("")), F.substring("text", 1, 50))
    return docs(spark, sf_dir).select("doc_id", (T.formula_safe(F.col("text")) == F.col("text")).alias("safe"), F.length(built).alias("built"))
