"""The numbered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.llm import divergence, exact, filteraudit, gam, hmm, licences, linededup, packing, pieces, quality, secretscan, simhash, toxicity
from sparklode.sources import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets: counts by kind, a digest of the base spans, and all spans."""
    found = secretscan.find_secrets(load(spark, sf_dir, "documents", "doc_id", "text"))
    count = {k: F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in secretscan.KINDS}
    base = secretscan.joined(F.filter("spans", lambda s: s["kind"] != "novel"))
    return found.select("doc_id", *count.values(), F.sha2(base, 256).alias("base_sha256"), secretscan.joined(F.col("spans")).alias("spans"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines counted, and a digest of the text that is left."""
    left = linededup.drop_repeated_lines(load(spark, sf_dir, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    return packing.best_fit_packing(load(spark, sf_dir, "documents", "doc_id", "text"), digest=True)


def op4_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base score and its hidden-Markov score."""
    return hmm.language_model_scores(load(spark, sf_dir, "documents", "doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts, the posterior of being good, and whether it is kept."""
    found = quality.judged(load(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exact.duplicate_groups(load(spark, sf_dir, "documents", "doc_id", "text"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licences that its lines, blocks or whole text match."""
    return licences.licences_by_document(load(spark, sf_dir, "documents", "doc_id", "text"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and near-duplicate class."""
    classes = simhash.near_duplicate_classes(load(spark, sf_dir, "documents", "doc_id", "text"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number and digest of its ids, and a digest of what they decode to."""
    done = pieces.encoded(load(spark, sf_dir, "documents", "doc_id", "text"), decode=True)
    length = (F.octet_length("ids") / 4).cast("long").alias("n_ids")
    return done.select("doc_id", length, F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score."""
    return toxicity.toxicity_scores(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "labels", "doc_id", "toxic"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of a language against every other, and its own terms."""
    return divergence.source_divergences(load(spark, sf_dir, "documents", "text", "lang", "source"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    return gam.quality_scores(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "labels", "doc_id", "quality"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language, order of the five filters and step with what the step does."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return filteraudit.filter_order_audit(docs, load(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def queries() -> dict[str, Query]:
    found = (
        op1_secret_scan,
        op2_line_dedup,
        op3_best_fit_packing,
        op4_hmm_scoring,
        op5_quality_rules,
        op6_exact_dedup,
        op7_licence_scan,
        op8_simhash_near_dedup,
        op9_sentencepiece,
        op10_toxicity,
        op11_source_divergence,
        op12_quality_classifier,
        op13_filter_audit,
    )
    return {f.__name__: f for f in found}


OP2_SQL = """
with lines as (
  select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
repeated as (
  select key, max(doc_id) as holder from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3),
judged as (
  select k.doc_id, k.pos, k.line, coalesce(k.doc_id < r.holder, false) as gone
  from keyed k left join repeated r using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""

OP6_SQL = """
with normal as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
grouped as (select t, max(doc_id) as keep_id, count(*) as group_size from normal group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
from normal join grouped using (t)
"""


def _normal_sql(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"trim(regexp_replace({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"


def _bigrams_sql(words: str) -> str:
    return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


def op7_sql() -> str:
    """Every unit against every template; blocks are lines numbered by the empty lines before them. A null id is a document too."""
    quoted = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in licences.TEMPLATES.items())
    return f"""
with templates as (
  select licence, {_bigrams_sql("w")} as b
  from (select licence, string_split({_normal_sql("text")}, ' ') as w from (values {quoted}) v(licence, text))),
lines as (
  select doc_id, unnest(l) as line, unnest(range(0, len(l))) as n
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
marked as (
  select *, {_normal_sql("line")} = '' as blank,
    sum(case when {_normal_sql("line")} = '' then 1 else 0 end) over (partition by doc_id order by n rows unbounded preceding) as block
  from lines),
units as (
  select doc_id, n as unit, line as text from lines
  union all
  select doc_id, min(n), string_agg(line, ' ' order by n) from marked where not blank
    and doc_id in (select doc_id from marked where blank) group by doc_id, block having count(*) > 1
  union all
  select doc_id, -1, text from documents where doc_id in (select doc_id from lines where n = 1)),
sized as (
  select doc_id, unit, {_bigrams_sql("w")} as a
  from (select doc_id, unit, string_split({_normal_sql("text")}, ' ') as w from units)),
scored as (
  select doc_id, unit, licence, 2.0::double * len(list_intersect(a, b)) / (len(a) + len(b)) as dice
  from sized, templates where len(a) between {licences.DICE / (2 - licences.DICE)} * len(b) and {(2 - licences.DICE) / licences.DICE} * len(b)),
best as (
  select doc_id, unit, max(dice) as dice, arg_min(licence, (-dice, licence)) as licence
  from scored where dice >= {licences.DICE} group by doc_id, unit),
found as (
  select doc_id, count(*) as n_matches, string_agg(distinct licence, ',' order by licence) as licences, max(dice) as best_dice
  from best group by doc_id)
select doc_id, coalesce(n_matches, 0) as n_matches, coalesce(licences, '') as licences, best_dice
from (select distinct doc_id from documents) left join found using (doc_id)
"""


OP11_SQL = """
with docs as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
tokens as (
  select doc, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs),
vocabulary as (
  select lang, term, count(*)::hugeint as lang_n from tokens group by lang, term having count(distinct doc) >= 30),
sizes as (select lang, count(*) as kinds, sum(lang_n)::hugeint as lang_total from vocabulary group by lang),
entries as (
  select lang, source, term, count(*)::hugeint as n from tokens join vocabulary using (lang, term) group by lang, source, term),
groups as (
  select lang, source, coalesce(sum(n), 0)::hugeint as total
  from (select distinct lang, source from docs) left join entries using (lang, source) group by lang, source),
smooth as (
  select lang, source, term, coalesce(n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (total + 5 * kinds) as p,
    1 + (1000000000::hugeint * (lang_n + 5)) // (lang_total + 5 * kinds) as q
  from groups join vocabulary using (lang) join sizes using (lang) left join entries using (lang, source, term)),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(d.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (
    select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
    from smooth a join smooth b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) d
    on d.lang = a.lang and d.source = a.source and d.item = b.source),
found as (
  select lang, source, 'pair' as part, item, value from pairs
  union all select lang, source, 'term', term, p - q from smooth where n > 0 and p > q),
ranked as (
  select lang, source, part, item, value::bigint as value,
    (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
  from found)
select * from ranked where part = 'pair' or rank <= 50
"""

OP13_SQL = """
with docs as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
said as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id),
failed as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(w) < 100 then 'A' else '' end
    || case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end as mask
  from docs left join said using (doc_id)),
held as (
  select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from failed group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (
  select filter_order, step, substr(filter_order, step, 1) as f, left(filter_order, step - 1) as before
  from orders, (select unnest(range(1, 6))::int as step)),
judged as (
  select part, filter_order, step, f, n, good, toxic, contains(mask, f) as fails, mask = f as alone,
    length(translate(mask, before, '')) = length(mask) as alive
  from held, steps),
done as (
  select part, filter_order, step, f,
    coalesce(sum(n) filter (where alive and not fails), 0) as kept,
    coalesce(sum(n) filter (where alive and fails), 0) as removed,
    coalesce(sum(n) filter (where not alive and fails), 0) as redundant,
    coalesce(sum(n) filter (where alone), 0) as unique_fails,
    coalesce(sum(good) filter (where alive and fails), 0) as good_lost,
    coalesce(sum(toxic) filter (where alive and fails), 0) as toxic_lost
  from judged group by part, filter_order, step, f)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, f))::bigint as shapley
from done
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": OP11_SQL, "op13_filter_audit": OP13_SQL, "op2_line_dedup": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op7_licence_scan": op7_sql()}
