"""De-duplication groups, vector search, lexical search, fusion and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.functions import text as T
from sparklode.operators import dedup, evaluation, search, vectors
from sparklode.operators.graph import connected_components
from sparklode.plans.registry import Registry
from sparklode.plans.texts import TOKENS, numbers_sql, tri_sql
from sparklode.sources import load
from sparklode.sources.scratch import Scratch

register = Registry()

FLAT = r"trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.usable(load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "embedding", 64)


@register(f"select min(doc_id) as root, count(*) as members from documents where length({FLAT}) >= 80 group by {FLAT} having count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = T.collapse(F.col("text"))
    return dedup.text_groups(docs(spark, sf_dir), "doc_id", flat, 80).select("root", "members")


@register("""
with k as (select doc_id, string_split(text, chr(10))[1] as head, md5(array_to_string(string_split(text, chr(10))[2:], '|')) as parts from documents),
g as (select head, parts, min(doc_id) as a from k where head <> '' group by all) select a, doc_id as b from k join g using (head, parts) where a <> doc_id
""")
def hash_edges_with_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share their header are tied only if all their other lines agree too; stars, not all pairs."""
    lines = F.split("text", "\n", -1)
    rows = docs(spark, sf_dir).select("doc_id", lines[0].alias("head"), F.md5(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), "|")).alias("parts"))
    return dedup.star_edges(rows, "doc_id", [F.col("head"), F.col("parts")])


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents of one source and similar length; long chains."""
    rows = docs(spark, sf_dir).select("doc_id", F.concat_ws("-", "source", F.floor(F.col("n_chars") / 400).cast("string")).alias("k"))
    return dedup.star_edges(rows, "doc_id", [F.col("k")]).unionByName(
        rows.where("doc_id % 10 = 0").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 3).alias("b"))
    )


EDGES = """
k as (select doc_id, source || '-' || (n_chars // 400) as k from documents), g as (select k, min(doc_id) as a from k group by 1),
edges as (select a, doc_id as b from k join g using (k) where a <> doc_id union all select doc_id, doc_id + 3 from documents where doc_id % 10 = 0),
both_ways as (select a, b from edges union select b, a from edges)
"""


@register(f"""
with recursive {EDGES},
reach(node, root) as (select a, a from both_ways union select e.b, r.root from reach r join both_ways e on r.node = e.a)
select node, min(root) as root from reach group by node
""")
def connected_components_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_edges(spark, sf_dir), "a", "b")


@register(f"""
with recursive {EDGES},
reach(node, root) as (select a, a from both_ways union select e.b, r.root from reach r join both_ways e on r.node = e.a),
m as (select node, min(root) as root from reach group by node),
s as (select root, node, coalesce(quality, 0) as q, (select max(n_chars) from documents where doc_id = node) as c from m left join labels on labels.doc_id = node),
r as (select *, row_number() over (partition by root order by q desc, c desc nulls last, node) as n, max(q) over (partition by root) as top, count(*) over (partition by root) as size from s),
f as (select *, count(*) filter (where q = top) over (partition by root) as tops from r)
select root, node, case when size = 1 then 'only' when tops = 1 then 'score' else 'tie' end as rule from f where n = 1
""")
def representative_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's favourite by review, then length, then id."""
    members = connected_components(_edges(spark, sf_dir), "a", "b")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("doc_id", "node")
    sizes = docs(spark, sf_dir).select(F.col("doc_id").alias("node"), "n_chars")
    scored = members.join(labels, "node", "left").join(sizes, "node", "left").withColumn("q", F.coalesce("quality", F.lit(0)))
    return dedup.representatives(scored, "root", "node", [F.col("q"), F.coalesce("n_chars", F.lit(-1))]).select("root", "node", "rule")


@register("""
with r as (select doc_id as id, row_number() over (order by n_chars desc, doc_id) as rank, case when doc_id % 3 = 0 then source end as grp, doc_id % 15 = 0 as favourite from documents),
w as (select *, row_number() over (partition by coalesce(grp, 'own-' || id) order by (grp is not null and favourite)::int desc, rank, id) as n, min(rank) over (partition by coalesce(grp, 'own-' || id)) as position from r)
select id, position from w where n = 1
""")
def collapse_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked list with each duplicate group shown once, its favourite first."""
    from sparklode.operators.ranking import places

    ranked = places(docs(spark, sf_dir), [F.desc("n_chars"), F.asc("doc_id")]).select(
        F.col("doc_id").alias("id"), F.col("place").alias("rank"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("grp"), ((F.col("doc_id") % 15 == 0) & (F.col("doc_id") % 3 == 0)).alias("favourite")
    )
    return dedup.collapse(ranked, "id", "grp", "rank", "favourite").select("id", "position")


@register(f"""
select doc_id, len(list_distinct({numbers_sql("text")})) = 0 or (len(list_distinct({numbers_sql("text")})) <= 4 and len(list_filter({numbers_sql("text")}, lambda n: not regexp_matches(n, '^[1-9]$'))) = 0) as weak from documents
""")
def weak_number_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.weak_numbers(T.numbers(F.col("text"))).alias("weak"))


UNIT = """
u as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings where len(embedding) = 64),
n as (select vec_id, label, v, greatest(sqrt(list_dot_product(v, v)), 1e-9) as l from u),
sims as (select q.vec_id as query_id, d.vec_id as id, q.label as ql, d.label as dl, round(list_dot_product(q.v, d.v) / q.l / d.l, 9) as similarity from n q join n d on q.vec_id <> d.vec_id where q.vec_id % 100 = 0),
top as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from sims)
"""


def _search(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return vectors.block_search(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", k)


@register(f"with {UNIT} select query_id, id, rank, round(similarity, 6) as similarity from top where rank <= 10")
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return _search(spark, sf_dir, 10).withColumn("similarity", F.round("similarity", 6))


@register(f"with {UNIT} select query_id, id, round(similarity, 6) as similarity from sims where similarity >= 0.4")
def cosine_pairs_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows at or above the cut-off, for every hundredth vector."""
    rows = embeddings(spark, sf_dir)
    found = vectors.block_search(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", least=0.4)
    return found.withColumn("similarity", F.round("similarity", 6))


@register(f"""
with {UNIT}, v as (select query_id, dl as label, count(*) as votes, round(avg(similarity), 6) as mean from top where rank <= 10 group by 1, 2),
b as (select *, row_number() over (partition by query_id order by votes desc, mean desc, label) as n from v) select query_id, label, votes, mean, votes >= 2 and mean >= 0.1 as accepted from b where n = 1
""")
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic ten neighbours vote for."""
    voted = vectors.vote(_search(spark, sf_dir, 10), embeddings(spark, sf_dir), "vec_id", "label", 2, 0.1)
    return voted.withColumn("mean", F.round("mean", 6))


@register(f"""
with {UNIT}, v as (select query_id, ql, dl as label, count(*) as votes, round(avg(similarity), 9) as mean from top where rank <= 10 group by 1, 2, 3),
b as (select *, row_number() over (partition by query_id order by votes desc, mean desc, label) as n from v),
g as (select unnest([1, 2, 3]) as least_votes), m as (select unnest([0.0, 0.2]) as least_mean)
select least_votes, least_mean::double as least_mean, round(count(*) filter (where votes >= least_votes and mean >= least_mean) / count(*)::double, 9) as coverage,
 round(count(*) filter (where votes >= least_votes and mean >= least_mean and label = ql) / nullif(count(*) filter (where votes >= least_votes and mean >= least_mean), 0)::double, 9) as accuracy from b, g, m where n = 1 group by 1, 2
""")
def knn_calibration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    voted = vectors.vote(_search(spark, sf_dir, 10), rows, "vec_id", "label", 1, 0.0)
    return vectors.calibration_grid(voted, rows, "vec_id", "label", [1, 2, 3], [0.0, 0.2])


@register(f"""
with {UNIT}, s as (select t.*, row_number() over (partition by query_id order by similarity desc, id) as r from top t where rank <= 30 and dl <> ql) select query_id, id, r as rank from s where r <= 5
""")
def similar_with_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five similar items out of a pool of thirty, without those of the same label; the pool is cut first."""
    labels = embeddings(spark, sf_dir).select("vec_id", "label")
    pool = _search(spark, sf_dir, 30)
    mine, theirs = labels.withColumnsRenamed({"vec_id": "query_id", "label": "ql"}), labels.withColumnsRenamed({"vec_id": "id", "label": "dl"})
    kept = pool.join(mine, "query_id").join(theirs, "id").where("ql <> dl").drop("rank")
    return vectors.ranked(kept, 5).select("query_id", "id", "rank")


def _metrics_sql(k: str) -> str:
    return f"count(*) filter (where rank <= {k}) / count(*)::double"


CASES = f"""
truth as (select q.vec_id as query_id, d.vec_id as id from n q join n d on q.label = d.label and q.vec_id <> d.vec_id where q.vec_id % 100 = 0),
hits as (select t.query_id, t.id, case when top.rank <= 50 then top.rank end as rank, t.id % 2 = 0 as indexed from truth t left join top on t.query_id = top.query_id and t.id = top.id),
cases as (select query_id, count(*) as relevant, {_metrics_sql("5")} as recall_5, {_metrics_sql("50")} as recall_50, coalesce(1.0 / min(case when rank <= 10 then rank end), 0) as mrr_10,
 sum(case when rank <= 10 then 1 / log2(rank + 1) else 0 end) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda r: 1 / log2(r + 1))) as ndcg_10, not bool_or(indexed) as unreachable from hits group by query_id)
"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    ids = rows.select("vec_id", "label")
    truth = ids.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id").join(ids.withColumnRenamed("vec_id", "id"), "label").where("query_id <> id")
    index = ids.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"))
    return evaluation.per_query(_search(spark, sf_dir, 50), truth.select("query_id", "id"), [5, 50], index)


@register(f"with {UNIT}, {CASES} select query_id, relevant, round(recall_5, 9) as recall_5, round(recall_50, 9) as recall_50, round(mrr_10, 9)::double as mrr_10, round(ndcg_10, 9) as ndcg_10, unreachable from cases")
def retrieval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir)
    return cases.withColumns({c: F.round(c, 9) for c in ("recall_5", "recall_50", "mrr_10", "ndcg_10")})


@register(f"""
with {UNIT}, {CASES} select count(*) as queries, round(avg(recall_5), 9) as recall_5, round(avg(recall_50), 9) as recall_50, round(avg(mrr_10), 9) as mrr_10, round(avg(ndcg_10), 9) as ndcg_10,
 round(avg(unreachable::int), 9) as unreachable, round(round(avg(recall_50), 9) - round(avg(recall_5), 9), 9) as gap from cases
""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.means(_cases(spark, sf_dir), [5, 50])


GRADED = """
lab as (select q.vec_id as query_id, d.vec_id as id, case when q.label = d.label then 2 when (q.label + d.label) % 3 = 0 then 1 else 0 end as label from n q join n d on q.vec_id <> d.vec_id where q.vec_id % 100 = 0 and d.vec_id % 4 <> 0),
shown as (select top.query_id, top.id, rank, label from top left join lab using (query_id, id) where rank <= 10),
sc as (select query_id, count(*) filter (where label >= 1) / count(*)::double as precision, count(*) filter (where label >= 1) / nullif(count(label), 0)::double as precision_labelled, count(label) / count(*)::double as labelled_share,
 sum(coalesce((pow(2, label) - 1) / log2(rank + 1), 0)) as dcg, count(*) filter (where label >= 1) >= 3 as three_good from shown group by 1),
best as (select *, row_number() over (partition by query_id order by label desc, id) as r from lab), ideal as (select query_id, sum((pow(2, label) - 1) / log2(r + 1)) as ideal from best where r <= 10 group by 1)
"""


@register(f"""
with {UNIT}, {GRADED} select query_id, round(precision, 9) as precision, round(precision_labelled, 9) as precision_labelled, round(labelled_share, 9) as labelled_share, three_good, round(coalesce(dcg / nullif(ideal, 0), 0), 9) as ndcg
from sc left join ideal using (query_id)
""")
def graded_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded labels: the same topic is 2, a related one 1; a quarter of the rows has no label.

    Labels are looked up for the rows shown. What a perfect list would gain needs only how many rows of each topic are labelled."""
    ids = embeddings(spark, sf_dir).select("vec_id", "label")
    grade = lambda dl: F.when(F.col("ql") == dl, 2).when((F.col("ql") + dl) % 3 == 0, 1).otherwise(0)
    mine = ids.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    theirs = ids.where("vec_id % 4 <> 0").select(F.col("vec_id").alias("id"), F.col("label").alias("dl"))
    shown = Scratch(spark, "graded").keep(_search(spark, sf_dir, 10), "shown")
    labels = shown.join(mine, "query_id").join(theirs, "id").select("query_id", "id", grade(F.col("dl")).alias("label"))
    # One row a topic; every hundredth row, the queries, has no label itself.
    topics = [F.struct(F.lit(r["dl"]).alias("dl"), F.lit(r["n"]).alias("n")) for r in theirs.groupBy("dl").agg(F.count("*").alias("n")).collect()]
    many = lambda g: F.aggregate(F.array(*topics), F.lit(0).cast("long"), lambda s, t: s + F.when(grade(t["dl"]) == g, t["n"]).otherwise(0))
    counts = mine.select("query_id", F.array(many(2), many(1)).alias("counts"))
    out = evaluation.graded(shown, labels, counts, 10, 1)
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "precision_labelled", "labelled_share", "ndcg")})


@register("""
with a as (select doc_id as query_id, doc_id as id, case when doc_id % 5 = 0 then 1 else quality * 2 end as a from labels where doc_id % 3 <> 0),
b as (select doc_id as query_id, doc_id as id, case when doc_id % 7 = 0 then 1 else 2 - 2 * toxic end as b from labels where doc_id % 4 <> 0),
j as (select *, a is null or b is null as partial from a full join b using (query_id, id))
select query_id, id, partial, coalesce(a <> b, false) as disagreement, case when partial then coalesce(a, b) when a = 2 and b = 2 then 2 when a = 0 and b = 0 then 0 else 1 end as consensus,
 case when partial then coalesce(a, b) when a = 2 or b = 2 then 2 when a = 0 and b = 0 then 0 else 1 end as lenient, case when partial then coalesce(a, b) when a = 0 or b = 0 then 0 when a = 2 and b = 2 then 2 else 1 end as strict from j
""")
def merged_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges' labels merged by each of the three rules."""
    rows = load(spark, sf_dir, "labels").withColumns({"query_id": F.col("doc_id"), "id": F.col("doc_id")})
    first = rows.where("doc_id % 3 <> 0").select("query_id", "id", F.expr("if(doc_id % 5 = 0, 1, quality * 2)").alias("label"))
    second = rows.where("doc_id % 4 <> 0").select("query_id", "id", F.expr("if(doc_id % 7 = 0, 1, 2 - 2 * toxic)").alias("label"))
    out = evaluation.merged_judges(first, second, "consensus").withColumnRenamed("label", "consensus")
    for rule in ("lenient", "strict"):
        out = out.join(evaluation.merged_judges(first, second, rule).select("query_id", "id", F.col("label").alias(rule)), ["query_id", "id"])
    return out


@register("""
with x as (select quality + toxic as la, quality * 2 as lb from labels) select count(*) as common, round(avg((la = lb)::int), 9) as exact, round(avg(case when la <> 1 and lb <> 1 then (la = lb)::int end), 9) as binary from x
""")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels")
    machine = rows.select("doc_id", (F.col("quality") + F.col("toxic")).alias("label"))
    return evaluation.agreement(machine, rows.select("doc_id", (F.col("quality") * 2).alias("label")), "doc_id", 1)


BM25 = f"""
w as (select doc_id as id, {TOKENS} as w from documents), l as (select id, len(w) as length, w from w), p as (select id, length, unnest(w) as term from l), tf as (select id, length, term, count(*) as tf from p group by all),
st as (select count(*) as docs, avg(length) as mean from l), df as (select term, count(*) as df from tf group by 1), qt as (select item_id as query_id, unnest(list_distinct({TOKENS})) as term from benchmark),
sc as (select query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) as score from qt join tf using (term) join df using (term), st group by all),
bm as (select *, row_number() over (partition by query_id order by score desc, id) as rank from sc),
cov as (select *, row_number() over (partition by query_id order by score desc, id) as rank from (select query_id, id, count(*) as score from qt join tf using (term) group by all))
"""


def _lexical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the documents' lengths and the queries' terms. Texts are tokenised once and the index is written once, whatever reads it."""
    return _indexed(spark, docs(spark, sf_dir), search.query_terms(load(spark, sf_dir, "benchmark"), "item_id", F.col("text")))


def _indexed(spark: SparkSession, rows: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms stand by their XXH64, in the index and among the queries' terms."""
    scratch = Scratch(spark, "lexical")
    counted = rows.select(F.col("doc_id").alias("id"), F.array_sort(F.transform(T.tokens(F.col("text")), lambda t: F.xxhash64(t))).alias("w")).select("id", F.size("w").alias("length"), "w")
    words = scratch.keep(counted, "words")
    terms = scratch.keep(terms.select("query_id", F.xxhash64("term").alias("term")).distinct(), "terms")
    wanted = search.postings_of(words).join(terms.select("term").distinct(), "term", "left_semi")
    return scratch.keep(wanted.select("id", "length", "term", "tf"), "postings"), words.select("id", "length"), terms


@register(f"with {BM25} select query_id, id, score, rank from bm where rank <= 20")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for each benchmark item."""
    index, lengths, terms = _lexical(spark, sf_dir)
    return search.bm25(index, lengths, terms, 20).select("query_id", "id", "score", "rank")


@register(f"with {BM25} select query_id, id, score, rank from cov where rank <= 20")
def coverage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _, terms = _lexical(spark, sf_dir)
    return search.coverage(index, terms, 20).select("query_id", "id", "score", "rank")


FUSED = """
f as (select query_id, id, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 12)::double as score, case when a.rank is not null and b.rank is not null then 'both' when a.rank is not null then 'first' else 'second' end as legs
 from (select * from bm where rank <= 50) a full join (select * from cov where rank <= 50) b using (query_id, id)), fr as (select *, row_number() over (partition by query_id order by score desc, id) as rank from f)
"""


@register(f"with {BM25}, {FUSED} select query_id, id, round(score, 9) as score, legs, rank from fr where rank <= 20")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, lengths, terms = _lexical(spark, sf_dir)
    fused = search.fused(search.bm25(index, lengths, terms, 50), search.coverage(index, terms, 50), 20)
    return fused.withColumn("score", F.round("score", 9)).select("query_id", "id", "score", "legs", "rank")


@register(f"""
with {BM25}, {FUSED}, n as (select query_id, count(*) as terms from qt group by 1), x as (select fr.query_id, fr.id, legs, terms, coalesce(cov.score, 0) as hit from fr join n using (query_id) left join cov on cov.query_id = fr.query_id and cov.id = fr.id where fr.rank <= 20)
select query_id, id, case when legs = 'both' or hit = terms then 'exact' when 2 * hit >= terms then 'close' else 'far' end as confidence from x
""")
def confidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, lengths, terms = _lexical(spark, sf_dir)
    fused = Scratch(spark, "labels").keep(search.fused(search.bm25(index, lengths, terms, 50), search.coverage(index, terms, 50), 20), "fused")
    # Terms are counted for the rows shown alone.
    shown = fused.select("query_id", "id").join(terms, "query_id").join(index.select("id", "term"), ["id", "term"])
    every = shown.groupBy("query_id", "id").agg(F.count("*").alias("hit"))
    joined = fused.join(terms.groupBy("query_id").agg(F.count("*").alias("terms")), "query_id").join(every, ["query_id", "id"], "left")
    label = search.confidence(F.col("legs"), F.coalesce("hit", F.lit(0)), F.col("terms"), F.lit(None).cast("double"))
    return joined.select("query_id", "id", label.alias("confidence"))


@register(f"""
with {BM25}, a as (select query_id, id, rank as o from bm where rank <= 15 union all select query_id, id, 15 + rank from cov where rank <= 15), m as (select query_id, id, min(o) as o from a group by all),
pl as (select query_id, id, row_number() over (partition by query_id order by o, id) as place from m) select query_id, id, place from pl where place <= 25
""")
def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, lengths, terms = _lexical(spark, sf_dir)
    return search.pool([search.bm25(index, lengths, terms, 15), search.coverage(index, terms, 15)], 15, 25).select("query_id", "id", "place")


@register(f"""
with {BM25}, s as (select query_id, id, rank, case when id % 2 = 0 then (id * 7 + query_id) % 11 end as score from bm where rank <= 20) select query_id, id, row_number() over (partition by query_id order by score desc nulls last, rank, id) as place from s
""")
def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outside model's scores for half of the pool; the rest goes behind in its old order."""
    index, lengths, terms = _lexical(spark, sf_dir)
    ranking = search.bm25(index, lengths, terms, 20)
    scores = ranking.where("id % 2 = 0").select("query_id", "id", ((F.col("id") * 7 + F.col("query_id")) % 11).alias("score"))
    return search.reranked(ranking, scores).select("query_id", "id", "place")


@register(f"""
with w as (select item_id, {TOKENS} as w from benchmark), ph as (select distinct array_to_string(w[3:4], ' ') as phrase from w union select distinct w[2] from w),
g as (select doc_id as id, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) as phrase from (select doc_id, {TOKENS} as w from documents)) select id, phrase from g where phrase in (select phrase from ph)
""")
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary phrases of one or two words in each document."""
    words = load(spark, sf_dir, "benchmark").select(T.tokens(F.col("text")).alias("w"))
    phrases = words.select(F.array_join(F.slice("w", 3, 2), " ").alias("phrase")).unionByName(words.select(F.get("w", F.lit(1)).alias("phrase")))
    return search.matched_terms(docs(spark, sf_dir), "doc_id", F.col("text"), phrases.where("phrase is not null"), 2)


@register(f"""
with t as (select doc_id as id, unnest(list_distinct({TOKENS})) as phrase from documents), d as (select phrase, count(*) as df from t group by 1), c as (select phrase, df from d order by df desc, phrase limit 15),
r as (select id, phrase, row_number() over (partition by id order by df, phrase) as place from t join d using (phrase)), k as (select * from r where place <= 40), h as (select id, count(*) as n from k group by 1 having count(*) < 15),
x as (select h.id, c.phrase, n + row_number() over (partition by h.id order by df desc, c.phrase) as place from h, c where not exists (select 1 from k where k.id = h.id and k.phrase = c.phrase))
select id, phrase, place from k union all select id, phrase, place from x where place <= 15
""")
def rare_first_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty rarest words of every text; short texts get common ones up to fifteen."""
    words = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    return search.rare_first(words, 40, 15)


#: Every hundredth document is a query: its words are the lexical leg's terms, its vector the dense leg's; an item is never its own answer.
HYBRID = f"""
{UNIT},
w as (select doc_id as id, {TOKENS} as w from documents), l as (select id, len(w) as length, w from w), p as (select id, length, unnest(w) as term from l), tf as (select id, length, term, count(*) as tf from p group by all),
qt as (select id as query_id, unnest(list_distinct(w)) as term from w where id % 100 = 0),
cov as (select *, row_number() over (partition by query_id order by score desc, id) as rank from (select query_id, id, count(*) as score from qt join tf using (term) where id <> query_id group by all)),
hy as (select query_id, id, a.rank as ra, b.rank as rb, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 12)::double as score, case when a.rank is not null and b.rank is not null then 'both' when a.rank is not null then 'first' else 'second' end as legs
 from (select * from top where rank <= 50) a full join (select * from cov where rank <= 50) b using (query_id, id)),
hr as (select *, row_number() over (partition by query_id order by score desc, id) as rank from hy)
"""


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, lengths and terms of every hundredth document as a query, all its words."""
    rows = docs(spark, sf_dir)
    asked = rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), T.tokens(F.col("text")).alias("w"))
    return _indexed(spark, rows, asked.select("query_id", F.explode_outer(F.array_distinct("w")).alias("term")).where("term is not null"))


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The fused list of a dense and a lexical leg, how many terms each answer has of its query, and each query's number of terms."""
    index, _, terms = _asked(spark, sf_dir)
    # One answer more than wanted, for a document is the best answer to itself.
    lexical = search.coverage(index, terms, 51).where("id <> query_id")
    fused = Scratch(spark, "hybrid").keep(search.fused(_search(spark, sf_dir, 50), search.top(lexical, 50), 20), "fused")
    hits = fused.select("query_id", "id").join(terms, "query_id").join(index.select("id", "term"), ["id", "term"])
    return fused, hits.groupBy("query_id", "id").agg(F.count("*").alias("score")), terms.groupBy("query_id").agg(F.count("*").alias("terms"))


@register(f"with {HYBRID} select query_id, id, round(score, 9) as score, case legs when 'first' then 'dense' when 'second' then 'lexical' else legs end as legs, rank from hr where rank <= 20")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of nearest vectors and shared words."""
    legs = F.when(F.col("legs") == "first", "dense").when(F.col("legs") == "second", "lexical").otherwise(F.col("legs"))
    return _hybrid(spark, sf_dir)[0].select("query_id", "id", F.round("score", 9).alias("score"), legs.alias("legs"), "rank")


@register(f"""
with {HYBRID}, nt as (select query_id, count(*) as terms from qt group by 1),
x as (select hr.query_id, hr.id, legs, coalesce(terms, 0) as terms, coalesce(cov.score, 0) as hit, similarity from hr left join nt using (query_id) left join cov on cov.query_id = hr.query_id and cov.id = hr.id
 left join sims on sims.query_id = hr.query_id and sims.id = hr.id where hr.rank <= 20)
select query_id, id, case when legs = 'both' or hit = terms or coalesce(similarity >= 0.75, false) then 'exact' when coalesce(similarity >= 0.55, false) or 2 * hit >= terms then 'close' else 'far' end as confidence from x
""")
def hybrid_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure each answer of the fused list is, by its legs, the terms it holds and its cosine with the query."""
    fused, shared, terms = _hybrid(spark, sf_dir)
    rows = embeddings(spark, sf_dir)
    near = vectors.block_search(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", least=0.55)
    joined = fused.drop("score").join(terms, "query_id", "left").join(shared.withColumnRenamed("score", "hit"), ["query_id", "id"], "left").join(near, ["query_id", "id"], "left")
    label = search.confidence(F.col("legs"), F.coalesce("hit", F.lit(0)), F.coalesce("terms", F.lit(0)), F.col("similarity"))
    return joined.select("query_id", "id", label.alias("confidence"))


@register(f"""
with {UNIT}, c as (select query_id, id, similarity, x.text as x, y.text as y from sims join documents x on x.doc_id = query_id join documents y on y.doc_id = id where similarity >= 0.3),
t as (select *, {tri_sql("x")} as tx, {tri_sql("y")} as ty from c)
select query_id, id, similarity >= 0.98 as near, list_sort({numbers_sql("x")}) = list_sort({numbers_sql("y")}) as same_numbers, len(list_intersect(tx, ty)) / (len(tx) + len(ty) - len(list_intersect(tx, ty)))::double >= 0.8 as same_trigrams from t
""")
def near_dup_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document against all, by cosine, and the three gates that make a pair near duplicates, on whole texts."""
    rows = embeddings(spark, sf_dir)
    near = vectors.block_search(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", least=0.3)
    scratch = Scratch(spark, "near")
    near = scratch.keep(near, "pairs")
    wanted = near.select(F.col("id").alias("doc_id")).unionByName(near.select(F.col("query_id").alias("doc_id"))).distinct()
    texts = docs(spark, sf_dir).join(wanted, "doc_id", "left_semi").withColumn("key", F.xxhash64("text"))
    # Digests and sketches go along with all pairs; texts only with those that the sketches leave open.
    numbers = F.sha2(F.array_join(F.array_sort(T.numbers(F.col("text"))), "\n"), 256)
    marks = scratch.keep(texts.select("doc_id", "key", numbers.alias("numbers"), T.trigram_sketch("text").alias("sketch")), "marks")
    x, y = (marks.select(F.col("doc_id").alias(k), F.col("key").alias(f"k{k}"), F.col("numbers").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in ("query_id", "id"))
    most = T.trigram_bound(F.col("squery_id.n"), F.col("squery_id.bits"), F.col("sid.n"), F.col("sid.bits"))
    gates = [(F.col("similarity") >= 0.98).alias("near"), (F.col("nquery_id") == F.col("nid")).alias("same_numbers"), (most >= 0.8 - 1e-9).alias("same_trigrams")]
    judged = scratch.keep(near.join(x, "query_id").join(y, "id").select("query_id", "id", "kquery_id", "kid", *gates), "judged")
    left = judged.where("same_trigrams")
    ends = left.select(F.col("query_id").alias("doc_id"), F.col("kquery_id").alias("key")).unionByName(left.select(F.col("id").alias("doc_id"), F.col("kid").alias("key"))).distinct()
    # Rows may share their id: each pair of them is one row of `judged`, and finds its texts by id and hash.
    held = texts.select("doc_id", "key", "text").join(ends, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    tx, ty = (held.select(F.col("doc_id").alias(k), F.col("key").alias(f"k{k}"), F.col("text").alias(f"t{k}")) for k in ("query_id", "id"))
    exact = left.drop("same_trigrams").join(tx, ["query_id", "kquery_id"]).join(ty, ["id", "kid"])
    jaccard = T.trigram_jaccard(F.col("tquery_id"), F.col("tid"))
    columns = ["query_id", "id", "near", "same_numbers"]
    rest = judged.where("not coalesce(same_trigrams, false)").select(*columns, "same_trigrams")
    return exact.select(*columns, (jaccard >= 0.8).alias("same_trigrams")).unionByName(rest)
