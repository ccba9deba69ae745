"""Formats of other systems, written from the tables and read back: vector files, packages, archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.operators.textquality import html_text
from sparklode.plans.registry import Registry
from sparklode.plans.texts import HTML_SQL
from sparklode.sources import archives, load, packages, places, vectorfiles
from sparklode.sources.scratch import Scratch

register = Registry()


@register("""
select vec_id as id, len(embedding) as dim, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total,
  round(embedding[1]::double, 6) as first from embeddings
""")
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, written as raw floats beside its ids and read back by ranges of rows."""
    path = Scratch(spark, "vectors").path("files")
    vectorfiles.register(spark)
    rows = load(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), "embedding")
    rows.write.format("vectors").mode("overwrite").option("rows", 700).save(path)
    back = spark.read.format("vectors").option("rows", 300).load(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("id", F.size("embedding").cast("long").alias("dim"), F.round(total, 6).alias("total"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@register("""
with c as (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 500 as chunk from orders)
select printf('%08d', chunk) as name, count(*) as rows, min(o_orderkey)::varchar as first, max(o_orderkey)::varchar as last, true as intact from c group by chunk
""")
def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the orders' package, each with its rows, ends, and whether its digest holds."""
    path = Scratch(spark, "package").path("orders")
    packages.write_package(load(spark, sf_dir, "orders"), "o_orderkey", path)
    return packages.package_files(spark, path).drop("sha256")


@register("select c_custkey, c_name, c_nationkey, round(c_acctbal, 2) as c_acctbal from customer")
def package_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer out of a package again."""
    path = Scratch(spark, "package").path("customers")
    packages.write_package(load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal"), "c_custkey", path)
    back = packages.read_package(spark, path, "c_custkey long, c_name string, c_nationkey long, c_acctbal double")
    return back.withColumn("c_acctbal", F.round("c_acctbal", 2))


def write_archives(df: DataFrame, path: str, rows: int = 2000) -> None:
    """ZIP archives of df (member, position, body, head, tail), about `rows` rows each: what the queries below read.

    A member is its rows' bodies in order of position between head and tail; all its rows are in one archive."""

    def write(table: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, lines in table.sort_values(["member", "position"]).groupby("member"):
                archive.writestr(str(name), lines["head"].iloc[0] + "".join(lines["body"]) + lines["tail"].iloc[0])
        name = f"{table['archive'].iloc[0]}.zip"
        places.write_all(f"{path}/{name}", out.getvalue())
        return pd.DataFrame({"name": [name]})

    places.made(path)
    files = max(1, -(-df.count() // rows))
    df.withColumn("archive", F.pmod(F.xxhash64("member"), F.lit(files))).groupBy("archive").applyInPandas(write, "name string").count()


@register("select s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) as s_acctbal from supplier")
def zip_xml_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier out of XML members of ZIP archives, parsed as they unpack."""
    path = Scratch(spark, "archives").path("suppliers")
    rows = load(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    safe = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tags = F.concat(*[F.concat(F.lit(f"<{c}>"), safe(c), F.lit(f"</{c}>")) for c in rows.columns])
    body = F.concat(F.lit("<organisation><data>"), tags, F.lit("</data></organisation>"))
    member = F.concat(F.lit("part-"), F.floor(F.col("s_suppkey") / 40).cast("string"), F.lit(".xml"))
    framed = {"member": member, "position": F.col("s_suppkey"), "body": body, "head": F.lit("<register>"), "tail": F.lit("</register>")}
    write_archives(rows.select(*[v.alias(k) for k, v in framed.items()]), path)
    archives.register(spark)
    back = spark.read.format("zip").option("element", "organisation").option("ending", ".xml").option("bytes", 4096).load(path)
    of = lambda c, kind: F.col("fields")[c].cast(kind).alias(c)
    return back.select(of("s_suppkey", "long"), of("s_name", "string"), of("s_nationkey", "long"), F.round(F.col("fields")["s_acctbal"].cast("double"), 2).alias("s_acctbal"))


@register(HTML_SQL)
def zip_html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the visible text of every page, out of HTML members of ZIP archives."""
    path = Scratch(spark, "archives").path("pages")
    rows = load(spark, sf_dir, "pages", "page_id", "html")
    member = F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html"))
    framed = {"member": member, "position": F.col("page_id"), "body": F.col("html"), "head": F.lit(""), "tail": F.lit("")}
    write_archives(rows.select(*[v.alias(k) for k, v in framed.items()]), path)
    archives.register(spark)
    back = spark.read.format("zip").option("ending", ".html").load(path)
    return back.select(F.regexp_extract("member", "([0-9]+)", 1).cast("long").alias("page_id"), F.sha1(html_text(F.col("text"))).alias("digest"))
