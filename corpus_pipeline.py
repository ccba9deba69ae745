"""A corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) with docs as the stage before left it, works on all of it and returns a frame; all
stages but the last return the columns of documents. `run` applies them in order, each result written to the shared
folder and read again.

Rows are told apart by themselves, not by doc_id: ids may be missing or repeat, and each row is judged by its own text. A
null text counts as empty. Other columns are passed on whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.llm import exact, packing, quality, secretscan, simhash
from sparklode.sources import load
from sparklode.sources.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep. Null and empty texts fail the base rule; equal texts fare alike."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, a missing one being the smallest; of rows equal in both any one."""
    return exact.keep_largest(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the row with the smallest doc_id, a missing one being the largest; of equal ids one row.

    Texts without words have fingerprint 0 and so are one class."""
    return simhash.keep_one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew; null texts stay null, repeated rows are masked each."""
    masked = secretscan.mask_secrets(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return masked.withColumn("n_chars", F.length("text").cast(kind)) if kind else masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place. A null or empty text is one piece of one token; repeated rows
    are packed each."""
    return packing.best_fit_packing(docs, digest=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Posterior quality, fingerprints' components and tokenizers are beyond SQL; the tests hold `run` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
