"""Reading the input tables: always through Spark, with only the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table `name` under `sf_dir`; zone-less timestamps become instants of the session's zone (UTC)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    zoneless = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(zoneless) if zoneless else df
