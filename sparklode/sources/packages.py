"""Packages: rows in order as JSON lines, so many a file, with a manifest of digests.

`write_package(df, "id", path)` numbers the rows by key over the whole table, deals them out by file and writes each file in one
task, in order. Files and manifest (name, rows, first and last key, SHA-256) are seen only after the job's commit. A row is one
object with its columns in their order, dates and times in ISO form, without nulls' columns being dropped.
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter
from pyspark.sql.types import Row, StructType

from sparklode.operators.ranking import places as numbered
from sparklode.sources import places
from sparklode.sources.committed import Staged, Written, manifest

CHUNK = 500
PART = "chunk"


def plain(value):
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat()
    return str(value) if isinstance(value, decimal.Decimal) else value


class PackageWriter(Staged, DataSourceWriter):
    """Writes rows that come sorted by PART; a part's rows are all in one task."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.key = options["key"]

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = self.begin()
        files: list[dict] = []
        part, lines, keys = None, [], []

        def flush() -> None:
            name, body = f"{part:08d}", "".join(lines).encode()
            places.write_all(f"{folder}/{name}.jsonl", body)
            said = {"rows": len(lines), "first": keys[0], "last": keys[-1], "sha256": hashlib.sha256(body).hexdigest()}
            files.append({"name": name, "at": f"{folder}/{name}", "endings": [".jsonl"]} | said)
            lines.clear()
            keys.clear()

        for row in iterator:
            if row[PART] != part and lines:
                flush()
            part = row[PART]
            columns = row.asDict()
            keys.append(plain(columns[self.key]))
            lines.append(json.dumps({k: plain(v) for k, v in columns.items() if k != PART}, ensure_ascii=False) + "\n")
        if lines:
            flush()
        return Written(files)


class Packages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "package"

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options, overwrite)


def write_package(df: DataFrame, key: str, path: str, chunk: int = CHUNK) -> None:
    """Write `df` in order of `key`, which is unique and not null, as a package; an older one at `path` is replaced."""
    df.sparkSession.dataSource.register(Packages)
    rows = numbered(df, [F.asc(key)]).withColumn(PART, F.floor((F.col("place") - 1) / chunk))
    rows = rows.repartition(PART).sortWithinPartitions(PART, "place").drop("place")
    rows.write.format("package").mode("overwrite").option("key", key).save(path)


def package_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows, first, last, sha256, intact): the manifest's files, and whether each still has its digest."""
    said = [(f["name"], f["rows"], str(f["first"]), str(f["last"]), f["sha256"]) for f in manifest(path)]
    listed = spark.createDataFrame(said, "name string, rows long, first string, last string, sha256 string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path)
    found = files.select(F.regexp_extract("path", r"([^/]*)\.jsonl$", 1).alias("name"), F.sha2("content", 256).alias("now"))
    return listed.join(found, "name", "left").select(*listed.columns, F.coalesce(F.col("now") == F.col("sha256"), F.lit(False)).alias("intact"))


def read_package(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a finished package; an unfinished one has none."""
    files = [f"{path.rstrip('/')}/{f['name']}.jsonl" for f in manifest(path)]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
