"""Intermediate tables in the folder that driver and executors share.

A written table cuts the lineage: a lost executor costs a re-read, not a recomputation, and no block lives only on
one machine. The folder is `spark.checkpoint.dir`; only where the session has none (tests) is one made. All tables of an
application lie in one folder below it, which `discard` deletes when nothing will read them again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: The temporary folders made here, by application; the setting itself can't be changed in a running session.
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on a single local machine without one, a fresh temporary folder."""
    found = spark.conf.get(SETTING, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _made:
        _made[application] = "file://" + tempfile.mkdtemp(prefix="sparklode-")
    return _made[application]


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sparklode-{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; frames that still read them can't be used afterwards."""
    _delete(spark, application_dir(spark))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting for what is written inside; afterwards it is as before."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Named intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, operator: str) -> None:
        self.spark = spark
        self.root = f"{application_dir(spark)}/{operator}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and return a reader of what was written."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        for name in names:
            _delete(self.spark, self.path(name))
