"""Built tables that are kept until their source changes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.sources.scratch import shared_dir


def data_fingerprint(df: DataFrame, key: str, stamp: str) -> str:
    """Number of rows, sum of keys and latest stamp: one aggregation that reads two columns."""
    n, total, last = df.agg(F.count("*"), F.coalesce(F.sum(key), F.lit(0)), F.coalesce(F.max(stamp).cast("string"), F.lit(""))).first()
    return f"{n}-{total}-{last}"


def kept(spark: SparkSession, name: str, version: int, fingerprint: str, build: Callable[[], DataFrame], root: str | None = None, order: Sequence[str] = (), builds: int = 2) -> tuple[DataFrame, bool]:
    """The table built from data of this fingerprint, and whether it had to be built.

    A table's folder is named after version and fingerprint. It is written aside and renamed once whole, so a folder of that name is
    complete; of two builders the first wins, and both read its table. The `builds` newest tables of a name stay, that readers of
    an older one may end; the others go when a new one is built.
    """
    digest = hashlib.md5(f"{version}:{fingerprint}".encode(), usedforsecurity=False).hexdigest()
    folder = f"{root or shared_dir(spark)}/kept-{name}"
    store = Folder(spark, folder)
    path = f"{folder}/{digest}"
    if store.holds(digest):
        return spark.read.parquet(path), False
    made, aside = build(), f"_building-{uuid.uuid4().hex}"
    (made.repartitionByRange(*order).sortWithinPartitions(*order) if order else made).write.parquet(f"{folder}/{aside}")
    won = store.renamed(aside, digest)
    store.prune(builds, digest)
    return spark.read.parquet(path), won


class Folder:
    """The folder of a name's builds, through the file system that its path names."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.folder = folder
        self.store = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def holds(self, name: str) -> bool:
        return self.store.exists(self._path(f"{name}/_SUCCESS"))

    def renamed(self, aside: str, name: str) -> bool:
        """Whether the folder `aside` became `name`; where another build was there first, it goes."""
        if not self.store.exists(self._path(name)) and self.store.rename(self._path(aside), self._path(name)):
            return True
        self.store.delete(self._path(aside), True)
        return False

    def names(self) -> list[str]:
        """The finished folders; none if there is no such place."""
        here = self._path("")
        found = self.store.listStatus(here) if self.store.exists(here) else []
        return [s.getPath().getName() for s in found if s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]

    def prune(self, builds: int, mine: str) -> None:
        """Delete all but `mine` and the newest others, `builds` in all; folders still being built are not builds."""
        others = [(s.getModificationTime(), s.getPath().getName()) for s in self.store.listStatus(self._path("")) if s.isDirectory()]
        done = sorted((t, n) for t, n in others if n != mine and not n.startswith("_"))
        for _, name in done[: max(0, len(done) - (builds - 1))]:
            self.store.delete(self._path(name), True)
