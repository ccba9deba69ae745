"""Vectors as raw 32-bit floats beside a JSON file of ids, read by ranges of rows and written by tasks.

`spark.read.format("vectors").load(path)` reads the pairs `name.f32` (rows x dim floats, little-endian) and `name.meta.json`
({"dim": n, "ids": [...]}) of a folder, as (id long, embedding array<float>). A partition is a range of at most `rows` rows of
one file: it opens the file, seeks to its first row and streams, so a large file is read by many tasks, and no task holds
more than a batch. A file whose length doesn't agree with its ids is an error that names it.
`df.write.format("vectors").mode("overwrite").save(path)` writes a pair for every `rows` rows of a partition of (id, embedding);
they are seen once the job is committed. A null vector or one of another length than the first is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition
from pyspark.sql.types import Row, StructType

from sparklode.sources import places
from sparklode.sources.committed import Staged, Written

SCHEMA = "id bigint, embedding array<float>"
ROWS, BATCH = 50_000, 4096
FLOATS, META = ".f32", ".meta.json"


@dataclass
class Range(InputPartition):
    """Rows first to last of one file, and their ids."""

    path: str
    dim: int
    first: int
    ids: list[int]


class VectorReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))

    def partitions(self) -> list[Range]:
        out = []
        for meta in places.listed(self.path, META):
            head = json.loads(places.read_all(meta))
            name, ids = meta.removesuffix(META), head["ids"]
            store, place = places.opened(name + FLOATS)
            if store.get_file_info(place).size != 4 * head["dim"] * len(ids):
                raise ValueError(f"{name}{FLOATS} doesn't hold {len(ids)} vectors of {head['dim']} floats")
            out += [Range(name + FLOATS, head["dim"], k, ids[k : k + self.rows]) for k in range(0, len(ids), self.rows)]
        return out or [Range("", 0, 0, [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.ids:
            return
        store, place = places.opened(partition.path)
        width = 4 * partition.dim
        with store.open_input_file(place) as stream:
            stream.seek(partition.first * width)
            for k in range(0, len(partition.ids), BATCH):
                ids = partition.ids[k : k + BATCH]
                values = np.frombuffer(stream.read(len(ids) * width), "<f4")
                starts = np.arange(0, len(values) + 1, max(1, partition.dim), dtype=np.int32)[: len(ids) + 1]
                listed = pa.ListArray.from_arrays(pa.array(starts), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), listed], names=["id", "embedding"])


class VectorWriter(Staged, DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.rows = int(options.get("rows", ROWS))

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = self.begin()
        files: list[dict] = []
        ids: list[int] = []
        vectors: list[list[float]] = []

        def flush() -> None:
            name = f"{folder.rsplit('/', 1)[1]}-{len(files):05d}"
            values = np.array(vectors, "<f4")
            if values.ndim != 2:
                raise ValueError("vectors of different lengths")
            places.write_all(f"{folder}/{name}{FLOATS}", values.tobytes())
            places.write_all(f"{folder}/{name}{META}", json.dumps({"dim": values.shape[1], "ids": ids}).encode())
            files.append({"name": name, "at": f"{folder}/{name}", "endings": [FLOATS, META], "rows": len(ids)})
            ids.clear()
            vectors.clear()

        for row in iterator:
            if row["id"] is None or row["embedding"] is None or None in row["embedding"]:
                raise ValueError("a vector file holds neither null ids nor null vectors")
            ids.append(row["id"])
            vectors.append(row["embedding"])
            if len(ids) == self.rows:
                flush()
        if ids:
            flush()
        return Written(files)


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFiles)
