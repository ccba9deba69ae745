"""Row numbers, so that a stage can name a row whose id is missing or repeated."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.sources.scratch import Scratch, setting


def spare(columns: list[str], *names: str) -> list[str]:
    """Each of `names`, lengthened by underscores until no column is called so in either case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that what is made of a batch's texts stays small beside the batch."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


#: Rows of a block: as many bits as one of Spark's bitmaps has.
BLOCK = 1 << 15
#: Lets a task write the files of so many buckets side by side, instead of sorting its rows, texts and all, by bucket; a task with
#: more blocks sorts the rest.
SIDE_BY_SIDE = ("spark.sql.maxConcurrentOutputFileWriters", "4")


def with_row(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """`docs` with a number for each row, written once so that every reader sees the same numbers; and the number's column.

    The rows are bucketed by blocks of neighbouring numbers, which one task writes, so that `without` moves numbers only. The
    last column is the block; `without` drops it."""
    spark = scratch.spark
    row, block = spare(docs.columns, "row", "block")
    numbered = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(block, _block(F.col(row)))
    name = f"numbered_rows_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with setting(spark, *SIDE_BY_SIDE):
        numbered.write.bucketBy(buckets, block).option("path", scratch.path(name)).mode("overwrite").saveAsTable(name)
    rows = spark.table(name)
    # The files stay; the frame knows them and their buckets without the catalogue's entry.
    spark.sql(f"drop table {name}")
    return rows, row


def _block(row: Column) -> Column:
    return F.shiftright(row, BLOCK.bit_length() - 1)


def without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows of `with_row` whose number is not in `gone` (row), without the number.

    The numbers that go are a bitmap for each block, and only those are shuffled, to the blocks' buckets; a task holds its
    buckets' bitmaps, never the rows."""
    block = rows.columns[-1]
    place = F.col("row").bitwiseAND(F.lit(BLOCK - 1))
    (bits,) = spare(rows.columns, "bits")
    maps = gone.groupBy(_block(F.col("row")).alias(block)).agg(F.bitmap_construct_agg(place).alias(bits)).hint("shuffle_hash")
    at = F.col(row).bitwiseAND(F.lit(BLOCK - 1))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.join(maps, block, "left").where(~F.coalesce(marked, F.lit(False))).drop(row, block, bits)
