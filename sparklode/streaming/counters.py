"""Streaming counterparts of the activity operators over an append-only event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from sparklode.sources.kept import Folder

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, watermark: str = "10 minutes") -> DataFrame:
    """The event log, a folder of files or a single file, as a stream with event time and a watermark."""
    place = path if path.endswith("/") else f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file is accepted too
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(place)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def counters(events: DataFrame) -> DataFrame:
    """Running counters per item; update mode sends only the items that changed."""
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    return events.groupBy((F.col("user_id") % 10).alias("item")).agg(
        F.count("*").alias("shown"), is_("purchase").alias("correct"), is_("error").alias("wrong"), F.sum(F.round(F.col("value") * 10).cast("long")).alias("total_ms")
    )


def quota(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Distinct items per subject and tumbling window."""
    return events.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.size(F.collect_set(F.round("value").cast("long"))).alias("items"))


def failures(events: DataFrame, gap: str = "24 hours") -> DataFrame:
    """Failures per subject while none of the gaps is longer than `gap`; each failure extends the window."""
    bad = events.where("event_type = 'error'")
    return bad.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("failures"))


def without_repeats(events: DataFrame, seconds: float) -> DataFrame:
    """(user_id, event_type, event_id, stored): an event is stored unless it is within `seconds` of the last stored one.

    The state of a key is one number, its last stored time, and is dropped once the watermark is a day past its last event.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (anchor,) = state.get if state.exists else (float("-inf"),)
        found = pd.concat(list(rows), ignore_index=True).sort_values(["t", "event_id"])
        stored = []
        for t in found["t"]:
            fresh = t - anchor > seconds
            anchor = t if fresh else anchor
            stored.append(fresh)
        state.update((float(anchor),))
        state.setTimeoutTimestamp(max(int(found["t"].iloc[-1] * 1000) + 24 * 3600 * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_type": key[1], "event_id": found["event_id"], "stored": stored})

    slim = events.select("user_id", "event_type", "event_id", "ts", F.col("ts").cast("double").alias("t"))
    return slim.groupBy("user_id", "event_type").applyInPandasWithState(
        step, "user_id long, event_type string, event_id long, stored boolean", "anchor double", "append", GroupStateTimeout.EventTimeTimeout
    )


def latest_result(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The whole result after each batch, in a folder of the batch's number that is renamed into place once whole; the one before stays,
    for readers that have begun, and older ones go. A batch that runs again leaves what it wrote before."""

    def keep(rows: DataFrame, batch: int) -> None:
        store = Folder(rows.sparkSession, path)
        rows.write.mode("overwrite").parquet(f"{path}/_building-{batch}")
        store.renamed(f"_building-{batch}", f"batch-{batch:012d}")
        store.prune(2, f"batch-{batch:012d}")

    query = stream.writeStream.outputMode("complete").foreachBatch(keep)
    query = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest whole result; nothing before the first."""
    names = Folder(spark, path).names()
    return spark.read.schema(schema).parquet(f"{path}/{max(names)}") if names else spark.createDataFrame([], schema)


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only Parquet sink, exactly once with its checkpoint."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def event_log(stream: DataFrame, faults: dict[str, Column], path: str, checkpoint: str) -> StreamingQuery:
    """An append-only log that no event can stop: rows with a fault go to `path`/refused with the names of their faults, all others to
    `path`/events.

    `faults` are conditions by name; one that can't be told is none. Each batch writes folders of its own number, so a batch that runs
    again replaces what it wrote. A batch that can't be written is reported in `path`/failed and the stream goes on.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        named = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in faults.items()]))
        marked = rows.withColumn("faults", named)
        try:
            marked.where(F.size("faults") == 0).drop("faults").write.mode("overwrite").parquet(f"{path}/events/batch={batch}")
            marked.where(F.size("faults") > 0).write.mode("overwrite").parquet(f"{path}/refused/batch={batch}")
        except Exception as error:  # an event log must not stop what it records
            told = rows.sparkSession.createDataFrame([(batch, type(error).__name__)], "batch long, error string")
            told.write.mode("overwrite").parquet(f"{path}/failed/batch={batch}")

    query = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
