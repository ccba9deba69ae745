"""Live rooms over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.plans.registry import Registry
from sparklode.sources.scratch import Scratch
from sparklode.streaming import counters, duels

register = Registry()

#: What each kind of event stands for in a room of three users, two of whom can be its members.
ROOMS = [
    "user_id div 3 as room",
    "event_id",
    "user_id as player",
    "case event_type when 'view' then 'join' when 'error' then 'leave' when 'signup' then 'hello' when 'click' then 'emoji' else 'answer' end as kind",
    "cast(round(value) as long) as points",
    "ts",
]


def room_messages(spark: SparkSession, path: str, watermark: str, idle: int, cooldown: int) -> DataFrame:
    """All messages of the rooms of an event log, through the stream and its state, read from the sink's files."""
    setting, provider = duels.PROVIDER
    before = spark.conf.get(setting)
    spark.conf.set(setting, provider)
    try:
        scratch = Scratch(spark, "duels")
        events = counters.event_stream(spark, path, watermark=watermark).selectExpr(*ROOMS)
        stream = duels.duel_messages(events, idle=idle, cooldown=cooldown)
        counters.append_log(stream, scratch.path("result"), scratch.path("checkpoint"))
        return spark.read.schema(stream.schema).parquet(scratch.path("result"))
    finally:
        spark.conf.set(setting, before)


@register()
def duel_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rooms send, reactions at most every ten hours; held against a plain fold in the tests."""
    return room_messages(spark, f"{sf_dir}/events.parquet", "60 days", 40 * 24 * 3600, 36_000)


@register("""
with f as (select event_id, event_type, list_filter([case when value > 100 then 'value' end, case when user_id % 7 = 3 then 'user' end, case when event_type = 'error' and value < 10 then 'kind' end], lambda x: x is not null) as faults from events)
select event_id, event_type, array_to_string(faults, ',') as faults from f
""")
def stream_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a stream out of its log, or out of what the log refused with the names of the faults."""
    scratch = Scratch(spark, "event-log")
    faults = {"value": F.col("value") > 100, "user": F.col("user_id") % 7 == 3, "kind": (F.col("event_type") == "error") & (F.col("value") < 10)}
    counters.event_log(counters.event_stream(spark, f"{sf_dir}/events.parquet"), faults, scratch.path("log"), scratch.path("checkpoint"))
    kept = spark.read.parquet(scratch.path("log/events")).select("event_id", "event_type", F.lit("").alias("faults"))
    refused = spark.read.parquet(scratch.path("log/refused")).select("event_id", "event_type", F.array_join("faults", ",").alias("faults"))
    return kept.unionByName(refused)
