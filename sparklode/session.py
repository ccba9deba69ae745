"""One place that knows how a session should be configured."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sparklode.sources.scratch import discard


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "sparklode", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and Arrow; on a cluster leave `master` to spark-submit."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def end(spark: SparkSession) -> None:
    """Delete the application's scratch tables and stop it."""
    discard(spark)
    spark.stop()
