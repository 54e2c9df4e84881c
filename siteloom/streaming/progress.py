"""Progress events: windowed counts in batch and as a stream with a watermark, sessions, and a server-sent-event sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """``start, event_type, events, value_sum``: tumbling windows over ``ts``."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value_sum")).select(F.col("w.start").alias("start"), "event_type", "events", "value_sum")


def stream_window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The same over a stream; events later than ``late`` behind the newest are dropped by the watermark.

    Watermarks need instants: times without a zone are read in the session's zone, and written back without one.
    """
    plain = dict(events.dtypes)["ts"] == "timestamp_ntz"
    counts = window_counts(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz")) if plain else counts


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """``user_id, start, events``: sessions of a user, closed by a gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


def read(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def sse(event: dict) -> str:
    """One event as a server-sent event."""
    import json

    return f"data: {json.dumps(event, default=str)}\n\n"


def latest_log(events: DataFrame, n: int = 200) -> DataFrame:
    """The newest ``n`` events: a bounded log."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
