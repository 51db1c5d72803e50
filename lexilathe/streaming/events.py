"""Windows and sessions over an event log; the same functions serve tables and streams. An extension of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(user_id, start, n, total) of each user and hour. On a stream, events later than `late` are dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, n) of each user's runs of events less than `gap` apart. Events without a user or time are left
    out."""
    events = events.filter("user_id is not null and ts is not null")
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def ingest_once(spark: SparkSession, folder: str, schema: str, sink: str, checkpoint: str) -> None:
    """Appends what is new in a folder of JSON lines to a parquet table and stops; a further run goes on from there, so
    each file is taken once."""
    stream = spark.readStream.schema(schema).json(folder)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
