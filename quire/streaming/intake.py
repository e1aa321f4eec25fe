"""Continuous intake: documents that land in a folder, and windows over events, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """Events and their values by type and window of time."""
    return sliding(events, width, width)


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    w = F.window("ts", width, step)
    return events.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Events by user and session; on a stream, sessions close when the watermark has passed."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def landing(spark: SparkSession, folder: str, schema: str, late: str = "1 day", files: int = 100) -> DataFrame:
    """A stream of the documents in a folder, each content once within ``late`` of its arrival (column loaded_at)."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return docs.withColumn("sha256", F.sha2("text", 256)).withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["sha256"])


def run(stream: DataFrame, out: str, state: str, check) -> None:
    """Runs a check that works on each document alone over what has landed, and stops; a later call goes on from there.

    ``out`` and ``state`` are folders that all executors share.
    """
    q = check(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
