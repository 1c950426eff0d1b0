"""Streaming: windowed counts, totals and sessions over the event table as a stream.

The engine's own language has no streams; these are the same aggregations as batch
queries, run as Structured Streaming queries that end when their input is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siskin.operators.graph import shared_dir


def _timed(events: DataFrame, late: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window of their time and type; works on streams and on tables."""
    grouped = _timed(events, late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def totals(events: DataFrame) -> DataFrame:
    """Events of each user, their first and last time; the state is a row a user."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events with less than the gap between neighbours, as one session."""
    grouped = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The files at path, a folder or one file, as a stream."""
    # a stream's path is a folder or a pattern; this pattern fits the path alone
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def completed(stream: DataFrame) -> DataFrame:
    """The whole result of an aggregated stream once all input is read, written to the shared folder.

    Each batch replaces the result before it; the query's state and progress are kept
    beside it, so a restarted query goes on where it stopped.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/siskin-stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    query = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
