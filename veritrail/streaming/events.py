"""Structured Streaming over an event table (an extension: the engine's own queries are batch).

Windows are counted with a watermark; the state of a window goes once it is
past it, so memory follows the watermark and not the length of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Reads new Parquet files of a folder or glob as they come; the schema is that of the files there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and value sums per window and type."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = e.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total_value")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Works off what is there and stops; the result is the in-memory table ``name`` for small aggregates."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
