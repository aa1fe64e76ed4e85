"""Streams of recognition results: history tables and windowed confidence.

An extension: results arrive as files and are counted by engine and time as
they do, with late ones up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(history: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean confidence and number of results by engine and window; the same
    expression on a stream and on a table."""
    rows = history.withWatermark("ts", late) if history.isStreaming else history
    found = rows.groupBy(F.window("ts", width), "engine").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_conf"))
    return found.select(F.col("window.start").alias("window_start"), "engine", "n", "mean_conf")


def append(history: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that has arrived to ``path``, exactly once, and stop."""
    return history.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
