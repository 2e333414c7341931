"""Windowed counts of events, the same for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows of ``ts``; events later than the watermark are left out of streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    start = F.col("w.start") if events.isStreaming else F.col("w.start").cast("timestamp_ntz")
    return out.select(start.alias("start"), "event_type", "n", "total")


def stream_events(spark: SparkSession, folder: str, schema, checkpoint: str, sink: str) -> None:
    """Reads new parquet files of a folder until none is left and writes closed windows to ``sink``."""
    source = spark.readStream.schema(schema).parquet(folder)
    query = event_counts(source).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
