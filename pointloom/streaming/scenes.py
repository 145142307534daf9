"""Scenes that arrive as files: an extension beyond batch processing, made of Spark's file stream.

Every micro-batch runs the batch operators on the new scenes and appends their instance metrics, or keeps counts by
event-time window with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, schema, batch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs batch() on each new file's rows; a batch that is repeated after a failure overwrites its own folder only."""

    def write(rows: DataFrame, epoch: int) -> None:
        batch(rows).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by tumbling event-time window and key, for streams and tables alike."""
    watched = events.withWatermark(time, late) if events.isStreaming else events
    return watched.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
