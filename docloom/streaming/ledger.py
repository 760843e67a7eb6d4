"""Structured Streaming over usage events; an extension, with batch semantics as its model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame) -> DataFrame:
    """A watermark needs a time with a zone; stored times are UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def deduped(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """First event of each key; state is held as long as events may be late."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def daily_usage(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def work_cycles(jobs: DataFrame, handle, checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Each micro-batch of jobs to ``handle``, which must be idempotent: a batch may come again after a failure."""
    return jobs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
