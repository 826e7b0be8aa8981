"""Structured Streaming jobs: corrections, windowed activity and per-batch quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellerlake.contract import Table
from tellerlake.operators.quality import count_if, quality_report
from tellerlake.sources.bucketed import BUCKETS, merge_change
from tellerlake.sources.versioned import append_report


def run_once(stream: DataFrame, write, checkpoint: str) -> None:
    """Process what is available in micro-batches, then stop; the checkpoint remembers what was read."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_corrections(stream: DataFrame, root: str, table: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = BUCKETS) -> None:
    """Keep the newest version of every key: late corrections win, exact resends and repeated batches change nothing, and only the buckets of the keys
    that arrive are written."""
    def write(batch: DataFrame, batch_id: int) -> None:
        merge_change(batch, root, table, keys, order, batch_id, buckets)
    run_once(stream, write, checkpoint)


def activity_windows(events: DataFrame, at: str, size: str, slide: str | None = None, keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """Tumbling or sliding counts; on a stream, rows later than the watermark `late` are dropped."""
    if late is not None:
        events = events.withWatermark(at, late)
    bucket = F.window(at, size, slide) if slide else F.window(at, size)
    return events.groupBy(bucket.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), count_if(F.col("event_type") == "Error").alias("errors")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events", "errors")


def activity_sessions(events: DataFrame, at: str, gap: str, keys: tuple[str, ...], late: str | None = None) -> DataFrame:
    """Sessions per key that end after `gap` without activity."""
    if late is not None:
        events = events.withWatermark(at, late)
    return events.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events")


def quality_per_batch(stream: DataFrame, table: Table, root: str, checkpoint: str) -> None:
    """The contract checks of every micro-batch in the report. A repeated batch replaces its own rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        report = quality_report(batch, table).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        append_report(report, root, f"{table.name}-{checkpoint.rstrip('/').rpartition('/')[2]}-{batch_id}")
    run_once(stream, write, checkpoint)


def replay(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
