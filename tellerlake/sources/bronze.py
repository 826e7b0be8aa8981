"""Raw CSV deliveries: reading, routing, and incremental ingestion into all-text bronze tables."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BOM = "\ufeff"


def csv_options(reader):
    """Header, quoted line breaks, doubled quotes, UTF-8, and delivery folders that never become columns."""
    return (reader.option("header", "true").option("multiLine", "true").option("escape", '"').option("encoding", "UTF-8")
            .option("recursiveFileLookup", "true"))


def strip_bom(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c.lstrip(BOM).strip()) for c in df.columns])


def with_lineage(df: DataFrame) -> DataFrame:
    """Where each row came from and when it arrived; call it on a file scan."""
    return df.select("*", F.col("_metadata.file_path").alias("_source_file"), F.current_timestamp().alias("_ingested_at"))


def read_raw_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Every column as text, with lineage; files share one header."""
    scan = with_lineage(csv_options(spark.read).csv(path))
    return strip_bom(scan)


def file_list(spark: SparkSession, landing: str) -> DataFrame:
    """(path, length) of everything under `landing`; file contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landing).select("path", "length"))


def route(files: DataFrame, root: str, tables: Sequence[str]) -> DataFrame:
    """Table of each CSV file: its first folder below `root`, or its own name; others are left out."""
    relative = F.regexp_extract("path", rf"{root.rstrip('/')}/(.+\.csv)$", 1)
    table = F.regexp_replace(F.substring_index("relative", "/", 1), r"\.csv$", "")
    return files.withColumn("relative", relative).where("relative <> ''").withColumn("table", table).where(F.col("table").isin(*tables))


def to_copy(routed: DataFrame, done: DataFrame) -> DataFrame:
    """Files that are new or whose size changed since they were recorded in `done` (relative, length)."""
    return routed.join(done.select("relative", "length"), ["relative", "length"], "left_anti")


def files_per_table(routed: DataFrame, tables: Sequence[str]) -> DataFrame:
    """File counts for every wanted table; tables without files are skipped by the caller."""
    counts = routed.groupBy("table").agg(F.count(F.lit(1)).alias("files"))
    wanted = routed.sparkSession.createDataFrame([(t,) for t in tables], "table string")
    return wanted.join(counts, "table", "left").select("table", F.coalesce("files", F.lit(0)).alias("files"))


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Paths by header line. `paths` is one micro-batch of files, bounded by `max_files` of the stream."""
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                                                F.monotonically_increasing_id().alias("i")).where("start = 0")
    first = lines.groupBy("path").agg(F.min_by("value", "i").alias("header"))
    grouped = first.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    return {r["header"]: r["paths"] for r in grouped}


def read_mixed_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One frame over files with different columns: a column a file lacks is NULL there."""
    parts = []
    for header, group in headers(spark, paths).items():
        names = [n.strip() for n in next(csv.reader([header.lstrip(BOM)]))]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        parts.append(with_lineage(csv_options(spark.read).schema(schema).csv(group)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, max_files: int = 1000) -> None:
    """Append the files not seen before, then stop. A retried batch overwrites its own folder, so no row doubles."""
    def write(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # at most max_files names
        if paths:
            read_mixed_headers(batch.sparkSession, paths).write.mode("overwrite").parquet(f"{target}/_batch={batch_id}")

    files = (spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
             .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", max_files).load(landing).select("path"))
    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_bronze(spark: SparkSession, target: str) -> DataFrame:
    """All batches; a column that appeared later is NULL in earlier ones."""
    return spark.read.option("mergeSchema", "true").parquet(target).drop("_batch")


def generation(root: str, table: str, number: int) -> tuple[str, str]:
    """(target, checkpoint) of a rebuild: a reset starts a new pair and never edits the old one."""
    return f"{root}/{table}/g{number:04d}/data", f"{root}/{table}/g{number:04d}/checkpoint"
