"""Versioned Parquet tables: a data folder per version, and a manifest row written last that makes it visible."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version BIGINT, path STRING, committed_at TIMESTAMP"


def _manifest_path(root: str, table: str) -> str:
    return f"{root}/{table}/_versions"


def manifest(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Committed versions; empty for a table that was never written."""
    try:
        return spark.read.schema(MANIFEST).parquet(_manifest_path(root, table))
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def latest_version(spark: SparkSession, root: str, table: str) -> int:
    """0 when nothing is committed."""
    return manifest(spark, root, table).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def write_version(df: DataFrame, root: str, table: str) -> int:
    """Write a new version and commit it. A failed write leaves the last good version current."""
    spark = df.sparkSession
    version = latest_version(spark, root, table) + 1
    path = f"{root}/{table}/v{version:08d}"
    df.write.mode("overwrite").parquet(path)
    row = spark.createDataFrame([(version, path)], "version BIGINT, path STRING").withColumn("committed_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(_manifest_path(root, table))
    return version


def read_version(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """The named version, or the newest one."""
    rows = manifest(spark, root, table)
    wanted = rows.where(F.col("version") == version) if version is not None else rows
    found = wanted.agg(F.max_by("path", "version")).first()[0]
    if found is None:
        raise ValueError(f"No committed version {version or ''} of {table}")
    return spark.read.parquet(found)


def append_report(report: DataFrame, root: str, run: str | None = None) -> None:
    """Add the rows of one run; a run of the same name replaces its rows."""
    report.withColumn("run_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{root}/_dq_report/_run={run or uuid.uuid4().hex}")


def read_report(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/_dq_report").drop("_run")


def publish(df: DataFrame, root: str, table: str, keys: Sequence[str]) -> int:
    """Serving copy in key order. Ranges cover all key columns, so one customer's rows may span several files."""
    return write_version(df.repartitionByRange(*keys).sortWithinPartitions(*keys), root, table)
