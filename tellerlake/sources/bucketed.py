"""Tables kept by key in buckets: a change writes only the buckets whose keys it brings.

A bucket is the hash of the key. Every change writes the new rows of its buckets into a folder of its own and then one manifest that names them; the
newest manifest entry of a bucket is valid. A change that is repeated under the same number finds the state from before it and replaces both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellerlake.operators.latest import keep_latest

BUCKETS = 256
ENTRIES = "bucket INT, path STRING"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def bucket_paths(spark: SparkSession, root: str, table: str, before: int | None = None) -> dict[int, str]:
    """The valid folder of every bucket, as of the changes before a number; no more entries than buckets."""
    try:
        entries = spark.read.schema(f"{ENTRIES}, change BIGINT").parquet(f"{root}/{table}/_manifest")
    except AnalysisException:
        return {}
    if before is not None:
        entries = entries.where(F.col("change") < before)
    return {r["bucket"]: r["path"] for r in entries.groupBy("bucket").agg(F.max_by("path", "change").alias("path")).collect()}


def read_buckets(spark: SparkSession, root: str, table: str) -> DataFrame:
    paths = bucket_paths(spark, root, table)
    if not paths:
        raise ValueError(f"Nothing is stored in {table}")
    return spark.read.option("mergeSchema", "true").parquet(*paths.values())


def merge_change(rows: DataFrame, root: str, table: str, keys: Sequence[str], order: Sequence[str], change: int, buckets: int = BUCKETS) -> list[int]:
    """Keep the newest version of every key, by `order`; returns the buckets that were written. `change` numbers grow; the number of buckets is fixed
    with the first change. Rows without a key are left out."""
    spark = rows.sparkSession
    touched = sorted(r[0] for r in rows.where(F.col(keys[0]).isNotNull()).select(bucket_of(keys, buckets)).distinct().collect())  # no more than buckets
    if not touched:
        return []
    held = bucket_paths(spark, root, table, change)
    paths = [held[b] for b in touched if b in held]
    if paths:
        rows = spark.read.option("mergeSchema", "true").parquet(*paths).unionByName(rows, allowMissingColumns=True)
    folder = f"{root}/{table}/change={change:010d}"
    newest = keep_latest(rows, list(keys), list(order)).withColumn("_bucket", bucket_of(keys, buckets))
    newest.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
    entries = spark.createDataFrame([(b, f"{folder}/_bucket={b}") for b in touched], ENTRIES)
    entries.coalesce(1).write.mode("overwrite").parquet(f"{root}/{table}/_manifest/change={change}")
    return touched
