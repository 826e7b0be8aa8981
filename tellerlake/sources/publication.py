"""Serving copies of several tables that become visible together, or not at all.

All tables are written first. Their keys are then checked on what was written, and one manifest row names the whole set. A set with a missing or repeated
key is never committed: readers keep the last good one, and the report says why.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETS = "edition BIGINT, paths MAP<STRING, STRING>, committed_at TIMESTAMP"

#: What is served, and by which key (the customer first, so that one customer's rows lie together).
SERVED = {
    "customer_360": ("customer_id",),
    "customers": ("customer_id",),
    "customer_cases": ("customer_id", "complaint_id"),
    "call_transcripts": ("customer_id", "transcript_id"),
    "customer_products": ("customer_id", "product_id"),
    "interaction_history": ("customer_id", "interaction_id"),
    "customer_transactions": ("customer_id", "transaction_id"),
}


def key_check(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """One row: rows, rows with an incomplete key, and rows beyond the first of their key.

    Keys are counted by a 64-bit hash, so whole keys are not shuffled. Only if complete keys share a hash are those keys counted as they are."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    named = df.select(F.xxhash64(*keys).alias("_h"), missing.alias("_missing"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    hashes = named.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(~F.col("_missing"), 1)).alias("_whole"))
    found = hashes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_whole"), F.lit(0)).alias("whole"), F.coalesce(F.max("_whole"), F.lit(0)).alias("most")).first()
    if found["most"] > 1:
        shared = named.where(~F.col("_missing")).join(hashes.where("_whole > 1").select("_h"), "_h", "left_semi")
        counted = shared.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("_n"))
        repeated = counted.agg(F.sum(F.col("_n") - 1).alias("repeated_keys"))
    else:
        repeated = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("repeated_keys"))
    counts = [F.lit(v).cast("bigint").alias(c) for c, v in (("row_count", found["rows"]), ("incomplete_keys", found["rows"] - found["whole"]))]
    sound = (F.col("incomplete_keys") == 0) & (F.col("repeated_keys") == 0)
    return repeated.select(F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), *counts, "repeated_keys").withColumn("accepted", sound)


def editions(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(SETS).parquet(f"{root}/_editions")
    except AnalysisException:
        return spark.createDataFrame([], SETS)


def publish_set(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], root: str) -> tuple[int | None, DataFrame]:
    """Write and check every table; commit them as one edition if all keys are sound. Returns the edition (None: refused) and the report."""
    spark = next(iter(tables.values()))[0].sparkSession
    edition = editions(spark, root).agg(F.coalesce(F.max("edition"), F.lit(0))).first()[0] + 1
    paths, checks = {}, []
    for name, (df, keys) in tables.items():
        paths[name] = f"{root}/{name}/edition={edition:08d}"
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(paths[name])
        checks.append(key_check(spark.read.parquet(paths[name]), name, keys))
    report = reduce(DataFrame.unionByName, checks)
    report.withColumn("edition", F.lit(edition).cast("bigint")).write.mode("overwrite").parquet(f"{root}/_reports/edition={edition:08d}")
    report = spark.read.parquet(f"{root}/_reports/edition={edition:08d}")
    if not report.agg(F.bool_and("accepted")).first()[0]:
        return None, report
    row = spark.createDataFrame([(edition, paths)], "edition BIGINT, paths MAP<STRING, STRING>").withColumn("committed_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{root}/_editions")
    return edition, report


def read_published(spark: SparkSession, root: str, table: str, edition: int | None = None) -> DataFrame:
    """A table of the newest edition, or of the named one."""
    rows = editions(spark, root)
    wanted = rows.where(F.col("edition") == edition) if edition is not None else rows
    found = wanted.agg(F.max_by("paths", "edition")).first()[0]
    if found is None or table not in found:
        raise ValueError(f"No published edition {edition or ''} holds {table}")
    return spark.read.parquet(found[table])
