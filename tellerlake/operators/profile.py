"""Column and label profiles with one scan per question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.operators.ordering import exact_percentiles
from tellerlake.operators.quality import count_if
from tellerlake.operators.running import attach_one_row

BANDS = {"<30": 30, "30-49": 50, "50-69": 70}


def label_profile(df: DataFrame, dimensions: dict[str, Column], label: str) -> DataFrame:
    """Rows, positives, missing labels and rate for every value of every dimension, long form, one scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in dimensions.items()]))
    return df.select(F.col(label).alias("_label"), pairs.alias("d")).groupBy("d.dimension", "d.value").agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("_label")).alias("positives"), count_if(F.col("_label").isNull()).alias("null_labels"),
    ).withColumn("rate", F.col("positives") / F.col("total"))


def melted_profile(df: DataFrame, features: Sequence[str], partition: str) -> DataFrame:
    """Feature buckets melted to (feature, bucket) and counted per partition."""
    long = df.select(partition, *[F.col(f).cast("string").alias(f) for f in features]).unpivot([partition], list(features), "feature", "bucket")
    return long.groupBy(partition, "feature", "bucket").agg(F.count(F.lit(1)).alias("n"))


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls and blanks per column with the share of rows; one wide aggregate, then one row per column."""
    aggs = [F.count(F.lit(1)).alias("total")]
    for c in columns:
        text = F.trim(F.col(c).cast("string"))
        aggs += [count_if(F.col(c).isNull()).alias(f"n_{c}"), count_if(text == "").alias(f"b_{c}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("nulls"), F.col(f"b_{c}").alias("blanks")) for c in columns])
    out = df.agg(*aggs).select(F.explode(rows).alias("r"), "total").select("r.*", "total")
    return out.withColumn("missing_pct", F.round((F.col("nulls") + F.col("blanks")) * 100.0 / F.greatest("total", F.lit(1)), 3))


def score_bands(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows and positives by score band, missing scores apart, in band order."""
    band = F.when(F.col(score).isNull(), "null")
    for name, below in BANDS.items():
        band = band.when(F.col(score) < below, name)
    order = {n: i for i, n in enumerate(["null", *BANDS, ">=70"])}
    key = F.lit(len(order))
    for n, i in order.items():
        key = F.when(F.col("band") == n, i).otherwise(key)
    return (df.groupBy(band.otherwise(">=70").alias("band")).agg(F.count(F.lit(1)).alias("total"), count_if(F.col(label)).alias("positives"))
            .withColumn("band_order", key))


def precision_at_thresholds(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Rows, positives and precision at or above each threshold; NULL precision without rows."""
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= t
        aggs += [count_if(hit).alias(f"n{i}"), count_if(hit & F.col(label)).alias(f"p{i}")]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("alerts"), F.col(f"p{i}").alias("tp")) for i, t in enumerate(thresholds)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "precision", F.when(F.col("alerts") > 0, F.col("tp") / F.col("alerts")))


def ratio_stats(df: DataFrame, keys: Sequence[str], ratio: Column) -> DataFrame:
    """Count, extremes, mean and non-positive values of a ratio per key."""
    return df.withColumn("_ratio", ratio).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count("_ratio").alias("known"), F.min("_ratio").alias("min_ratio"), F.max("_ratio").alias("max_ratio"),
        F.avg("_ratio").alias("avg_ratio"), count_if(F.col("_ratio") <= 0).alias("non_positive"))


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """An aggregate for export: fails, never truncates, when it has more than `limit` rows."""
    too_many = f"aggregate exceeds {limit} rows"
    head = df.limit(limit + 1)
    size = head.agg(F.count(F.lit(1)).alias("_size"))
    return attach_one_row(head, size).where(
        F.when(F.col("_size") > limit, F.raise_error(F.lit(too_many)).cast("boolean")).otherwise(F.lit(True))).drop("_size")


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become NULL, as JSON evidence requires."""
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def evidence_json(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    cols = [finite_or_null(F.col(c)).alias(c) if c in numeric else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("payload"))


def demand_baseline(interactions: DataFrame, reason: str) -> DataFrame:
    """Share of contacts, resolution, follow-up and handling time by reason; medians are exact."""
    total = interactions.agg(F.count(F.lit(1)).alias("_all"))
    base = interactions.groupBy(reason).agg(
        F.count(F.lit(1)).alias("contacts"), count_if(F.col("was_resolved")).alias("resolved"), count_if(F.col("requires_followup")).alias("follow_up"),
        F.sum("duration_seconds").alias("seconds"))
    measured = {"median_duration": "duration_seconds", "median_wait": "wait_time_seconds"}
    long = interactions.select(reason, F.explode(F.array(*[F.struct(F.lit(n).alias("_measure"), F.col(c).cast("double").alias("_value")) for n, c in measured.items()])).alias("_p")).select(reason, "_p.*")
    medians = exact_percentiles(long, [reason, "_measure"], "_value", {"_median": 0.5}).groupBy(F.col(reason).alias("_reason")).agg(
        *[F.max(F.when(F.col("_measure") == n, F.col("_median"))).alias(n) for n in measured])
    base = base.join(medians, F.col(reason).eqNullSafe(F.col("_reason")), "left").drop("_reason")
    return attach_one_row(base, total).select(
        reason, "contacts", (F.col("contacts") / F.col("_all")).alias("share"), (F.col("resolved") / F.col("contacts")).alias("resolved_rate"),
        (F.col("follow_up") / F.col("contacts")).alias("follow_up_rate"), "median_duration", "median_wait", (F.col("seconds") / 3600).alias("advisor_hours"))
