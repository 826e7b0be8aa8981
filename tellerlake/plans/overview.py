"""Fraud overview: five one-dimension breakdowns and the total in a single pass, and its reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.operators.quality import count_if
from tellerlake.operators.running import attach_one_row

DIMENSIONS = {"country": "countries", "channel": "channels", "type": "types", "currency": "currencies", "month": "monthly"}


def overview(transactions: DataFrame, end_exclusive: str) -> DataFrame:
    """One scan; partial aggregation leaves few rows per set to shuffle, however skewed a dimension is."""
    currency, amount, usd = F.col("currency"), F.col("amount"), F.col("amount_usd")
    base = transactions.where(F.col("transaction_date") < F.lit(end_exclusive).cast("timestamp_ntz")).select(
        "transaction_id", "transaction_date", "is_fraud", F.col("transaction_country").alias("country"), "channel", F.col("transaction_type").alias("type"),
        "currency", F.date_format("transaction_date", "yyyy-MM").alias("month"), "merchant_category", "amount_usd",
        F.when(currency == "USD", amount).otherwise(usd).alias("normalized_amount"))

    def null(c: str) -> Column:
        return count_if(F.col(c).isNull())
    names = list(DIMENSIONS)
    out = base.groupingSets([[F.col(n)] for n in names] + [[]], *names).agg(
        F.grouping_id(*names).alias("_set"), F.count(F.lit(1)).alias("total"), count_if(F.col("is_fraud")).alias("fraud"), null("transaction_id").alias("null_ids"),
        null("is_fraud").alias("null_labels"), null("merchant_category").alias("merchant_missing"), null("amount_usd").alias("usd_missing"),
        null("normalized_amount").alias("normalized_missing"), F.min("transaction_date").alias("min_date"), F.max("transaction_date").alias("max_date"))
    # grouping_id has one bit per column, first column highest, set when the column is rolled up.
    everything = (1 << len(names)) - 1
    section = F.lit("summary")
    for i, n in enumerate(names):
        section = F.when(F.col("_set") == everything - (1 << (len(names) - 1 - i)), DIMENSIONS[n]).otherwise(section)
    return out.select(section.alias("section"), F.coalesce(*names, F.lit("Unknown")).alias("label"),
                      *[c for c in out.columns if c not in (*names, "_set")])


def reconciliation(rows: DataFrame) -> DataFrame:
    """Every section's total and fraud equal the summary's, and nothing is missing more often than it occurs."""
    summary = rows.where("section = 'summary'").select(F.col("total").alias("all_rows"), F.col("fraud").alias("all_fraud"))
    per = rows.where("section <> 'summary'").groupBy("section").agg(F.sum("total").alias("total"), F.sum("fraud").alias("fraud"), F.count_distinct("label").alias("labels"),
                                                                    F.count(F.lit(1)).alias("groups"))
    return attach_one_row(per, summary).withColumn(
        "passed", (F.col("total") == F.col("all_rows")) & (F.col("fraud") == F.col("all_fraud")) & (F.col("labels") == F.col("groups")))
