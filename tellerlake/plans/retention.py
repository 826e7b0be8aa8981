"""Retention triage: seven signals per eligible customer, a priority band, and the dashboard's sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.operators.latest import newest_per_group, union_sections
from tellerlake.operators.quality import count_if
from tellerlake.operators.running import attach_one_row
from tellerlake.session import cut_lineage

# Fixed vocabulary of the rule set.
CANCEL_WORDS = "(cancel|cierre|encerr|close)"
SIGNALS = ("inactive", "declining", "unresolved", "repeated", "low_csat", "negative_sentiment", "cancellation")
BANDS = ("high", "medium", "watch", "none")
PER_GROUP = 15


def pseudonym(c: str) -> Column:
    """Stable 12-character reference that hides the identifier."""
    return F.substring(F.sha2(F.col(c), 256), 1, 12)


def recent_activity(transactions: DataFrame, as_of: DataFrame) -> DataFrame:
    """Transactions on days 0-29 and 30-59 before the anchor, and the newest one."""
    age = F.datediff("as_of", F.to_date("transaction_date"))
    past = attach_one_row(transactions.select("customer_id", "transaction_date"), as_of).where(F.to_date("transaction_date") <= F.col("as_of"))
    return past.groupBy("customer_id").agg(
        F.max("transaction_date").alias("last_tx"), count_if(age.between(0, 29)).alias("tx_30"), count_if(age.between(30, 59)).alias("tx_prev_30"))


def recent_contacts(interactions: DataFrame, as_of: DataFrame) -> DataFrame:
    day, scored = F.to_date("interaction_date"), F.col("csat").between(1, 5)
    cancel = F.lower("contact_reason").rlike(CANCEL_WORDS) & (F.col("was_resolved") == F.lit(False))
    window = attach_one_row(interactions, as_of).where((day >= F.date_sub("as_of", 89)) & (day <= F.col("as_of")))
    return window.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("contacts_90"), F.avg(F.when(scored, F.col("csat"))).alias("csat"), count_if(scored).alias("csat_n"),
        (F.sum("sentiment_score").cast("double") / F.count("sentiment_score")).alias("sentiment"), F.count("sentiment_score").alias("sentiment_n"),
        count_if(cancel).alias("cancellation_requests"))


def case_load(cases: DataFrame, as_of: DataFrame) -> DataFrame:
    """Cases open as of the anchor day and cases created in the last 90 days."""
    created, resolved = F.to_date("creation_date"), F.to_date("resolution_date")
    known = attach_one_row(cases, as_of).where(created <= F.col("as_of"))
    return known.groupBy("customer_id").agg(
        count_if(F.col("is_open") & (resolved.isNull() | (resolved > F.col("as_of")))).alias("open_cases"),
        count_if(created >= F.date_sub("as_of", 89)).alias("cases_90"))


COUNTS = ("tx_30", "tx_prev_30", "open_cases", "cases_90", "csat_n", "sentiment_n", "cancellation_requests")


def eligible(customers: DataFrame, transactions: DataFrame, interactions: DataFrame, cases: DataFrame) -> DataFrame:
    """Active customers with an active product; `customers` is the customer 360, whose as-of day is the anchor."""
    as_of = customers.agg(F.max("as_of_date").alias("as_of"))
    base = attach_one_row(customers.select("customer_id", "country", "segment", "registration_date", "customer_status", "products_active"), as_of).where(
        (F.col("customer_status") == "Active") & (F.col("products_active") > 0) & (F.to_date("registration_date") <= F.col("as_of")))
    joined = base
    for part in (recent_activity(transactions, as_of), recent_contacts(interactions, as_of), case_load(cases, as_of)):
        joined = joined.join(part, "customer_id", "left")
    return joined.select(
        "customer_id", F.coalesce("country", F.lit("Unknown")).alias("country"), F.coalesce("segment", F.lit("Unknown")).alias("segment"), "as_of",
        F.datediff("as_of", F.to_date("last_tx")).alias("inactive_days"), F.datediff("as_of", F.to_date("registration_date")).alias("tenure_days"),
        "csat", "sentiment", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def signal_flags() -> dict[str, Column]:
    c = F.col
    return {
        "inactive": (c("inactive_days") >= 60) & (c("tenure_days") >= 90),
        "declining": (c("tx_prev_30") >= 3) & (c("tx_30") <= c("tx_prev_30") * 0.5) & (c("tenure_days") >= 60),
        "unresolved": c("open_cases") >= 1,
        "repeated": c("cases_90") >= 2,
        "low_csat": (c("csat_n") >= 1) & (c("csat") <= 2),
        "negative_sentiment": (c("sentiment_n") >= 2) & (c("sentiment") < 0),
        "cancellation": c("cancellation_requests") >= 1,
    }


def banded(customers: DataFrame) -> DataFrame:
    """Signals as an ordered list of names, number of signal families, and the priority band."""
    flags = signal_flags()

    def family(*names: str) -> Column:
        hit = F.lit(False)
        for n in names:
            hit = hit | F.coalesce(flags[n], F.lit(False))
        return hit.cast("int")
    families = family("inactive", "declining") + family("unresolved", "repeated") + family("low_csat", "negative_sentiment") + family("cancellation")
    band = (F.when(F.coalesce(flags["cancellation"], F.lit(False)) | (F.col("families") >= 3), "high").when(F.col("families") >= 2, "medium")
            .when(F.col("families") == 1, "watch").otherwise("none"))
    return customers.withColumn("reasons", F.array_compact(F.array(*[F.when(flags[n], n) for n in SIGNALS]))).withColumn(
        "families", families).withColumn("band", band)


def shortlist(ranked: DataFrame, n: int = PER_GROUP) -> DataFrame:
    """The first `n` customers of every country and band with a signal."""
    order = [F.desc("families"), F.desc("open_cases"), F.asc("customer_id")]
    return newest_per_group(ranked.where("band <> 'none'"), ["country", "band"], order, n)


def breakdowns(ranked: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """The dashboard's sections with typed columns."""
    total = F.count(F.lit(1)).alias("total")

    def in_band(name: str) -> Column:
        return count_if(F.col("band") == name).alias(name)
    meta = attach_one_row(
        customers.agg(F.max("as_of_date").alias("as_of"), F.min("as_of_date").alias("min_as_of"), F.count(F.lit(1)).alias("total_customers")),
        ranked.agg(F.count(F.lit(1)).alias("eligible_customers"), count_if(F.col("inactive_days").isNull()).alias("activity_unknown")))
    return {
        "metadata": meta,
        "bands": ranked.groupBy("band").agg(total),
        "countries": ranked.groupBy("country").agg(total, *[in_band(x) for x in BANDS]),
        "segments": ranked.groupBy("segment").agg(total, in_band("high")),
        "signals": ranked.select(F.explode("reasons").alias("id")).groupBy("id").agg(total),
        "customers": shortlist(ranked).select(
            pseudonym("customer_id").alias("ref"), "country", "segment", "band", "reasons", "inactive_days", "tx_30", "tx_prev_30", "open_cases", "csat", "csat_n", "families"),
    }


def dashboard(ranked: DataFrame, customers: DataFrame) -> DataFrame:
    """One long result: section and JSON payload. The ranked customers are written once and read by every section."""
    ranked = cut_lineage(ranked)
    return union_sections({name: df.select(F.to_json(F.struct(*df.columns)).alias("payload")) for name, df in breakdowns(ranked, customers).items()})


def reconciliation(ranked: DataFrame, customers: DataFrame) -> DataFrame:
    """Every breakdown adds up to the eligible customers, groups are unique, caps hold."""
    ranked = cut_lineage(ranked)
    sections = breakdowns(ranked, customers)
    expected = ranked.agg(F.count(F.lit(1)).alias("expected"))
    checks = {f"{name}_total": sections[name].agg(F.coalesce(F.sum("total"), F.lit(0)).alias("actual")) for name in ("bands", "countries", "segments")}
    checks["country_bands"] = sections["countries"].agg(F.coalesce(F.sum(sum((F.col(x) for x in BANDS), F.lit(0))), F.lit(0)).alias("actual"))
    parts = {k: attach_one_row(df, expected).select("expected", "actual", (F.col("expected") == F.col("actual")).alias("passed")) for k, df in checks.items()}
    listed = sections["customers"].groupBy("country", "band").agg(F.count(F.lit(1)).alias("n"))
    parts["shortlist_cap"] = listed.agg(F.lit(PER_GROUP).cast("bigint").alias("expected"), F.max("n").alias("actual")).withColumn("passed", F.col("actual") <= F.col("expected"))
    refs = sections["customers"].agg(F.count("ref").alias("expected"), F.count_distinct("ref").alias("actual"))
    parts["unique_refs"] = refs.withColumn("passed", F.col("expected") == F.col("actual"))
    return union_sections(parts).withColumnRenamed("section", "check")
