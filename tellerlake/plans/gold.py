"""The gold products of the bank: transactions, products, cases, interactions, customer 360, contact reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.functions.calendar import age_years
from tellerlake.functions.money import is_credit, is_delinquent, usd_backfill, utilisation
from tellerlake.operators.latest import keep_latest
from tellerlake.operators.quality import count_if
from tellerlake.operators.running import attach_one_row, sized

OPEN_STATUSES = ("Open", "In Process", "Escalated")
NINETY_DAYS = 90
#: Up to so many rates (three narrow columns) are broadcast, by count.
RATES = 500_000


def last4(c: str) -> Column:
    return F.right(F.col(c), F.lit(4))


def as_of_date(transactions: DataFrame) -> DataFrame:
    """One row: the latest transaction day, the anchor of every relative window."""
    return transactions.agg(F.to_date(F.max("transaction_date")).alias("as_of"))


def usd_transactions(transactions: DataFrame, rates: DataFrame, rate_lag_days: int = 0) -> DataFrame:
    """Transactions with a USD amount; the closing rate of the day, or `rate_lag_days` earlier."""
    usd = rates.where(F.col("target_currency") == "USD").select(
        F.date_add("date", rate_lag_days).alias("_rate_day"), F.col("source_currency").alias("currency"), "exchange_rate")
    tx = transactions.withColumn("_rate_day", F.to_date("transaction_date"))
    joined = tx.join(sized(usd, RATES), ["_rate_day", "currency"], "left")
    return joined.withColumn("amount_usd_is_derived", F.col("amount_usd").isNull()).withColumn(
        "amount_usd", usd_backfill(F.col("amount"), F.col("currency"), F.col("amount_usd"), F.col("exchange_rate"))).drop("_rate_day", "exchange_rate")


def customer_transactions(transactions: DataFrame, products: DataFrame, rates: DataFrame, rate_lag_days: int = 0) -> DataFrame:
    """Transactions with product type and a USD amount."""
    return usd_transactions(transactions, rates, rate_lag_days).join(products.select("product_id", "product_type"), "product_id", "left")


def active_products(products: DataFrame) -> DataFrame:
    return products.groupBy("customer_id").agg(count_if(F.col("product_status") == "Active").alias("products_active"))


def latest_rates(rates: DataFrame) -> DataFrame:
    usd = rates.where(F.col("target_currency") == "USD").select("source_currency", "date", "exchange_rate")
    return keep_latest(usd, ["source_currency"], ["date"]).select(F.col("source_currency").alias("currency"), "exchange_rate")


def customer_products(products: DataFrame, rates: DataFrame) -> DataFrame:
    usd = F.when(F.col("currency") == "USD", F.col("current_balance")).otherwise(F.round(F.col("current_balance") * F.col("exchange_rate"), 2))
    return (products.join(sized(latest_rates(rates), RATES), "currency", "left")
            .withColumn("is_credit_product", is_credit(F.col("product_type")))
            .withColumn("product_number_last4", last4("product_number"))
            .withColumn("current_balance_usd", usd.cast("decimal(18,2)"))
            .withColumn("credit_utilization", utilisation(F.col("current_balance"), F.col("credit_limit")))
            .withColumn("is_delinquent", is_delinquent(F.col("days_past_due"))).drop("exchange_rate", "product_number"))


def customer_cases(complaints: DataFrame, as_of: DataFrame) -> DataFrame:
    until = F.coalesce(F.to_date("resolution_date"), F.col("as_of"))
    return (attach_one_row(complaints, as_of).withColumn("is_open", F.col("status").isin(*OPEN_STATUSES))
            .withColumn("age_days", F.datediff(until, F.to_date("creation_date"))).drop("as_of"))


def survey_pivot(surveys: DataFrame) -> DataFrame:
    """Newest CSAT, NPS and comment per interaction; the survey id settles equal times."""
    newest = F.struct("survey_date", "survey_id")

    def latest(c: str, kind: str | None = None) -> Column:
        return F.max_by(c, newest if kind is None else F.when(F.col("survey_type") == kind, newest))
    return surveys.where("interaction_id IS NOT NULL").groupBy("interaction_id").agg(
        latest("main_score", "CSAT").alias("csat"), latest("main_score", "NPS").alias("nps"), latest("open_comments").alias("survey_comment"))


def latest_transcripts(transcripts: DataFrame) -> DataFrame:
    """The newest transcript of each interaction. Only keys are compared; a text meets its interaction after that, so no row without one is moved for it."""
    known = transcripts.where("interaction_id IS NOT NULL")
    newest = known.groupBy("interaction_id").agg(F.max_by("transcript_id", F.struct("process_date", "transcript_id")).alias("transcript_id"))
    text = known.select("transcript_id", F.col("full_text").alias("transcript"), "main_topics", "detected_language")
    return newest.join(text, "transcript_id").select("interaction_id", "transcript_id", "transcript", "main_topics", "detected_language")


def scored_interactions(interactions: DataFrame, surveys: DataFrame) -> DataFrame:
    """Interactions with their survey scores: all that totals by customer need."""
    return interactions.join(survey_pivot(surveys), "interaction_id", "left")


def placed_interactions(interactions: DataFrame, customers: DataFrame, surveys: DataFrame) -> DataFrame:
    """Scored interactions with the customer's country and segment."""
    return scored_interactions(interactions, surveys).join(customers.select("customer_id", "country", "segment"), "customer_id", "left")


def interaction_history(interactions: DataFrame, customers: DataFrame, transcripts: DataFrame, surveys: DataFrame) -> DataFrame:
    """Interactions with customer, newest transcript and survey scores."""
    return placed_interactions(interactions, customers, surveys).join(latest_transcripts(transcripts), "interaction_id", "left")


def product_totals(products: DataFrame) -> DataFrame:
    credit, usd = F.col("is_credit_product"), F.col("current_balance_usd")
    return products.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("products_total"), count_if(F.col("product_status") == "Active").alias("products_active"),
        F.array_sort(F.collect_set("product_type")).alias("product_types"), F.mode("currency", deterministic=True).alias("primary_currency"),
        F.round(F.sum(F.when(~credit, usd)), 2).alias("deposit_balance_usd"), F.round(F.sum(F.when(credit, usd)), 2).alias("credit_balance_usd"),
        F.max(F.coalesce("days_past_due", F.lit(0))).alias("max_days_past_due"), count_if(F.col("product_status") == "Blocked").alias("products_blocked"))


def transaction_totals(transactions: DataFrame, as_of: DataFrame) -> DataFrame:
    recent = attach_one_row(transactions, as_of).where(F.to_date("transaction_date") >= F.date_sub("as_of", NINETY_DAYS))
    return recent.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("tx_90d"), F.round(F.sum("amount_usd"), 2).alias("tx_amount_usd_90d"),
        count_if(F.col("transaction_status") == "Declined").alias("tx_declined_90d"), count_if(F.col("is_fraud")).alias("tx_fraud_90d"),
        F.max("transaction_date").alias("last_transaction_date"))


def case_totals(cases: DataFrame) -> DataFrame:
    return cases.groupBy("customer_id").agg(
        count_if(F.col("is_open")).alias("open_cases"), F.count(F.lit(1)).alias("cases_total"), F.max("creation_date").alias("last_case_date"))


def contact_totals(interactions: DataFrame, as_of: DataFrame) -> DataFrame:
    recent = F.to_date("interaction_date") >= F.date_sub("as_of", NINETY_DAYS)
    newest = F.struct("interaction_date", "interaction_id")
    return attach_one_row(interactions, as_of).groupBy("customer_id").agg(
        count_if(recent).alias("contacts_90d"), F.max("interaction_date").alias("last_contact_date"),
        F.max_by("contact_reason", newest).alias("last_contact_reason"), F.max_by("channel", newest).alias("last_contact_channel"),
        F.mode("channel", deterministic=True).alias("preferred_channel"),
        F.round(F.avg(F.when(recent, F.col("sentiment_score"))), 2).alias("avg_sentiment_90d"),
        F.round(F.avg("csat"), 2).alias("avg_csat"), count_if(F.col("was_escalated")).alias("escalations_total"))


ZERO_WHEN_ABSENT = ("products_total", "products_active", "max_days_past_due", "products_blocked", "tx_90d", "tx_declined_90d", "tx_fraud_90d",
                    "open_cases", "cases_total", "contacts_90d", "escalations_total")


def customer_360(customers: DataFrame, products: DataFrame, transactions: DataFrame, cases: DataFrame, interactions: DataFrame, as_of: DataFrame) -> DataFrame:
    """One row per customer; every fact table is aggregated before it is joined."""
    joined = (attach_one_row(customers, as_of).join(product_totals(products), "customer_id", "left")
              .join(transaction_totals(transactions, as_of), "customer_id", "left")
              .join(case_totals(cases), "customer_id", "left").join(contact_totals(interactions, as_of), "customer_id", "left"))
    derived = {"document_number": None, "date_of_birth": None, "as_of": None}
    kept = [c for c in joined.columns if c not in derived and c not in ZERO_WHEN_ABSENT]
    return joined.select(
        *kept, *[F.coalesce(c, F.lit(0)).alias(c) for c in ZERO_WHEN_ABSENT], last4("document_number").alias("document_number_last4"),
        age_years(F.col("date_of_birth"), F.col("as_of")).alias("age"), F.col("as_of").alias("as_of_date"))


def rate_of(c: str) -> Column:
    """Share of true values; unknown counts as false."""
    return F.round(F.avg(F.when(F.col(c), 1.0).otherwise(0.0)), 4)


def contact_reason_daily(interactions: DataFrame) -> DataFrame:
    by = ["country", "segment", "channel", "reason_category", "contact_reason"]
    known = F.when(F.col("was_resolved"), 1.0).when(~F.col("was_resolved"), 0.0)
    return interactions.groupBy(F.to_date("interaction_date").alias("day"), *by).agg(
        F.count(F.lit(1)).alias("interactions"), rate_of("was_resolved").alias("fcr_rate"), F.round(F.avg(known), 4).alias("fcr_known_rate"),
        rate_of("was_escalated").alias("escalation_rate"), F.round(F.avg("duration_seconds"), 1).alias("avg_handle_seconds"),
        F.round(F.avg("wait_time_seconds"), 1).alias("avg_wait_seconds"), F.round(F.avg("sentiment_score"), 3).alias("avg_sentiment"),
        F.round(F.avg("csat"), 2).alias("avg_csat"), F.count("csat").alias("csat_responses"))
