"""The gold products over the stand-in tables, built once per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellerlake.operators.running import attach_one_row, settled
from tellerlake.plans import gold
from tellerlake.standin import Bank


def as_of(b: Bank) -> DataFrame:
    """The anchor day, computed once per query."""
    if "_as_of" not in vars(b):
        b._as_of = settled(gold.as_of_date(b.transactions))
    return b._as_of


def transactions(b: Bank) -> DataFrame:
    return gold.customer_transactions(b.transactions, b.products, b.daily_exchange_rates)


def products(b: Bank) -> DataFrame:
    return gold.customer_products(b.products, b.daily_exchange_rates)


def cases(b: Bank) -> DataFrame:
    return gold.customer_cases(b.complaints, as_of(b))


def interactions(b: Bank) -> DataFrame:
    return gold.interaction_history(b.interactions, b.customers, b.transcripts, b.surveys)


def contacts(b: Bank) -> DataFrame:
    """Interactions with survey scores, for totals that read neither transcripts nor the customer's place."""
    return gold.scored_interactions(b.interactions, b.surveys)


def placed(b: Bank) -> DataFrame:
    return gold.placed_interactions(b.interactions, b.customers, b.surveys)


def customer_360(b: Bank) -> DataFrame:
    return gold.customer_360(b.customers, products(b), gold.usd_transactions(b.transactions, b.daily_exchange_rates), cases(b), contacts(b), as_of(b))


def customer_core(b: Bank) -> DataFrame:
    """The columns of the customer 360 that retention reads, without the joins it does not."""
    active = gold.active_products(b.products)
    core = attach_one_row(b.customers, as_of(b).withColumnRenamed("as_of", "as_of_date")).join(active, "customer_id", "left")
    return core.withColumn("products_active", F.coalesce("products_active", F.lit(0)))


# The same products in the oracle's words, one CTE each, on top of the mapped tables.
SOURCES = "customers products transactions daily_exchange_rates complaints interactions surveys transcripts"
GOLD = {
    "as_of": "SELECT CAST(max(transaction_date) AS DATE) AS as_of FROM transactions",
    "g_transactions": """SELECT t.* EXCLUDE (amount_usd), p.product_type,
        coalesce(t.amount_usd, CASE WHEN t.currency = 'USD' THEN t.amount ELSE round(CAST(t.amount AS DECIMAL(18,2)) * r.exchange_rate, 2) END)::DECIMAL(18,2) AS amount_usd,
        t.amount_usd IS NULL AS amount_usd_is_derived
      FROM transactions t LEFT JOIN products p USING (product_id)
      LEFT JOIN daily_exchange_rates r ON r.date = CAST(t.transaction_date AS DATE) AND r.source_currency = t.currency AND r.target_currency = 'USD'""",
    "g_products": """SELECT p.* EXCLUDE (product_number), p.product_type IN ('Credit Card', 'Personal Loan') AS is_credit_product, right(product_number, 4) AS product_number_last4,
        CAST(CASE WHEN p.currency = 'USD' THEN current_balance ELSE round(current_balance * r.exchange_rate, 2) END AS DECIMAL(18,2)) AS current_balance_usd,
        CASE WHEN credit_limit > 0 THEN sign(current_balance) * CAST((CAST(abs(current_balance) * 100 AS BIGINT) * 20000 + CAST(credit_limit * 100 AS BIGINT)) // (2 * CAST(credit_limit * 100 AS BIGINT)) AS DOUBLE) / 10000 END AS credit_utilization,
        coalesce(days_past_due, 0) > 0 AS is_delinquent
      FROM products p LEFT JOIN (SELECT source_currency, arg_max(exchange_rate, date) AS exchange_rate FROM daily_exchange_rates WHERE target_currency = 'USD' GROUP BY 1) r ON r.source_currency = p.currency""",
    "g_cases": """SELECT c.*, status IN ('Open', 'In Process', 'Escalated') AS is_open,
        date_diff('day', CAST(creation_date AS DATE), coalesce(CAST(resolution_date AS DATE), as_of)) AS age_days FROM complaints c, as_of""",
    "g_interactions": """SELECT i.*, cu.country, cu.segment, t.transcript_id, t.full_text AS transcript, t.main_topics, t.detected_language, s.csat, s.nps, s.survey_comment
      FROM interactions i LEFT JOIN customers cu USING (customer_id)
      LEFT JOIN (SELECT * FROM transcripts QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY process_date DESC, transcript_id DESC) = 1) t USING (interaction_id)
      LEFT JOIN (SELECT interaction_id, max(CASE WHEN survey_type = 'CSAT' AND c = 1 THEN main_score END) AS csat, max(CASE WHEN survey_type = 'NPS' AND c = 1 THEN main_score END) AS nps,
          max(CASE WHEN a = 1 THEN open_comments END) AS survey_comment
        FROM (SELECT *, row_number() OVER (PARTITION BY interaction_id, survey_type ORDER BY survey_date DESC, survey_id DESC) AS c,
            row_number() OVER (PARTITION BY interaction_id ORDER BY survey_date DESC, survey_id DESC) AS a FROM surveys WHERE interaction_id IS NOT NULL) GROUP BY 1) s USING (interaction_id)""",
    "g_360": """SELECT c.* EXCLUDE (document_number, date_of_birth), right(document_number, 4) AS document_number_last4, date_part('year', age(as_of, date_of_birth)) AS age,
        coalesce(products_total, 0) AS products_total, coalesce(products_active, 0) AS products_active, product_types, primary_currency, deposit_balance_usd, credit_balance_usd,
        coalesce(max_days_past_due, 0) AS max_days_past_due, coalesce(products_blocked, 0) AS products_blocked, coalesce(tx_90d, 0) AS tx_90d, tx_amount_usd_90d,
        coalesce(tx_declined_90d, 0) AS tx_declined_90d, coalesce(tx_fraud_90d, 0) AS tx_fraud_90d, last_transaction_date, coalesce(open_cases, 0) AS open_cases,
        coalesce(cases_total, 0) AS cases_total, last_case_date, coalesce(contacts_90d, 0) AS contacts_90d, last_contact_date, last_contact_reason, last_contact_channel,
        preferred_channel, avg_sentiment_90d, avg_csat, coalesce(escalations_total, 0) AS escalations_total, as_of AS as_of_date
      FROM customers c CROSS JOIN as_of
      LEFT JOIN (SELECT customer_id, count(*) AS products_total, count(*) FILTER (WHERE product_status = 'Active') AS products_active, list_sort(list_distinct(list(product_type))) AS product_types,
          sum(CASE WHEN NOT is_credit_product THEN current_balance_usd END) AS deposit_balance_usd, sum(CASE WHEN is_credit_product THEN current_balance_usd END) AS credit_balance_usd,
          max(coalesce(days_past_due, 0)) AS max_days_past_due, count(*) FILTER (WHERE product_status = 'Blocked') AS products_blocked FROM g_products GROUP BY 1) USING (customer_id)
      LEFT JOIN (SELECT customer_id, currency AS primary_currency FROM (SELECT customer_id, currency, count(*) AS n FROM g_products GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, currency) = 1) USING (customer_id)
      LEFT JOIN (SELECT customer_id, count(*) AS tx_90d, sum(amount_usd) AS tx_amount_usd_90d, count(*) FILTER (WHERE transaction_status = 'Declined') AS tx_declined_90d,
          count(*) FILTER (WHERE is_fraud) AS tx_fraud_90d, max(transaction_date) AS last_transaction_date FROM g_transactions, as_of
          WHERE CAST(transaction_date AS DATE) >= as_of - 90 GROUP BY 1) USING (customer_id)
      LEFT JOIN (SELECT customer_id, count(*) FILTER (WHERE is_open) AS open_cases, count(*) AS cases_total, max(creation_date) AS last_case_date FROM g_cases GROUP BY 1) USING (customer_id)
      LEFT JOIN (SELECT customer_id, count(*) FILTER (WHERE CAST(interaction_date AS DATE) >= as_of - 90) AS contacts_90d, max(interaction_date) AS last_contact_date,
          arg_max(contact_reason, {'d': interaction_date, 'i': interaction_id}) AS last_contact_reason, arg_max(channel, {'d': interaction_date, 'i': interaction_id}) AS last_contact_channel,
          round(sum(sentiment_score) FILTER (WHERE CAST(interaction_date AS DATE) >= as_of - 90)::DECIMAL(18,6)::DOUBLE / count(sentiment_score) FILTER (WHERE CAST(interaction_date AS DATE) >= as_of - 90), 2) AS avg_sentiment_90d,
          round(sum(csat) / count(csat), 2) AS avg_csat, count(*) FILTER (WHERE was_escalated) AS escalations_total FROM g_interactions, as_of GROUP BY 1) USING (customer_id)
      LEFT JOIN (SELECT customer_id, channel AS preferred_channel FROM (SELECT customer_id, channel, count(*) AS n FROM g_interactions GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, channel) = 1) USING (customer_id)""",
}
NEEDS = {"g_cases": ["as_of"], "g_360": ["as_of", "g_products", "g_transactions", "g_cases", "g_interactions"]}


def gold_oracle(names: str, body: str) -> str:
    """Oracle SQL over the named gold products."""
    from tellerlake.standin import oracle

    wanted: list[str] = []
    for name in names.split():
        for step in [*NEEDS.get(name, []), name]:
            if step not in wanted:
                wanted.append(step)
    ctes = ",\n".join(f"{n} AS ({GOLD[n]})" for n in wanted)
    body = body.strip()
    return oracle(SOURCES, f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}")
