"""Gold products and the joins and aggregates inside them."""

from pyspark.sql import functions as F

from tellerlake import standin_gold as G
from tellerlake.functions.money import usd_backfill
from tellerlake.plans import gold
from tellerlake.registry import query
from tellerlake.standin import oracle
from tellerlake.standin_gold import gold_oracle


def doubles(df, *names):
    return df.select(*[F.col(c).cast("double").alias(c) if c in names else c for c in df.columns])


TX_MONEY = ("amount", "amount_usd", "fraud_score", "latitude", "longitude")
TX_REPLACE = "* REPLACE (" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in TX_MONEY) + ")"
PRODUCT_MONEY = ("current_balance", "credit_limit", "current_balance_usd", "credit_utilization")
PRODUCT_REPLACE = "* REPLACE (" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in PRODUCT_MONEY) + ")"


@query("c01_customer_transactions", gold_oracle("g_transactions", f"SELECT {TX_REPLACE} FROM g_transactions"))
def _(b):
    return doubles(G.transactions(b), *TX_MONEY)


@query("j01_transaction_rates", gold_oracle("g_transactions", """
  SELECT product_type, currency, amount_usd_is_derived, count(*) AS n, count(amount_usd) AS converted, CAST(sum(amount_usd) AS DOUBLE) AS usd FROM g_transactions GROUP BY ALL"""))
def _(b):
    return G.transactions(b).groupBy("product_type", "currency", "amount_usd_is_derived").agg(
        F.count(F.lit(1)).alias("n"), F.count("amount_usd").alias("converted"), F.sum("amount_usd").cast("double").alias("usd"))


@query("c02_customer_products", gold_oracle("g_products", f"SELECT {PRODUCT_REPLACE} FROM g_products"))
def _(b):
    return doubles(G.products(b), *PRODUCT_MONEY)


@query("j02_latest_rate_per_currency", oracle("daily_exchange_rates products", """
  SELECT product_id, p.currency, CAST(exchange_rate AS DOUBLE) AS exchange_rate FROM products p LEFT JOIN (
    SELECT source_currency, exchange_rate FROM daily_exchange_rates WHERE target_currency = 'USD' QUALIFY row_number() OVER (PARTITION BY source_currency ORDER BY date DESC) = 1) r ON r.source_currency = p.currency"""))
def _(b):
    return b.products.select("product_id", "currency").join(gold.latest_rates(b.daily_exchange_rates), "currency", "left").select(
        "product_id", "currency", F.col("exchange_rate").cast("double").alias("exchange_rate"))


@query("c03_customer_cases", gold_oracle("g_cases", "SELECT * REPLACE (CAST(claimed_amount AS DOUBLE) AS claimed_amount) FROM g_cases"))
def _(b):
    return doubles(G.cases(b), "claimed_amount")


@query("c04_interaction_history", gold_oracle("g_interactions", """
  SELECT * EXCLUDE (transcript) REPLACE (CAST(sentiment_score AS DOUBLE) AS sentiment_score), md5(transcript) AS transcript_md5 FROM g_interactions"""))
def _(b):
    return doubles(G.interactions(b), "sentiment_score").withColumn("transcript_md5", F.md5("transcript")).drop("transcript")


@query("j03_interaction_joins", gold_oracle("g_interactions", """
  SELECT country, segment, count(*) AS n, count(transcript_id) AS with_transcript, count(csat) AS with_csat, count(nps) AS with_nps, count(survey_comment) AS with_comment FROM g_interactions GROUP BY ALL"""))
def _(b):
    return G.interactions(b).groupBy("country", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.count("transcript_id").alias("with_transcript"), F.count("csat").alias("with_csat"),
        F.count("nps").alias("with_nps"), F.count("survey_comment").alias("with_comment"))


MONEY_360 = ("estimated_monthly_income", "deposit_balance_usd", "credit_balance_usd", "tx_amount_usd_90d", "avg_sentiment_90d", "avg_csat")
REPLACE_360 = "* REPLACE (" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MONEY_360) + ", array_to_string(product_types, ',') AS product_types)"


def flat_360(b):
    return doubles(G.customer_360(b), *MONEY_360).withColumn("product_types", F.array_join("product_types", ","))


@query("c05_customer_360", gold_oracle("g_360", f"SELECT {REPLACE_360} FROM g_360"))
def _(b):
    return flat_360(b)


@query("j04_aggregate_then_join", gold_oracle("g_360", """
  SELECT segment, count(*) AS customers, sum(products_total)::BIGINT AS products, sum(tx_90d)::BIGINT AS tx, sum(cases_total)::BIGINT AS cases, sum(contacts_90d)::BIGINT AS contacts FROM g_360 GROUP BY 1"""))
def _(b):
    return G.customer_360(b).groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("products_total").alias("products"), F.sum("tx_90d").alias("tx"),
        F.sum("cases_total").alias("cases"), F.sum("contacts_90d").alias("contacts"))


RATE = "round(CAST(count(*) FILTER (WHERE {0}) AS DOUBLE) / count(*), 4)"
DAILY = f"""SELECT CAST(interaction_date AS DATE) AS day, country, segment, channel, reason_category, contact_reason, count(*) AS interactions,
    {RATE.format('was_resolved')} AS fcr_rate, round(CAST(count(*) FILTER (WHERE was_resolved) AS DOUBLE) / nullif(count(was_resolved), 0), 4) AS fcr_known_rate,
    {RATE.format('was_escalated')} AS escalation_rate, round(sum(duration_seconds) / count(duration_seconds), 1) AS avg_handle_seconds,
    round(sum(wait_time_seconds) / nullif(count(wait_time_seconds), 0), 1) AS avg_wait_seconds,
    round(CAST(sum(sentiment_score) AS DOUBLE) / nullif(count(sentiment_score), 0), 3) AS avg_sentiment, round(sum(csat) / nullif(count(csat), 0), 2) AS avg_csat, count(csat) AS csat_responses
  FROM g_interactions GROUP BY ALL"""


@query("c06_contact_reason_daily", gold_oracle("g_interactions", DAILY))
def _(b):
    return doubles(gold.contact_reason_daily(G.placed(b)), "fcr_rate", "fcr_known_rate", "escalation_rate", "avg_sentiment")


@query("a02_group_by_all", gold_oracle("g_interactions", "SELECT CAST(interaction_date AS DATE) AS day, country, channel, count(*) AS interactions FROM g_interactions GROUP BY ALL"))
def _(b):
    return G.placed(b).groupBy(F.to_date("interaction_date").alias("day"), "country", "channel").agg(F.count(F.lit(1)).alias("interactions"))


@query("a03_rates_null_is_false", oracle("interactions", f"SELECT channel, {RATE.format('was_resolved')} AS fcr_rate, {RATE.format('was_escalated')} AS escalation_rate FROM interactions GROUP BY 1"))
def _(b):
    return b.interactions.groupBy("channel").agg(gold.rate_of("was_resolved").cast("double").alias("fcr_rate"), gold.rate_of("was_escalated").cast("double").alias("escalation_rate"))


@query("c07_as_of", oracle("transactions", "SELECT CAST(max(transaction_date) AS DATE) AS as_of FROM transactions"))
def _(b):
    return G.as_of(b)


@query("a01_conditional_counts", gold_oracle("g_products", """
  SELECT customer_id, count(*) AS products_total, count(*) FILTER (WHERE product_status = 'Active') AS products_active, count(*) FILTER (WHERE product_status = 'Blocked') AS products_blocked,
    CAST(sum(CASE WHEN is_credit_product THEN current_balance_usd END) AS DOUBLE) AS credit_balance_usd FROM g_products GROUP BY 1"""))
def _(b):
    return doubles(gold.product_totals(G.products(b)).select("customer_id", "products_total", "products_active", "products_blocked", "credit_balance_usd"), "credit_balance_usd")


@query("a04_filtered_aggregates", oracle("interactions", """
  SELECT customer_id, count(*) FILTER (WHERE channel = 'Chat') AS chats, max(duration_seconds) FILTER (WHERE was_escalated) AS longest_escalated,
    CAST(sum(sentiment_score) FILTER (WHERE sentiment_score < 0) AS DOUBLE) AS negative FROM interactions GROUP BY 1"""))
def _(b):
    b.interactions.createOrReplaceTempView("interactions_to_filter")
    return b.spark.sql("""SELECT customer_id, count(*) FILTER (WHERE channel = 'Chat') AS chats, max(duration_seconds) FILTER (WHERE was_escalated) AS longest_escalated,
      CAST(sum(sentiment_score) FILTER (WHERE sentiment_score < 0) AS DOUBLE) AS negative FROM interactions_to_filter GROUP BY customer_id""")


@query("a05_latest_value", oracle("interactions surveys", """
  SELECT interaction_id, arg_max(main_score, {'d': survey_date, 'i': survey_id}) FILTER (WHERE survey_type = 'CSAT') AS csat,
    arg_max(main_score, {'d': survey_date, 'i': survey_id}) FILTER (WHERE survey_type = 'NPS') AS nps FROM surveys WHERE interaction_id IS NOT NULL GROUP BY 1"""))
def _(b):
    return gold.survey_pivot(b.surveys).select("interaction_id", "csat", "nps")


@query("a06_mode", oracle("interactions", """
  SELECT customer_id, channel AS preferred_channel FROM (SELECT customer_id, channel, count(*) AS n FROM interactions GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, channel) = 1"""))
def _(b):
    return b.interactions.groupBy("customer_id").agg(F.mode("channel", deterministic=True).alias("preferred_channel"))


@query("a07_collect_set", oracle("products", "SELECT customer_id, array_to_string(list_sort(list_distinct(list(product_type))), ',') AS product_types FROM products GROUP BY 1"))
def _(b):
    return b.products.groupBy("customer_id").agg(F.array_join(F.array_sort(F.collect_set("product_type")), ",").alias("product_types"))


@query("f08_usd_backfill", oracle("transactions daily_exchange_rates", """
  SELECT transaction_id, amount_usd IS NULL AS is_derived, CAST(coalesce(amount_usd, CASE WHEN currency = 'USD' THEN amount ELSE round(CAST(amount AS DECIMAL(18,2)) * exchange_rate, 2) END) AS DOUBLE) AS usd
  FROM transactions LEFT JOIN daily_exchange_rates ON date = CAST(transaction_date AS DATE) AND source_currency = currency"""))
def _(b):
    rates = b.daily_exchange_rates.select(F.col("date").alias("_d"), F.col("source_currency").alias("currency"), "exchange_rate")
    tx = b.transactions.withColumn("_d", F.to_date("transaction_date")).join(rates, ["_d", "currency"], "left")
    usd = usd_backfill(F.col("amount"), F.col("currency"), F.col("amount_usd"), F.col("exchange_rate"))
    return tx.select("transaction_id", F.col("amount_usd").isNull().alias("is_derived"), usd.cast("double").alias("usd"))


@query("f12_credit_flags", oracle("products", """
  SELECT product_id, product_type IN ('Credit Card', 'Personal Loan') AS is_credit, coalesce(days_past_due, 0) > 0 AS is_delinquent,
    CASE WHEN credit_limit > 0 THEN sign(current_balance) * CAST((CAST(abs(current_balance) * 100 AS BIGINT) * 20000 + CAST(credit_limit * 100 AS BIGINT)) // (2 * CAST(credit_limit * 100 AS BIGINT)) AS DOUBLE) / 10000 END AS utilization FROM products"""))
def _(b):
    from tellerlake.functions.money import is_credit, is_delinquent, utilisation
    return b.products.select("product_id", is_credit(F.col("product_type")).alias("is_credit"), is_delinquent(F.col("days_past_due")).alias("is_delinquent"),
                             utilisation(F.col("current_balance"), F.col("credit_limit")).cast("double").alias("utilization"))


@query("f13_ages", gold_oracle("g_cases", """
  SELECT customer_id, date_part('year', age(as_of, date_of_birth)) AS age, (SELECT sum(age_days)::BIGINT FROM g_cases g WHERE g.customer_id = c.customer_id) AS case_days FROM customers c, as_of"""))
def _(b):
    from tellerlake.functions.calendar import age_years
    from tellerlake.operators.running import attach_one_row
    days = G.cases(b).groupBy("customer_id").agg(F.sum("age_days").alias("case_days"))
    return attach_one_row(b.customers, G.as_of(b)).join(days, "customer_id", "left").select(
        "customer_id", age_years(F.col("date_of_birth"), F.col("as_of")).alias("age"), "case_days")


@query("j06_one_row_anchor", oracle("transactions", """
  SELECT customer_id, count(*) AS recent FROM transactions, (SELECT max(transaction_date) AS a FROM transactions) WHERE transaction_date >= a - INTERVAL 29 DAY GROUP BY 1"""))
def _(b):
    from tellerlake.operators.running import attach_one_row
    tx = attach_one_row(b.transactions, b.transactions.agg(F.max("transaction_date").alias("a")))
    return tx.where(F.col("transaction_date") >= F.col("a") - F.expr("INTERVAL '29' DAY")).groupBy("customer_id").agg(F.count(F.lit(1)).alias("recent"))
