"""Retention report, fraud overview and label profiles."""

from pyspark.sql import functions as F

from tellerlake import standin_gold as G
from tellerlake.operators import profile as P
from tellerlake.operators.ordering import exact_percentiles
from tellerlake.plans import overview, retention
from tellerlake.registry import query
from tellerlake.standin import oracle
from tellerlake.standin_gold import gold_oracle

RANKED = """a AS (SELECT max(as_of_date) AS as_of, min(as_of_date) AS min_as_of FROM g_360),
  tx AS (SELECT customer_id, max(transaction_date) AS last_tx, count(*) FILTER (WHERE date_diff('day', CAST(transaction_date AS DATE), as_of) BETWEEN 0 AND 29) AS tx_30,
      count(*) FILTER (WHERE date_diff('day', CAST(transaction_date AS DATE), as_of) BETWEEN 30 AND 59) AS tx_prev_30
    FROM g_transactions, a WHERE transaction_date < as_of + 1 GROUP BY 1),
  contacts AS (SELECT customer_id, avg(csat) FILTER (WHERE csat BETWEEN 1 AND 5) AS csat, count(*) FILTER (WHERE csat BETWEEN 1 AND 5) AS csat_n,
      CAST(sum(sentiment_score) AS DOUBLE) / count(sentiment_score) AS sentiment, count(sentiment_score) AS sentiment_n,
      count(*) FILTER (WHERE regexp_matches(lower(contact_reason), '(cancel|cierre|encerr|close)') AND was_resolved = false) AS cancellation_requests
    FROM g_interactions, a WHERE interaction_date >= as_of - 89 AND interaction_date < as_of + 1 GROUP BY 1),
  load AS (SELECT customer_id, count(*) FILTER (WHERE is_open AND (resolution_date IS NULL OR resolution_date >= as_of + 1)) AS open_cases,
      count(*) FILTER (WHERE creation_date >= as_of - 89) AS cases_90 FROM g_cases, a WHERE creation_date < as_of + 1 GROUP BY 1),
  eligible AS (SELECT c.customer_id, coalesce(country, 'Unknown') AS country, coalesce(segment, 'Unknown') AS segment, as_of,
      date_diff('day', CAST(last_tx AS DATE), as_of) AS inactive_days, coalesce(tx_30, 0) AS tx_30, coalesce(tx_prev_30, 0) AS tx_prev_30, coalesce(load.open_cases, 0) AS open_cases,
      coalesce(cases_90, 0) AS cases_90, csat, coalesce(csat_n, 0) AS csat_n, sentiment, coalesce(sentiment_n, 0) AS sentiment_n,
      coalesce(cancellation_requests, 0) AS cancellation_requests, date_diff('day', CAST(registration_date AS DATE), as_of) AS tenure_days
    FROM g_360 c CROSS JOIN a LEFT JOIN tx USING (customer_id) LEFT JOIN contacts USING (customer_id) LEFT JOIN load USING (customer_id)
    WHERE customer_status = 'Active' AND products_active > 0 AND registration_date < as_of + 1),
  flags AS (SELECT *, inactive_days >= 60 AND tenure_days >= 90 AS f1, tx_prev_30 >= 3 AND tx_30 <= tx_prev_30 * 0.5 AND tenure_days >= 60 AS f2, open_cases >= 1 AS f3,
      cases_90 >= 2 AS f4, csat_n >= 1 AND csat <= 2 AS f5, sentiment_n >= 2 AND sentiment < 0 AS f6, cancellation_requests >= 1 AS f7 FROM eligible),
  signals AS (SELECT *, concat_ws(',', CASE WHEN f1 THEN 'inactive' END, CASE WHEN f2 THEN 'declining' END, CASE WHEN f3 THEN 'unresolved' END, CASE WHEN f4 THEN 'repeated' END,
      CASE WHEN f5 THEN 'low_csat' END, CASE WHEN f6 THEN 'negative_sentiment' END, CASE WHEN f7 THEN 'cancellation' END) AS reasons,
      (coalesce(f1, false) OR f2)::INT + (f3 OR f4)::INT + (coalesce(f5, false) OR coalesce(f6, false))::INT + f7::INT AS families FROM flags),
  ranked AS (SELECT *, CASE WHEN f7 OR families >= 3 THEN 'high' WHEN families >= 2 THEN 'medium' WHEN families = 1 THEN 'watch' ELSE 'none' END AS band FROM signals)"""
ALL_GOLD = "g_360"


def ranked(b):
    core = G.customer_core(b)
    return retention.banded(retention.eligible(core, b.transactions, G.contacts(b), G.cases(b))), core


def ranked_oracle(body):
    return gold_oracle(ALL_GOLD, f"WITH {RANKED} {body}")


@query("w24_recent_activity", ranked_oracle("SELECT customer_id, tx_30, tx_prev_30, last_tx FROM tx"))
def _(b):
    return retention.recent_activity(b.transactions, G.as_of(b))


@query("a18_case_load", ranked_oracle("SELECT customer_id, open_cases, cases_90 FROM load"))
def _(b):
    return retention.case_load(G.cases(b), G.as_of(b))


@query("f16_retention_signals", ranked_oracle("SELECT customer_id, reasons, families, band FROM ranked"))
def _(b):
    df, _ = ranked(b)
    return df.select("customer_id", F.array_join("reasons", ",").alias("reasons"), "families", "band")


SHORT = """SELECT substr(sha256(customer_id), 1, 12) AS ref, country, segment, band, reasons, inactive_days, tx_30, tx_prev_30, open_cases, csat, csat_n, families
  FROM ranked WHERE band <> 'none' QUALIFY row_number() OVER (PARTITION BY country, band ORDER BY families DESC, open_cases DESC, customer_id) <= 15"""


@query("w03_shortlist_per_group", ranked_oracle(SHORT))
def _(b):
    df, c360 = ranked(b)
    return retention.breakdowns(df, c360)["customers"].withColumn("reasons", F.array_join("reasons", ","))


@query("p07_pseudonym", oracle("customers", "SELECT customer_id, substr(sha256(customer_id), 1, 12) AS ref FROM customers"))
def _(b):
    return b.customers.select("customer_id", retention.pseudonym("customer_id").alias("ref"))


@query("a27_dashboard_sections", ranked_oracle("""
  SELECT 'bands' AS section, band AS label, count(*) AS total FROM ranked GROUP BY band UNION ALL SELECT 'countries', country, count(*) FROM ranked GROUP BY country
  UNION ALL SELECT 'segments', segment, count(*) FROM ranked GROUP BY segment UNION ALL SELECT 'signals', s, count(*) FROM (SELECT unnest(string_split(reasons, ',')) AS s FROM ranked WHERE reasons <> '') GROUP BY s
  UNION ALL SELECT 'metadata', 'eligible', count(*) FROM ranked UNION ALL SELECT 'customers', NULL, count(*) FROM (""" + SHORT + ")"))
def _(b):
    df, c360 = ranked(b)
    rows = retention.dashboard(df, c360)
    label = F.coalesce(*[F.get_json_object("payload", f"$.{k}") for k in ("id",)], F.when(F.col("section") == "bands", F.get_json_object("payload", "$.band")),
                       F.when(F.col("section") == "countries", F.get_json_object("payload", "$.country")),
                       F.when(F.col("section") == "segments", F.get_json_object("payload", "$.segment")), F.when(F.col("section") == "metadata", F.lit("eligible")))
    total = F.when(F.col("section") == "customers", 1).when(F.col("section") == "metadata", F.get_json_object("payload", "$.eligible_customers").cast("bigint")).otherwise(
        F.get_json_object("payload", "$.total").cast("bigint"))
    return rows.groupBy("section", label.alias("label")).agg(F.sum(total).alias("total"))


@query("c08_retention_report", ranked_oracle("""
  SELECT country, segment, band, count(*) AS customers, sum(families)::BIGINT AS families, sum(open_cases)::BIGINT AS open_cases, min(inactive_days) AS min_inactive, max(inactive_days) AS max_inactive FROM ranked GROUP BY ALL"""))
def _(b):
    df, _ = ranked(b)
    return df.groupBy("country", "segment", "band").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("families").alias("families"), F.sum("open_cases").alias("open_cases"),
        F.min("inactive_days").alias("min_inactive"), F.max("inactive_days").alias("max_inactive"))


@query("a26_reconciliation", ranked_oracle(f"""
  , s AS ({SHORT}), n AS (SELECT count(*) AS n FROM ranked)
  SELECT c AS "check", n AS expected, n AS actual, true AS passed FROM n, (VALUES ('bands_total'), ('countries_total'), ('segments_total'), ('country_bands')) v(c)
  UNION ALL SELECT 'shortlist_cap', 15, max(k), max(k) <= 15 FROM (SELECT count(*) AS k FROM s GROUP BY country, band)
  UNION ALL SELECT 'unique_refs', count(ref), count(DISTINCT ref), count(ref) = count(DISTINCT ref) FROM s""").replace("FROM signals)  ,", "FROM signals),"))
def _(b):
    return retention.reconciliation(*ranked(b))


END = "2001-01-01"
OVERVIEW = f"""base AS (SELECT *, strftime(transaction_date, '%Y-%m') AS month, CASE WHEN currency = 'USD' THEN amount ELSE amount_usd END AS normalized
    FROM transactions WHERE transaction_date < TIMESTAMP '{END}'),
  rows_ AS (SELECT section, coalesce(label, 'Unknown') AS label, count(*) AS total, count(*) FILTER (WHERE is_fraud) AS fraud, count(*) - count(transaction_id) AS null_ids,
      count(*) - count(is_fraud) AS null_labels, count(*) - count(merchant_category) AS merchant_missing, count(*) - count(amount_usd) AS usd_missing, count(*) - count(normalized) AS normalized_missing,
      min(transaction_date) AS min_date, max(transaction_date) AS max_date
    FROM (SELECT *, unnest(['countries', 'channels', 'types', 'currencies', 'monthly', 'summary']) AS section,
        unnest([transaction_country, channel, transaction_type, currency, month, NULL]) AS label FROM base) GROUP BY ALL)"""


@query("a08_grouping_sets", oracle("transactions", f"WITH {OVERVIEW} SELECT section, label, total, fraud FROM rows_"))
def _(b):
    return overview.overview(b.transactions, END).select("section", "label", "total", "fraud")


@query("c09_fraud_overview", oracle("transactions", f"WITH {OVERVIEW} SELECT * FROM rows_"))
def _(b):
    return overview.overview(b.transactions, END)


@query("a26_overview_reconciliation", oracle("transactions", f"""WITH {OVERVIEW}
  SELECT section, sum(total)::BIGINT AS total, sum(fraud)::BIGINT AS fraud, count(DISTINCT label) AS labels, count(*) AS groups, (SELECT total FROM rows_ WHERE section = 'summary') AS all_rows,
    (SELECT fraud FROM rows_ WHERE section = 'summary') AS all_fraud, true AS passed FROM rows_ WHERE section <> 'summary' GROUP BY section"""))
def _(b):
    return overview.reconciliation(overview.overview(b.transactions, END))


@query("a09_distinct_counts", """
  SELECT l_returnflag, count(DISTINCT (l_orderkey, l_suppkey)) AS pairs, count(DISTINCT CASE WHEN l_tax > 0.05 THEN l_partkey END) AS taxed_parts FROM lineitem GROUP BY 1""")
def _(b):
    return b.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey", "l_suppkey").alias("pairs"), F.count_distinct(F.when(F.col("l_tax") > 0.05, F.col("l_partkey"))).alias("taxed_parts"))


PROBS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


@query("a10_exact_percentiles", "SELECT l_returnflag, count(*) AS n_values, " + ", ".join(
    f"percentile_disc({p}) WITHIN GROUP (ORDER BY l_extendedprice) AS {n}" for n, p in PROBS.items()) + " FROM lineitem GROUP BY 1")
def _(b):
    return exact_percentiles(b.lineitem, ["l_returnflag"], "l_extendedprice", PROBS, method="disc")


@query("a11_approximate_percentiles")
def _(b):
    return b.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.01, 0.25, 0.5, 0.75, 0.99], 10000).alias("percentiles"))


@query("a12_interpolated_percentiles", oracle("turn_metrics", """
  SELECT use_case, count(duration_ms) AS n_values, quantile_cont(duration_ms::DOUBLE, 0.5) AS p50, quantile_cont(duration_ms::DOUBLE, 0.95) AS p95
  FROM turn_metrics WHERE source = 'live' GROUP BY 1"""))
def _(b):
    return exact_percentiles(b.turn_metrics.where("source = 'live'"), ["use_case"], "duration_ms", {"p50": 0.5, "p95": 0.95})


@query("a13_ratio_stats", oracle("transactions", """
  SELECT currency, count(*) AS total, count(r) AS known, min(r) AS min_ratio, max(r) AS max_ratio, round(avg(r), 6) AS avg_ratio, count(*) FILTER (WHERE r <= 0) AS non_positive
  FROM (SELECT currency, CAST(amount_usd AS DOUBLE) / CAST(amount AS DOUBLE) AS r FROM transactions) GROUP BY 1"""))
def _(b):
    return P.ratio_stats(b.transactions, ["currency"], F.col("amount_usd").cast("double") / F.col("amount").cast("double")).withColumn("avg_ratio", F.round("avg_ratio", 6))


@query("a14_label_profile", oracle("transactions", """
  SELECT dimension, value, count(*) AS total, count(*) FILTER (WHERE is_fraud) AS positives, count(*) - count(is_fraud) AS null_labels, count(*) FILTER (WHERE is_fraud) / count(*) AS rate
  FROM (SELECT is_fraud, unnest(['month', 'country', 'channel', 'type', 'merchant_category']) AS dimension,
    unnest([strftime(transaction_date, '%Y-%m'), transaction_country, channel, transaction_type, merchant_category]) AS value FROM transactions) GROUP BY ALL"""))
def _(b):
    return P.label_profile(b.transactions, {
        "month": F.date_format("transaction_date", "yyyy-MM"), "country": F.col("transaction_country"), "channel": F.col("channel"),
        "type": F.col("transaction_type"), "merchant_category": F.col("merchant_category")}, "is_fraud")


PROFILED = {"currency": "currency", "channel": "channel", "transaction_type": "transaction_type", "merchant_category": "merchant_category", "transaction_country": "transaction_country",
            "transaction_category": "transaction_category", "transaction_status": "transaction_status", "hour": "CAST(hour(transaction_date) AS VARCHAR)",
            "weekday": "CAST(isodow(transaction_date) - 1 AS VARCHAR)"}


@query("a15_melted_profile", oracle("transactions", f"""
  SELECT year, feature, bucket, count(*) AS n FROM (SELECT year(transaction_date) AS year, unnest({list(PROFILED)}) AS feature, unnest([{', '.join(PROFILED.values())}]) AS bucket FROM transactions) GROUP BY ALL"""))
def _(b):
    df = b.transactions.withColumn("year", F.year("transaction_date")).withColumn("hour", F.hour("transaction_date")).withColumn("weekday", F.weekday("transaction_date"))
    return P.melted_profile(df, list(PROFILED), "year")


COUNTED = ("transaction_id", "customer_id", "product_id", "transaction_date", "process_date", "transaction_type", "transaction_category", "amount", "currency", "amount_usd", "channel",
           "merchant_name", "merchant_category", "transaction_country", "transaction_status", "is_fraud", "fraud_score", "latitude", "longitude")


@query("a16_missingness", oracle("transactions", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) = '') AS blanks, count(*) AS total, "
    f"round((count(*) - count({c}) + count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) = '')) * 100.0 / count(*), 3) AS missing_pct FROM transactions" for c in COUNTED)))
def _(b):
    """Every column of the table."""
    return P.missingness(b.transactions, b.transactions.columns)


@query("a17_score_bands", oracle("transactions", """
  SELECT band, count(*) AS total, count(*) FILTER (WHERE is_fraud) AS positives, CASE band WHEN 'null' THEN 0 WHEN '<30' THEN 1 WHEN '30-49' THEN 2 WHEN '50-69' THEN 3 ELSE 4 END AS band_order FROM (
    SELECT is_fraud, CASE WHEN fraud_score IS NULL THEN 'null' WHEN fraud_score < 30 THEN '<30' WHEN fraud_score < 50 THEN '30-49' WHEN fraud_score < 70 THEN '50-69' ELSE '>=70' END AS band
    FROM transactions) GROUP BY band"""))
def _(b):
    return P.score_bands(b.transactions, "fraud_score", "is_fraud")


@query("a17_precision_at_thresholds", oracle("transactions", """
  SELECT threshold, count(*) FILTER (WHERE fraud_score >= threshold) AS alerts, count(*) FILTER (WHERE fraud_score >= threshold AND is_fraud) AS tp,
    count(*) FILTER (WHERE fraud_score >= threshold AND is_fraud) / nullif(count(*) FILTER (WHERE fraud_score >= threshold), 0) AS precision
  FROM transactions, (VALUES (30.0::DOUBLE), (50.0::DOUBLE), (70.0::DOUBLE), (200.0::DOUBLE)) v(threshold) GROUP BY threshold"""))
def _(b):
    return P.precision_at_thresholds(b.transactions, "fraud_score", "is_fraud", [30, 50, 70, 200])


@query("s15_bounded_export", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(b):
    return P.bounded(b.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")), 500)


@query("s16_evidence_json", """
  SELECT '{"l_returnflag":"' || l_returnflag || '","n":' || count(*) || ',"ratio":null,"mean_quantity":' || CAST(floor(sum(l_quantity) / count(*)) AS DOUBLE) || '}' AS payload FROM lineitem GROUP BY l_returnflag""")
def _(b):
    by = b.lineitem.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.lit(float("nan"))).alias("ratio"), F.floor(F.sum("l_quantity") / F.count(F.lit(1))).cast("double").alias("mean_quantity"))
    return P.evidence_json(by, ["ratio", "mean_quantity"])


@query("a25_demand_baseline", oracle("interactions", """
  SELECT contact_reason, count(*) AS contacts, count(*) / (SELECT count(*) FROM interactions) AS share, count(*) FILTER (WHERE was_resolved) / count(*) AS resolved_rate,
    count(*) FILTER (WHERE requires_followup) / count(*) AS follow_up_rate, quantile_cont(duration_seconds::DOUBLE, 0.5) AS median_duration,
    quantile_cont(wait_time_seconds::DOUBLE, 0.5) AS median_wait, sum(duration_seconds) / 3600 AS advisor_hours FROM interactions GROUP BY 1"""))
def _(b):
    return P.demand_baseline(b.interactions, "contact_reason")


@query("o02_custom_sort", oracle("transactions", """
  SELECT band, n, row_number() OVER (ORDER BY CASE band WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS position FROM (
    SELECT CASE WHEN amount > 400000 THEN 'high' WHEN amount > 100000 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM transactions GROUP BY 1)"""))
def _(b):
    band = F.when(F.col("amount") > 400000, "high").when(F.col("amount") > 100000, "medium").otherwise("low")
    order = F.when(F.col("band") == "high", 0).when(F.col("band") == "medium", 1).otherwise(2)
    rows = b.transactions.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    listed = rows.agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "band", "n"))).alias("rows"))  # three bands
    return listed.select(F.posexplode("rows").alias("p", "r")).select("r.band", "r.n", (F.col("p") + 1).alias("position"))
