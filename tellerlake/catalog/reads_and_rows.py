"""Projections, filters, owned reads, unions, sorts and row functions."""

from pyspark.sql import functions as F

from tellerlake import standin_gold as G
from tellerlake.catalog.text_rules import sensitive
from tellerlake.functions import money
from tellerlake.functions.calendar import before, is_weekend, weekday
from tellerlake.operators import history as H
from tellerlake.operators.latest import newest_per_group, top_n, union_sections, upsert_latest
from tellerlake.operators.running import History, prior_windows
from tellerlake.plans import account_reads as R
from tellerlake.plans import gold
from tellerlake.plans.training import basic_columns, basic_frame, categorical, check_predictors
from tellerlake.registry import query
from tellerlake.standin import oracle
from tellerlake.standin_gold import gold_oracle

SHOWN = "product_type IN ('Credit Card', 'Savings Account') AND product_status = 'Active'"
OWNED = f"FROM transactions t JOIN g_products p ON t.product_id = p.product_id AND t.customer_id = p.customer_id WHERE p.{SHOWN.replace('AND product', 'AND p.product')}"


@query("p01_column_allow_list", oracle("transactions", """SELECT transaction_id, channel, currency, CAST(amount AS DOUBLE) AS amount FROM transactions"""))
def _(b):
    names = check_predictors(list(basic_columns()))
    return basic_frame(b.transactions).select("transaction_id", *[n for n in names if n in ("channel", "currency", "amount")])


@query("p02_conditional_projection", oracle("products", f"""SELECT product_id, CASE WHEN product_type = 'Credit Card' THEN CAST(credit_limit - current_balance AS DOUBLE) END AS available_credit FROM products WHERE {SHOWN}"""))
def _(b):
    return R.shown_products(b.products).select("product_id", F.col("available_credit").cast("double").alias("available_credit"))


@query("p03_membership_filter", oracle("products", f"SELECT product_id, product_type FROM products WHERE {SHOWN}"))
def _(b):
    return R.shown_products(b.products).select("product_id", "product_type")


@query("p04_optional_filter", gold_oracle("g_products", f"""SELECT last4, count(*) AS n FROM (
  SELECT 'all' AS last4 {OWNED} UNION ALL SELECT '0060' {OWNED} AND p.product_number_last4 = '0060') GROUP BY 1"""))
def _(b):
    products = G.products(b)
    parts = [R.owned_movements(b.transactions, products, v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v or "all").alias("last4"), "n") for v in (None, "0060")]
    return parts[0].unionByName(parts[1]).where("n > 0")


@query("p05_half_open_cutoff", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'")
def _(b):
    return b.orders.where(before(F.col("o_orderdate"), "1999-01-01")).select("o_orderkey", "o_orderdate")


@query("p06_last_four", oracle("products", "SELECT product_id, right(product_number, 4) AS last4 FROM products"))
def _(b):
    return b.products.select("product_id", gold.last4("product_number").alias("last4"))


@query("j05_ownership_join", gold_oracle("g_products", f"SELECT t.transaction_id, t.customer_id, p.product_number_last4 {OWNED}"))
def _(b):
    return R.owned_movements(b.transactions, G.products(b)).select("transaction_id", "customer_id", "product_number_last4")


@query("w02_newest_ten_per_product", gold_oracle("g_products", f"""SELECT t.transaction_id, t.product_id {OWNED}
  QUALIFY row_number() OVER (PARTITION BY t.customer_id, t.product_id ORDER BY t.transaction_date DESC, t.transaction_id) <= 10"""))
def _(b):
    return R.newest_movements(b.transactions, G.products(b)).select("transaction_id", "product_id")


HISTORY_COLUMNS = """CAST(count(*) FILTER (WHERE h.transaction_date >= t.transaction_date - INTERVAL 1 HOUR) AS DOUBLE) AS n_1h, CAST(count(*) FILTER (WHERE h.transaction_date >= t.transaction_date - INTERVAL 7 DAY) AS DOUBLE) AS n_7d,
  CAST(count(*) FILTER (WHERE h.transaction_date >= t.transaction_date - INTERVAL 30 DAY AND h.currency IS NOT DISTINCT FROM t.currency) AS DOUBLE) AS same_currency_30d,
  CASE WHEN t.merchant_name IS NOT NULL THEN CAST(count(*) FILTER (WHERE h.transaction_date >= t.transaction_date - INTERVAL 30 DAY AND h.merchant_name = t.merchant_name) AS DOUBLE) END AS merchant_30d"""


@query("j07_history_per_row", oracle("card_events", f"""SELECT t.transaction_id, {HISTORY_COLUMNS} FROM card_events t LEFT JOIN card_events h ON h.customer_id = t.customer_id AND h.transaction_date < t.transaction_date
  GROUP BY t.transaction_id, t.transaction_date, t.currency, t.merchant_name"""))
def _(b):
    df = H.timeline(b.card_events)
    features = {"n_1h": H.velocity_features()["customer_tx_count_1h"], "n_7d": H.velocity_features()["customer_tx_count_7d"],
                "same_currency_30d": H.currency_features()["customer_same_currency_tx_count_30d"], "merchant_30d": H.merchant_features()["customer_merchant_count_30d"]}
    return H.with_history(df, [H.velocity(), H.same_currency(), H.merchant_familiarity()], features).select("transaction_id", *features)


@query("m05_serving_parity", oracle("card_events", f"""WITH f AS (SELECT t.transaction_id, t.customer_id, {HISTORY_COLUMNS} FROM card_events t LEFT JOIN card_events h ON h.customer_id = t.customer_id AND h.transaction_date < t.transaction_date
  GROUP BY t.transaction_id, t.customer_id, t.transaction_date, t.currency, t.merchant_name)
  SELECT customer_id, count(*) AS rows, CAST(sum(n_1h) AS DOUBLE) AS n_1h, CAST(sum(n_7d) AS DOUBLE) AS n_7d, CAST(sum(same_currency_30d) AS DOUBLE) AS same_currency_30d, CAST(sum(merchant_30d) AS DOUBLE) AS merchant_30d FROM f GROUP BY 1"""))
def _(b):
    df = H.timeline(b.card_events)
    features = {"n_1h": H.velocity_features()["customer_tx_count_1h"], "n_7d": H.velocity_features()["customer_tx_count_7d"],
                "same_currency_30d": H.currency_features()["customer_same_currency_tx_count_30d"], "merchant_30d": H.merchant_features()["customer_merchant_count_30d"]}
    frame = H.with_history(df, [H.velocity(), H.same_currency(), H.merchant_familiarity()], features)
    return frame.groupBy("customer_id").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in features])


@query("j08_newest_charge", gold_oracle("g_products", f"""SELECT t.customer_id, t.transaction_id, t.transaction_date, t.merchant_name, CAST(t.amount AS DOUBLE) AS amount, t.currency, p.product_number_last4 {OWNED}
  AND p.product_type = 'Credit Card' AND coalesce(t.merchant_name, '') <> '' QUALIFY row_number() OVER (PARTITION BY t.customer_id ORDER BY t.transaction_date DESC, t.transaction_id) = 1"""))
def _(b):
    return R.newest_charge(b.transactions, G.products(b)).withColumn("amount", F.col("amount").cast("double"))


@query("j11_feature_join", oracle("card_events", """SELECT b.transaction_id, CAST(b.amount AS DOUBLE) AS amount, e.n FROM card_events b LEFT JOIN (
  SELECT transaction_id, count(*) OVER (PARTITION BY coalesce(customer_id, '__missing__' || transaction_id) ORDER BY transaction_date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS n FROM card_events) e USING (transaction_id)"""))
def _(b):
    df = H.timeline(b.card_events)
    extra = prior_windows(df, "transaction_id", "_t", [History("day", ["_customer_id"], {"1d": 24 * 3_600_000_000}, {"n": F.lit(1).cast("bigint")})])
    return b.card_events.join(extra, "transaction_id", "left").select("transaction_id", F.col("amount").cast("double").alias("amount"), F.col("day_n_1d").alias("n"))


@query("o01_newest_global", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def _(b):
    return top_n(b.orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 20)


@query("o04_nulls_last", oracle("complaints", "SELECT customer_id, complaint_id FROM complaints QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY resolution_date DESC NULLS LAST, complaint_id) = 1"))
def _(b):
    return newest_per_group(b.complaints, ["customer_id"], [F.desc_nulls_last("resolution_date"), F.asc("complaint_id")], 1).select("customer_id", "complaint_id")


@query("u01_labelled_union", """SELECT 'orders' AS section, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def _(b):
    return union_sections({t: getattr(b, t).agg(F.count(F.lit(1)).alias("n")) for t in ("orders", "customer", "lineitem")})


@query("u02_stream_union", oracle("card_events digital_events", """SELECT is_tx, count(*) AS n, count(transaction_country) AS countries, count(platform) AS platforms FROM (
  SELECT 1 AS is_tx, transaction_country, NULL AS platform FROM card_events UNION ALL SELECT 0, NULL, platform FROM digital_events) GROUP BY 1"""))
def _(b):
    both = b.card_events.select(F.lit(1).alias("is_tx"), "transaction_country").unionByName(b.digital_events.select(F.lit(0).alias("is_tx"), "platform"), allowMissingColumns=True)
    return both.groupBy("is_tx").agg(F.count(F.lit(1)).alias("n"), F.count("transaction_country").alias("countries"), F.count("platform").alias("platforms"))


@query("u03_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(b):
    return b.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("u06_upsert", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(b):
    rows = b.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    old, new = rows.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")), rows.where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    return upsert_latest(old, new, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("f07_usd_amount", oracle("transactions", "SELECT transaction_id, CAST(CASE WHEN currency = 'USD' THEN amount ELSE amount_usd END AS DOUBLE) AS usd FROM transactions"))
def _(b):
    return b.transactions.select("transaction_id", money.usd_amount(F.col("amount"), F.col("currency"), F.col("amount_usd")).cast("double").alias("usd"))


@query("f09_log_and_sign", oracle("transactions", """SELECT transaction_id, round(ln(1 + abs(CAST(amount_usd AS DOUBLE))), 6) AS log_abs, CASE WHEN amount_usd > 0 THEN 1 WHEN amount_usd < 0 THEN -1 WHEN amount_usd = 0 THEN 0 END AS sign_or_null,
  CASE WHEN amount_usd > 0 THEN 1.0::DOUBLE WHEN amount_usd < 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sign_or_zero FROM transactions"""))
def _(b):
    a = F.col("amount_usd")
    return b.transactions.select("transaction_id", F.round(money.log_abs(a), 6).alias("log_abs"), money.sign_or_null(a).alias("sign_or_null"), money.sign_or_zero(a).alias("sign_or_zero"))


@query("f10_clock_features", "SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS weekday, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM events")
def _(b):
    return b.events.select("event_id", F.hour("ts").alias("hour"), weekday(F.col("ts")).alias("weekday"), is_weekend(F.col("ts")).alias("is_weekend"))


@query("f38_missing_category", oracle("transactions", "SELECT coalesce(nullif(trim(transaction_category), ''), '__missing__') AS category, count(*) AS n FROM transactions GROUP BY 1"))
def _(b):
    return b.transactions.groupBy(categorical(F.col("transaction_category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("f39_coarse_position", oracle("card_events", """SELECT transaction_id, CAST(round(latitude, 1) AS DOUBLE) AS lat, CAST(round(longitude, 1) AS DOUBLE) AS lon,
  CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS geo_present FROM card_events"""))
def _(b):
    present = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return b.card_events.select("transaction_id", H.coarse(F.col("latitude")).cast("double").alias("lat"), H.coarse(F.col("longitude")).cast("double").alias("lon"),
                                F.when(present, 1.0).otherwise(0.0).alias("geo_present"))


RECENT = "r AS (SELECT customer_id, interaction_id, interaction_date, channel FROM interactions QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY interaction_date DESC, interaction_id) <= 10)"


@query("f32_customer_context", oracle("interactions transcripts", f"""WITH {RECENT} SELECT r.customer_id, r.interaction_id, t.transcript_id, length(t.full_text) > 0 AS has_text, md5({sensitive('t.full_text')}) AS masked_md5 FROM r LEFT JOIN transcripts t USING (interaction_id)"""))
def _(b):
    rows = R.recent_context(b.interactions, b.transcripts.select("interaction_id", "transcript_id", "full_text"))
    return rows.select("customer_id", "interaction_id", "transcript_id", (F.length("full_text") > 0).alias("has_text"), F.md5("full_text").alias("masked_md5"))


@query("x01_table_functions", gold_oracle("g_products g_cases", f"""
  SELECT 'products' AS source, product_number_last4 AS id, CAST(available_credit AS DOUBLE) AS amount FROM (SELECT *, CASE WHEN product_type = 'Credit Card' THEN credit_limit - current_balance END AS available_credit FROM g_products WHERE {SHOWN} AND customer_id = '5')
  UNION ALL SELECT 'transactions', transaction_id, CAST(amount AS DOUBLE) FROM (SELECT t.* {OWNED} AND t.customer_id = '5' ORDER BY t.transaction_date DESC, t.transaction_id LIMIT 10)
  UNION ALL SELECT 'cases', complaint_id, CAST(claimed_amount AS DOUBLE) FROM (SELECT * FROM g_cases WHERE customer_id = '5' ORDER BY creation_date DESC, complaint_id LIMIT 10)"""))
def _(b):
    G.products(b).createOrReplaceTempView("read_products")
    b.transactions.createOrReplaceTempView("read_transactions")
    G.cases(b).createOrReplaceTempView("read_cases")
    R.register_reads(b.spark, "read_products", "read_transactions", "read_cases")
    return b.spark.sql("""SELECT 'products' AS source, product_number_last4 AS id, CAST(available_credit AS DOUBLE) AS amount FROM get_products('5')
      UNION ALL SELECT 'transactions', transaction_id, CAST(amount AS DOUBLE) FROM list_transactions('5') UNION ALL SELECT 'cases', complaint_id, CAST(claimed_amount AS DOUBLE) FROM get_cases('5')""")


@query("x02_parameterised_template", oracle("transactions", "SELECT channel, count(*) AS n FROM transactions WHERE transaction_date >= TIMESTAMP '1999-01-01' AND currency IN ('USD', 'COP') GROUP BY 1"))
def _(b):
    b.transactions.createOrReplaceTempView("template_transactions")
    return R.parameterised(b.spark, "SELECT channel, count(*) AS n FROM {source} WHERE transaction_date >= CAST(:since AS TIMESTAMP_NTZ) AND array_contains(:currencies, currency) GROUP BY channel",
                           {"since": "1999-01-01", "currencies": F.array(F.lit("USD"), F.lit("COP"))}, source="template_transactions")
