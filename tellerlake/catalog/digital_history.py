"""Digital history before transactions, and the feature frames built on it."""

from pyspark.sql import functions as F

from tellerlake.catalog import history_windows as HW
from tellerlake.operators.digital import availability, available_events, coverage, digital_features, digital_history
from tellerlake.operators.history import private_key
from tellerlake.operators.running import DAY, epoch_us, prior_windows
from tellerlake.plans.training import basic_frame, basic_select, behaviour_frame, full_frame, labelled
from tellerlake.registry import query
from tellerlake.standin import oracle

PAIRS = """ev AS (SELECT *, greatest(event_date, CAST(process_date + 1 AS TIMESTAMP)) AS av FROM digital_events
    WHERE customer_id IS NOT NULL AND event_date IS NOT NULL AND process_date IS NOT NULL),
  tx AS (SELECT transaction_id, customer_id, transaction_date AS t, transaction_country FROM card_events)"""
# One ordered stream per customer: the frame of a transaction holds only earlier available events.
STREAM = f"""{PAIRS}, s AS (
  SELECT transaction_id, coalesce(customer_id, '__missing__' || transaction_id) AS k, t, transaction_country, NULL AS event_id, NULL AS event_date, NULL AS event_type, NULL AS ip_country,
    NULL AS is_mobile, NULL AS duration_seconds, NULL AS platform, NULL AS browser, NULL AS channel FROM tx
  UNION ALL SELECT NULL, customer_id, av, NULL, event_id, event_date, event_type, ip_country, is_mobile, duration_seconds, platform, browser, channel FROM ev)"""


def count(length, condition="event_id IS NOT NULL"):
    return f"CAST(count(*) FILTER (WHERE {condition}) OVER (PARTITION BY k ORDER BY t {HW.frame(length)}) AS DOUBLE)"


def latest(days):
    return (f"max(CASE WHEN event_id IS NOT NULL THEN {{'a': epoch_us(t), 'e': epoch_us(event_date), 'tie': CAST(event_id AS VARCHAR), 'c': ip_country, 'm': is_mobile, "
            f"'d': duration_seconds, 'ty': event_type, 'p': platform, 'b': browser, 'ch': channel}} END) OVER (PARTITION BY k ORDER BY t {HW.frame(f'{days} DAY')})")


COUNTS = {"digital_count_1h": count("1 HOUR"), "digital_count_24h": count("24 HOUR"), "digital_count_7d": count("7 DAY"),
          "digital_login_count_24h": count("24 HOUR", "event_type = 'Login'"), "digital_error_count_24h": count("24 HOUR", "event_type = 'Error'")}
LONG = {"digital_count_30d": count("30 DAY"), "digital_count_90d": count("90 DAY"),
        "digital_login_count_90d": count("90 DAY", "event_type = 'Login'"), "digital_error_count_90d": count("90 DAY", "event_type = 'Error'")}
LATEST = """(epoch_us(t) - l.a) / 1000000.0::DOUBLE AS digital_seconds_since_latest, (epoch_us(t) - l.e) / 1000000.0::DOUBLE AS digital_latest_event_age_seconds,
  CASE WHEN transaction_country IS NOT NULL AND l.c IS NOT NULL THEN CASE WHEN transaction_country <> l.c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS digital_latest_country_mismatch,
  CASE l.m WHEN true THEN 1.0::DOUBLE WHEN false THEN 0.0::DOUBLE END AS digital_latest_is_mobile, round(ln(1 + greatest(l.d, CASE WHEN l.d IS NOT NULL THEN 0 END)), 6) AS digital_latest_duration_log,
  CASE WHEN l IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS digital_available,
  l.ty AS digital_latest_type, CAST(NULL AS VARCHAR) AS digital_latest_category, l.p AS digital_latest_platform, l.b AS digital_latest_browser, l.ch AS digital_latest_channel"""


def stream_oracle(columns, days=7, tail="", source="card_events"):
    names = ", ".join(columns)
    inner = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return oracle(f"{source} digital_events", f"WITH {STREAM.replace('card_events', source)}, w AS (SELECT *, {inner}, {latest(days)} AS l FROM s) "
                  f"SELECT transaction_id, {names}{tail} FROM w WHERE transaction_id IS NOT NULL")


def features(b, days):
    return digital_features(b.card_events, b.digital_events, days).withColumn("digital_latest_duration_log", F.round("digital_latest_duration_log", 6))


@query("w10_digital_counts", stream_oracle({**COUNTS, **LONG}))
def _(b):
    return features(b, 90).select("transaction_id", *COUNTS, *LONG)


@query("w11_latest_available_event", stream_oracle({"digital_count_7d": COUNTS["digital_count_7d"]}, 7, ", " + LATEST))
def _(b):
    return features(b, 7).drop(*[c for c in COUNTS if c != "digital_count_7d"])


@query("w12_availability", oracle("digital_events", """
  SELECT event_id, CASE WHEN event_date IS NOT NULL AND process_date IS NOT NULL THEN greatest(event_date, CAST(process_date + 1 AS TIMESTAMP)) END AS available FROM digital_events"""))
def _(b):
    return b.digital_events.select("event_id", availability().alias("available"))


@query("j10_as_of_by_availability", oracle("card_events digital_events", f"""
  WITH {PAIRS}, best AS (
    SELECT DISTINCT customer_id, av, last_value(event_id) OVER w AS event_id, last_value(event_type) OVER w AS event_type FROM ev
    WINDOW w AS (PARTITION BY customer_id, av ORDER BY event_date, CAST(event_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  SELECT tx.transaction_id, CASE WHEN best.av >= t - INTERVAL 90 DAY THEN best.event_id END AS event_id,
    CASE WHEN best.av >= t - INTERVAL 90 DAY THEN best.event_type END AS event_type
  FROM tx ASOF LEFT JOIN best ON tx.customer_id = best.customer_id AND best.av < tx.t"""))
def _(b):
    tx = b.card_events.select("transaction_id", private_key("customer_id", "transaction_id").alias("customer_id"), epoch_us("transaction_date").alias("_t"))
    ev = available_events(b.digital_events).withColumn("event_category", F.lit(None).cast("string"))
    joined = tx.join(prior_windows(tx, "transaction_id", "_t", [digital_history(90)], facts=ev), "transaction_id")
    inside = F.col("d_latest.available_us") >= F.col("_t") - 90 * DAY
    return joined.select("transaction_id", F.when(inside, F.col("d_latest.tie").cast("bigint")).alias("event_id"),
                         F.when(inside, F.col("d_latest.type")).alias("event_type"))


@query("a31_history_coverage", oracle("card_events digital_events", f"""
  WITH {STREAM}, w AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in {**COUNTS, **LONG}.items())}, {latest(90)} AS l FROM s)
  SELECT CASE WHEN t < TIMESTAMP '2024-01-11' THEN 'fit' WHEN t < TIMESTAMP '2024-01-21' THEN 'selection' ELSE 'later' END AS period,
    CASE WHEN l IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS digital_available, count(*) AS rows, avg(digital_count_7d) AS mean_events_7d,
    avg(digital_count_30d) AS mean_events_30d, avg(digital_count_90d) AS mean_events_90d FROM w WHERE transaction_id IS NOT NULL GROUP BY ALL"""))
def _(b):
    at = F.col("transaction_date")
    period = F.when(at < F.lit("2024-01-11").cast("timestamp_ntz"), "fit").when(at < F.lit("2024-01-21").cast("timestamp_ntz"), "selection").otherwise("later")
    tx = b.card_events
    frame = tx.select("transaction_id", period.alias("period")).join(digital_features(tx, b.digital_events, 90), "transaction_id")
    return coverage(frame, "period", 90)


@query("m01_basic_frame", oracle("transactions", """
  SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, currency, transaction_type, channel, coalesce(transaction_country, '__missing__') AS transaction_country,
    coalesce(merchant_category, '__missing__') AS merchant_category, round(ln(1 + abs(CAST(amount AS DOUBLE))), 6) AS log_abs_amount,
    CASE WHEN amount > 0 THEN 1 WHEN amount < 0 THEN -1 WHEN amount = 0 THEN 0 END AS amount_sign,
    CAST(CASE WHEN currency = 'USD' THEN amount ELSE amount_usd END AS DOUBLE) AS amount_usd_norm, hour(transaction_date) AS hour,
    isodow(transaction_date) - 1 AS weekday, CASE WHEN isodow(transaction_date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM transactions"""))
def _(b):
    return basic_frame(b.transactions).withColumn("log_abs_amount", F.round("log_abs_amount", 6))


@query("x03_basic_select", oracle("transactions", """
  SELECT transaction_id, customer_id, product_id, transaction_date, is_fraud, CAST(amount AS DOUBLE) AS amount, currency, transaction_type, channel, transaction_country, merchant_category,
    round(ln(1 + abs(CAST(amount AS DOUBLE))), 6) AS log_abs_amount, CASE WHEN amount > 0 THEN 1 WHEN amount < 0 THEN -1 ELSE 0 END AS amount_sign,
    CAST(CASE WHEN currency = 'USD' THEN amount ELSE amount_usd END AS DOUBLE) AS amount_usd_norm, hour(transaction_date) AS hour,
    isodow(transaction_date) - 1 AS weekday, CASE WHEN isodow(transaction_date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM transactions"""))
def _(b):
    df = basic_select(b.transactions)
    return (df.withColumn("log_abs_amount", F.round("log_abs_amount", 6)).withColumn("amount", F.col("amount").cast("double"))
            .withColumn("amount_usd_norm", F.col("amount_usd_norm").cast("double")))


# Windows of the frames over day-granular transactions, in the oracle's words.
TX_BASE = HW.BASE.replace("card_events", "transactions")
CLOCK = """CAST(amount AS DOUBLE) AS amount, round(ln(1 + abs(CAST(amount AS DOUBLE))), 6) AS log_abs_amount, CAST(sign(amount) AS DOUBLE) AS amount_sign,
  CAST(CASE WHEN currency = 'USD' THEN amount ELSE amount_usd END AS DOUBLE) AS amount_usd_norm, CAST(hour(transaction_date) AS DOUBLE) AS hour,
  CAST(isodow(transaction_date) - 1 AS DOUBLE) AS weekday, CAST(isodow(transaction_date) >= 6 AS DOUBLE) AS is_weekend"""
KEYS = """transaction_id, customer_id, transaction_date, CASE WHEN is_fraud THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label"""
CATS = """currency, transaction_type, channel, coalesce(transaction_country, '__missing__') AS transaction_country, coalesce(merchant_category, '__missing__') AS merchant_category"""
CURRENCY = f"""CAST({HW.CURRENCY_N} AS DOUBLE) AS customer_same_currency_tx_count_30d, round({HW.MEAN}, 6) AS customer_same_currency_mean_abs_amount_30d,
  round(CASE WHEN {HW.CURRENCY_N} >= 5 AND {HW.CURRENCY_SUM} > 0 THEN abs(CAST(amount AS DOUBLE)) / ({HW.MEAN}) END, 6) AS customer_amount_ratio_30d"""
MERCHANT = HW.familiar("merchant_name", "customer_merchant_count_30d", "customer_new_merchant_30d")
POSITION = "CAST(lat AS DOUBLE) AS latitude_coarse, CAST(lon AS DOUBLE) AS longitude_coarse, CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS geo_present"
AVERAGES = f"""CAST(sum(lat) {HW.over('k', '30 DAY')} AS DOUBLE) / count(lat) {HW.over('k', '30 DAY')} AS mlat, CAST(sum(lon) {HW.over('k', '30 DAY')} AS DOUBLE) / count(lon) {HW.over('k', '30 DAY')} AS mlon"""
DISTANCE = """round(ln(1 + sqrt(pow((latitude_coarse - mlat) * 111.1::DOUBLE, 2) + pow((longitude_coarse - mlon) * 111.1::DOUBLE * cos(radians((latitude_coarse + mlat) / 2)), 2))), 6) AS geo_distance_km_from_mean_30d_log"""
NOVELTY = f"{KEYS}, {CLOCK}, {HW.VELOCITY}, {HW.PREVIOUS}, {CURRENCY}, {POSITION}, {MERCHANT}, {HW.GEO_COUNT}, {HW.NEW_GEO}, {AVERAGES}, {CATS}, coalesce(nullif(trim(transaction_category), ''), '__missing__') AS transaction_category"
ROUNDED = {"log_abs_amount": 6, "customer_same_currency_mean_abs_amount_30d": 6, "customer_amount_ratio_30d": 6, "geo_distance_km_from_mean_30d_log": 6,
           "customer_same_currency_std_amount_30d": 4, "customer_amount_zscore_30d": 4, "digital_latest_duration_log": 6}


def rounded(df):
    return df.select(*[F.round(c, ROUNDED[c]).alias(c) if c in ROUNDED else c for c in df.columns])


@query("m02_history_frame", oracle("transactions", f"""
  WITH {TX_BASE.replace('FROM transactions', 'FROM transactions WHERE is_fraud IS NOT NULL')} SELECT {KEYS}, {CLOCK}, {HW.VELOCITY}, {HW.PREVIOUS}, {CURRENCY}, {CATS} FROM base"""))
def _(b):
    return rounded(behaviour_frame(labelled(b.transactions), "history"))


@query("m02_novelty_frame", oracle("transactions", f"""
  WITH {TX_BASE.replace('FROM transactions', 'FROM transactions WHERE is_fraud IS NOT NULL')}, w AS (SELECT {NOVELTY} FROM base)
  SELECT * EXCLUDE (mlat, mlon), {DISTANCE} FROM w"""))
def _(b):
    return rounded(behaviour_frame(labelled(b.transactions), "novelty"))


COUNTRY = HW.familiar("transaction_country", "customer_country_tx_count_30d", "customer_new_country_30d").replace(
    "CAST(count(*) OVER (PARTITION BY k, transaction_country", "CAST(count(*) OVER (PARTITION BY k, b.transaction_country")
PRODUCT = ", ".join(f"CAST({p.rsplit(' AS ', 1)[0]} AS DOUBLE) AS {p.rsplit(' AS ', 1)[1]}" for p in [
    f"count(*) {HW.over('pk', '5 MINUTE')} AS product_tx_count_5m", f"count(*) {HW.over('pk', '1 HOUR')} AS product_tx_count_1h",
    f"sum(abs(amount)) {HW.over('pk, currency', '1 HOUR')} AS product_same_currency_abs_amount_sum_1h"])


def product_oracle(columns, extra=""):
    inner = NOVELTY.replace("coalesce(transaction_country, '__missing__') AS transaction_country", "coalesce(b.transaction_country, '__missing__') AS transaction_country")
    return f"{TX_BASE.replace('FROM transactions', 'FROM transactions WHERE is_fraud IS NOT NULL')}, w AS (SELECT {inner}, {PRODUCT}, {HW.ZSCORE}, " \
           f"{HW.familiar('b.transaction_country', 'customer_country_tx_count_30d', 'customer_new_country_30d')} FROM base b)"


@query("m03_product_frame", oracle("transactions", f"WITH {product_oracle('')} SELECT * EXCLUDE (mlat, mlon), {DISTANCE} FROM w"))
def _(b):
    return rounded(behaviour_frame(labelled(b.transactions), "product"))


@query("m04_digital_frame", stream_oracle({**COUNTS, **LONG}, 90, ", " + LATEST))
def _(b):
    return features(b, 90)


# The stand-in events end long after the last transaction, so the frame shifts them by whole days first.
SHIFT = 8300


@query("c13_training_frame", oracle("transactions digital_events", f"""
  WITH {product_oracle('')}, ev AS (SELECT * REPLACE (event_date - INTERVAL {SHIFT} DAY AS event_date, process_date - {SHIFT} AS process_date) FROM digital_events),
  known AS (SELECT *, greatest(event_date, CAST(process_date + 1 AS TIMESTAMP)) AS av FROM ev WHERE customer_id IS NOT NULL AND process_date IS NOT NULL),
  s AS (SELECT transaction_id, customer_id AS k, transaction_date AS t, transaction_country, NULL AS event_id, NULL AS event_date, NULL AS event_type, NULL AS ip_country,
      NULL AS is_mobile, NULL AS duration_seconds, NULL AS platform, NULL AS browser, NULL AS channel FROM transactions WHERE is_fraud IS NOT NULL
    UNION ALL SELECT NULL, customer_id, av, NULL, event_id, event_date, event_type, ip_country, is_mobile, duration_seconds, platform, browser, channel FROM known),
  dw AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in {**COUNTS, **LONG}.items())}, {latest(90)} AS l FROM s),
  d AS (SELECT transaction_id, {", ".join([*COUNTS, *LONG])}, {LATEST} FROM dw WHERE transaction_id IS NOT NULL)
  SELECT w.* EXCLUDE (mlat, mlon), {DISTANCE}, d.* EXCLUDE (transaction_id) FROM w JOIN d USING (transaction_id)"""))
def _(b):
    shift = F.expr(f"INTERVAL '{SHIFT}' DAY")
    events = b.digital_events.withColumn("event_date", F.col("event_date") - shift).withColumn("process_date", F.date_sub("process_date", SHIFT))
    return rounded(full_frame(labelled(b.transactions), events, 90))
