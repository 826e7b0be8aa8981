"""Point-in-time windows on sub-day card events and on day-granular transactions (ties)."""

from pyspark.sql import functions as F

from tellerlake.operators import history as H
from tellerlake.registry import query
from tellerlake.standin import oracle


def frame(length: str) -> str:
    return f"RANGE BETWEEN INTERVAL {length} PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"


BASE = """base AS (SELECT *, coalesce(customer_id, '__missing__' || transaction_id) AS k, coalesce(product_id, '__missing__' || transaction_id) AS pk,
  round(latitude, 1) AS lat, round(longitude, 1) AS lon FROM card_events)"""


def over(partition: str, length: str) -> str:
    return f"OVER (PARTITION BY {partition} ORDER BY transaction_date {frame(length)})"


def history_oracle(columns: str, source: str = "card_events") -> str:
    return oracle(source, f"WITH {BASE.replace('card_events', source)} SELECT transaction_id, {columns} FROM base")


def select(b, histories, features, rounded=(), source="card_events"):
    df = H.timeline(getattr(b, source))
    out = H.with_history(df, histories, features)
    return out.select("transaction_id", *[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in features])


VELOCITY = f"""CAST(count(*) {over('k', '1 HOUR')} AS DOUBLE) AS customer_tx_count_1h, CAST(count(*) {over('k', '24 HOUR')} AS DOUBLE) AS customer_tx_count_24h,
  CAST(count(*) {over('k', '7 DAY')} AS DOUBLE) AS customer_tx_count_7d"""
PREVIOUS = """(epoch_us(transaction_date) - max(epoch_us(transaction_date)) OVER (PARTITION BY k ORDER BY transaction_date
  RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)) / 1000000.0::DOUBLE AS seconds_since_prev_tx"""


@query("w04_prior_velocity", history_oracle(VELOCITY))
def _(b):
    features = {n: c for n, c in H.velocity_features().items() if n.startswith("customer_tx")}
    return select(b, [H.velocity()], features)


@query("w04_prior_velocity_ties", history_oracle(VELOCITY, "transactions"))
def _(b):
    features = {n: c for n, c in H.velocity_features().items() if n.startswith("customer_tx")}
    return select(b, [H.velocity()], features, source="transactions")


@query("w05_seconds_since_previous", history_oracle(PREVIOUS))
def _(b):
    return select(b, [H.velocity()], {"seconds_since_prev_tx": H.velocity_features()["seconds_since_prev_tx"]})


CURRENCY_N, CURRENCY_SUM = f"count(*) {over('k, currency', '30 DAY')}", f"sum(abs(amount)) {over('k, currency', '30 DAY')}"
MEAN = f"CAST({CURRENCY_SUM} AS DOUBLE) / count(amount) {over('k, currency', '30 DAY')}"


@query("w06_same_currency_history", history_oracle(f"""CAST({CURRENCY_N} AS DOUBLE) AS customer_same_currency_tx_count_30d,
  round({MEAN}, 6) AS customer_same_currency_mean_abs_amount_30d,
  round(CASE WHEN {CURRENCY_N} >= 5 AND {CURRENCY_SUM} > 0 THEN abs(CAST(amount AS DOUBLE)) / ({MEAN}) END, 6) AS customer_amount_ratio_30d"""))
def _(b):
    return select(b, [H.same_currency()], H.currency_features(), ("customer_same_currency_mean_abs_amount_30d", "customer_amount_ratio_30d"))


def familiar(column, name, new):
    n = f"count(*) {over('k, ' + column, '30 DAY')}"
    return (f"CASE WHEN {column} IS NOT NULL THEN CAST({n} AS DOUBLE) END AS {name}, "
            f"CASE WHEN {column} IS NOT NULL THEN CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS {new}")


@query("w07_merchant_familiarity", history_oracle(familiar("merchant_name", "customer_merchant_count_30d", "customer_new_merchant_30d")))
def _(b):
    return select(b, [H.merchant_familiarity()], H.merchant_features())


LOCATED = "lat IS NOT NULL AND lon IS NOT NULL"
GEO_COUNT = f"CAST(sum(CASE WHEN {LOCATED} THEN 1 ELSE 0 END) {over('k', '30 DAY')} AS DOUBLE) AS customer_prior_geo_count_30d"
NEW_GEO = f"CASE WHEN {LOCATED} THEN CASE WHEN count(*) {over('k, lat, lon', '30 DAY')} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS customer_new_geo_30d"


def distance(source):
    return oracle(source, f"""WITH {BASE.replace('card_events', source)}, m AS (
      SELECT transaction_id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, CAST(sum(lat) {over('k', '30 DAY')} AS DOUBLE) / count(lat) {over('k', '30 DAY')} AS mlat,
        CAST(sum(lon) {over('k', '30 DAY')} AS DOUBLE) / count(lon) {over('k', '30 DAY')} AS mlon FROM base)
      SELECT transaction_id, round(ln(1 + sqrt(pow((lat - mlat) * 111.1::DOUBLE, 2) + pow((lon - mlon) * 111.1::DOUBLE * cos(radians((lat + mlat) / 2)), 2))), 6)
        AS geo_distance_km_from_mean_30d_log FROM m""")


@query("w08_geo_novelty", history_oracle(f"{GEO_COUNT}, {NEW_GEO}"))
def _(b):
    features = H.geo_features()
    features.pop("geo_distance_km_from_mean_30d_log")
    return select(b, [H.geo_position(), H.geo_bin()], features)


@query("w09_geo_distance", distance("card_events"))
def _(b):
    name = "geo_distance_km_from_mean_30d_log"
    return select(b, [H.geo_position(), H.geo_bin()], {name: H.geo_features()[name]}, (name,))


PRODUCT = f"""count(*) {over('pk', '5 MINUTE')} AS product_tx_count_5m, count(*) {over('pk', '1 HOUR')} AS product_tx_count_1h,
  CAST(sum(abs(amount)) {over('pk, currency', '1 HOUR')} AS DOUBLE) AS product_same_currency_abs_amount_sum_1h"""


@query("w13_product_velocity", history_oracle(PRODUCT))
def _(b):
    return select(b, [H.product_velocity(), H.product_amounts()], H.product_features())


STD = f"stddev_samp(abs(CAST(amount AS DOUBLE))) {over('k, currency', '30 DAY')}"
ZSCORE = f"""round({STD}, 4) AS customer_same_currency_std_amount_30d, round(CASE WHEN count(amount) {over('k, currency', '30 DAY')} >= 5 AND {STD} > 0
  THEN (abs(CAST(amount AS DOUBLE)) - {MEAN}) / {STD} END, 4) AS customer_amount_zscore_30d"""


@query("w14_amount_zscore", history_oracle(ZSCORE))
def _(b):
    out = H.with_history(H.timeline(b.card_events), [H.amount_spread()], H.zscore_features())
    return out.select("transaction_id", *[F.round(c, 4).alias(c) for c in H.zscore_features()])


@query("w15_country_familiarity", history_oracle(familiar("transaction_country", "customer_country_tx_count_30d", "customer_new_country_30d")))
def _(b):
    return select(b, [H.country_familiarity()], H.country_features())


@query("w25_session_novelty", oracle("card_events digital_events", """
  WITH tx AS (SELECT transaction_id, customer_id AS k, transaction_date AS t FROM card_events WHERE customer_id IS NOT NULL)
  SELECT tx.transaction_id, count(DISTINCT session_id) FILTER (WHERE event_date >= t - INTERVAL 1 HOUR) AS distinct_sessions_1h,
    count(*) FILTER (WHERE platform = 'Web') AS web_events_30d, arg_max(ip_country, event_date) FILTER (WHERE ip_country IS NOT NULL) AS last_country
  FROM tx LEFT JOIN digital_events d ON d.customer_id = tx.k AND d.event_date < t AND d.event_date >= t - INTERVAL 30 DAY GROUP BY 1"""))
def _(b):
    from tellerlake.operators.running import DAY, HOUR, History, epoch_us, prior_windows

    tx = b.card_events.where("customer_id IS NOT NULL").select("transaction_id", "customer_id", epoch_us("transaction_date").alias("_t"))
    ev = b.digital_events.where("customer_id IS NOT NULL").withColumn("_t", epoch_us("event_date"))
    sessions = H.open_interval_distinct(ev, ["customer_id"], "session_id", "_t", tx, "transaction_id", HOUR)
    recent = prior_windows(tx, "transaction_id", "_t", [History(
        "d", ["customer_id"], {"30d": 30 * DAY}, {"web": F.when(F.col("platform") == "Web", 1).otherwise(0).cast("bigint")},
        {"country": F.when(F.col("ip_country").isNotNull(), F.struct("_t", "event_id", "ip_country"))})], facts=ev)
    last = F.when(F.col("d_country._t") >= F.col("_t") - 30 * DAY, F.col("d_country.ip_country"))
    return (tx.join(recent, "transaction_id").join(sessions, "transaction_id")
            .select("transaction_id", F.col("distinct_members").alias("distinct_sessions_1h"), F.col("d_web_30d").alias("web_events_30d"), last.alias("last_country")))
