"""Point-in-time behaviour of customers and products over `[T - d, T)`."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.operators.running import DAY, HOUR, MINUTE, SECOND, History, accumulate_before, epoch_us, prior_windows

THIRTY_DAYS = 30 * DAY
KM_PER_DEGREE = 111.1
MIN_HISTORY = 5


def private_key(key: str, row_id: str) -> Column:
    """Rows without a key get one of their own, so they never share history."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("__missing__"), F.col(row_id).cast("string")))


def coarse(coordinate: Column) -> Column:
    """Roughly city scale: one decimal, kept exact."""
    return F.round(coordinate.cast("decimal(10,7)"), 1).cast("decimal(6,1)")


def tenths(bin_: Column) -> Column:
    return (bin_ * 10).cast("bigint")


def _one() -> Column:
    return F.lit(1).cast("bigint")


def cents(amount: str) -> Column:
    """Absolute amount in exact integer cents: sums stay in fast 64-bit arithmetic (overflow is an error)."""
    return (F.abs(F.col(amount).cast("decimal(15,2)")) * 100).cast("bigint")


def timeline(df: DataFrame, row_id: str = "transaction_id", at: str = "transaction_date") -> DataFrame:
    """Order column, private keys and coarse position shared by every history below."""
    df = df.withColumn("_t", epoch_us(at))
    for key in ("customer_id", "product_id"):
        if key in df.columns:
            df = df.withColumn(f"_{key}", private_key(key, row_id))
    if "latitude" in df.columns:
        df = df.withColumn("_lat", coarse(F.col("latitude"))).withColumn("_lon", coarse(F.col("longitude")))
        df = df.withColumn("_located", F.col("_lat").isNotNull() & F.col("_lon").isNotNull())
    return df


# ---- what is totalled, per kind of history

def velocity() -> History:
    return History("customer", ["_customer_id"], {"1h": HOUR, "24h": 24 * HOUR, "7d": 7 * DAY}, {"n": _one()},
                   {"previous": F.col("_t")})


def same_currency() -> History:
    """Counts rows and non-null amounts, sums amounts and squares: mean, deviation and ratio follow exactly."""
    amount = cents("amount")
    return History("currency", ["_customer_id", "currency"], {"30d": THIRTY_DAYS},
                   {"n": _one(), "amounts": F.when(F.col("amount").isNotNull(), 1).cast("bigint"),
                    "cents": amount})


def amount_spread() -> History:
    """As `same_currency`, with squares (in cents) for the deviation; they need decimals."""
    base, amount = same_currency(), cents("amount").cast("decimal(15,0)")
    return replace(base, sums={**base.sums, "squares": amount * amount})


def merchant_familiarity() -> History:
    return History("merchant", ["_customer_id", "merchant_name"], {"30d": THIRTY_DAYS}, {"n": _one()})


def country_familiarity() -> History:
    return History("country", ["_customer_id", "transaction_country"], {"30d": THIRTY_DAYS}, {"n": _one()})


def geo_position() -> History:
    def present(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), 1).cast("bigint")
    return History("geo", ["_customer_id"], {"30d": THIRTY_DAYS},
                   {"n": _one(), "located": F.when(F.col("_located"), 1).otherwise(0).cast("bigint"),
                    "lats": present("_lat"), "lat": tenths(F.col("_lat")), "lons": present("_lon"), "lon": tenths(F.col("_lon"))})


def geo_bin() -> History:
    return History("bin", ["_customer_id", "_lat", "_lon"], {"30d": THIRTY_DAYS}, {"n": _one()})


def product_velocity() -> History:
    return History("product", ["_product_id"], {"5m": 5 * MINUTE, "1h": HOUR}, {"n": _one()})


def product_amounts() -> History:
    return History("spend", ["_product_id", "currency"], {"1h": HOUR}, {"n": F.when(F.col("amount").isNotNull(), 1).cast("bigint"), "cents": cents("amount")})


# ---- named features from those totals

def _familiar(count: str, known: Column) -> tuple[Column, Column]:
    n = F.col(count).cast("double")
    return F.when(known, n), F.when(known, F.when(n == 0, 1.0).otherwise(0.0))


def velocity_features() -> dict[str, Column]:
    out = {f"customer_tx_count_{f}": F.col(f"customer_n_{f}").cast("double") for f in ("1h", "24h", "7d")}
    out["seconds_since_prev_tx"] = (F.col("_t") - F.col("customer_previous")) / F.lit(float(SECOND))
    return out


def currency_features() -> dict[str, Column]:
    n, mean = F.col("currency_n_30d").cast("double"), F.col("currency_cents_30d") / 100.0 / F.col("currency_amounts_30d")
    mean = F.when(F.col("currency_amounts_30d") > 0, mean)
    return {
        "customer_same_currency_tx_count_30d": n,
        "customer_same_currency_mean_abs_amount_30d": mean,
        "customer_amount_ratio_30d": F.when((n >= MIN_HISTORY) & (mean > 0), F.abs(F.col("amount").cast("double")) / mean),
    }


def zscore_features() -> dict[str, Column]:
    n, total, squares = (F.col(f"currency_{m}_30d") for m in ("amounts", "cents", "squares"))
    # n * sum of squares - square of the sum is exact in decimals: equal amounts give exactly zero.
    whole = total.cast("decimal(18,0)")
    spread = (n.cast("decimal(10,0)") * squares.cast("decimal(27,0)") - whole * whole).cast("double")
    std = F.when(n >= 2, F.sqrt(spread / (n.cast("double") * (n - 1).cast("double"))) / 100.0)
    mean = F.when(n > 0, total / 100.0 / n)
    return {
        "customer_same_currency_std_amount_30d": std,
        "customer_amount_zscore_30d": F.when((n >= MIN_HISTORY) & (std > 0), (F.abs(F.col("amount").cast("double")) - mean) / std),
    }


def merchant_features() -> dict[str, Column]:
    n, new = _familiar("merchant_n_30d", F.col("merchant_name").isNotNull())
    return {"customer_merchant_count_30d": n, "customer_new_merchant_30d": new}


def country_features() -> dict[str, Column]:
    n, new = _familiar("country_n_30d", F.col("transaction_country").isNotNull())
    return {"customer_country_tx_count_30d": n, "customer_new_country_30d": new}


def geo_features() -> dict[str, Column]:
    """An empty frame leaves the located count NULL, as a sum does, while other counts are 0."""
    def mean(c: str) -> Column:
        return F.when(F.col(f"geo_{c}s_30d") > 0, F.col(f"geo_{c}_30d") / 10.0 / F.col(f"geo_{c}s_30d"))
    lat, lon, mean_lat, mean_lon = F.col("_lat").cast("double"), F.col("_lon").cast("double"), mean("lat"), mean("lon")
    north = (lat - mean_lat) * KM_PER_DEGREE
    east = (lon - mean_lon) * KM_PER_DEGREE * F.cos(F.radians((lat + mean_lat) / 2.0))
    _, new = _familiar("bin_n_30d", F.col("_located"))
    return {
        "customer_prior_geo_count_30d": F.when(F.col("geo_n_30d") > 0, F.col("geo_located_30d").cast("double")),
        "customer_new_geo_30d": new,
        "geo_distance_km_from_mean_30d_log": F.when(F.col("_located"), F.log1p(F.sqrt(north * north + east * east))),
    }


def product_features() -> dict[str, Column]:
    return {
        "product_tx_count_5m": F.col("product_n_5m"), "product_tx_count_1h": F.col("product_n_1h"),
        "product_same_currency_abs_amount_sum_1h": F.when(F.col("spend_n_1h") > 0, F.col("spend_cents_1h") / 100.0),
    }


def with_history(df: DataFrame, histories: list[History], features: dict[str, Column], row_id: str = "transaction_id") -> DataFrame:
    """`df` (already through `timeline`) plus the named features, one row per row id."""
    totals = prior_windows(df, row_id, "_t", histories)
    joined = df.join(totals, row_id, "left")
    return joined.select(*df.columns, *[c.alias(name) for name, c in features.items()])


def open_interval_distinct(facts: DataFrame, keys: list[str], member: str, at: str, probes: DataFrame, row_id: str, length: int) -> DataFrame:
    """Distinct `member` values seen in `[T - length, T)` for every probe, without collecting a set per row.

    A sighting at e covers the probe times (e, e + length]. The covered times of one member form disjoint
    intervals; the distinct count at T is the number of intervals open at T: starts before T minus ends before T.
    A sighting starts an interval when no earlier one of the same member lies within `length`; it ends one when
    no later one does, and "no later one" is the same question on the mirrored timeline.
    """
    seen = facts.select(*keys, member, F.col(at).alias("_e")).where(F.col(member).isNotNull()).distinct()
    group = [*keys, member]
    back = accumulate_before(seen.withColumn("_last", F.col("_e")), group, "_e", latest=["_last"])
    starts = back.where(F.col("_last").isNull() | (F.col("_e") - F.col("_last") > length)).select(*keys, F.col("_e").alias("_at"), F.lit(1).alias("_delta"))
    ahead = accumulate_before(seen.withColumn("_m", -F.col("_e")).withColumn("_next", -F.col("_e")), group, "_m", latest=["_next"])
    ends = ahead.where(F.col("_next").isNull() | (-F.col("_next") - F.col("_e") > length)).select(*keys, (F.col("_e") + length).alias("_at"), F.lit(-1).alias("_delta"))
    line = starts.unionByName(ends).unionByName(probes.select(*keys, row_id, F.col(at).alias("_at")), allowMissingColumns=True)
    done = accumulate_before(line, keys, "_at", ["_delta"])
    return done.where(F.col(row_id).isNotNull()).select(row_id, F.coalesce(F.col("_delta"), F.lit(0)).alias("distinct_members"))
