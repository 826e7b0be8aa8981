"""Point-in-time features on small boundary cases."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tellerlake.operators import history as H
from tellerlake.operators.digital import digital_features
from tellerlake.plans.training import behaviour_frame, check_predictors, labelled

T = dt.datetime(2025, 3, 10, 12, 0, 0)
SCHEMA = ("transaction_id string, customer_id string, product_id string, transaction_date timestamp_ntz, amount decimal(15,2), currency string, amount_usd decimal(15,2), "
          "transaction_type string, channel string, transaction_country string, merchant_category string, transaction_category string, merchant_name string, "
          "latitude decimal(10,7), longitude decimal(10,7), is_fraud boolean")


def tx(i, at, amount=10, currency="USD", customer="c1", product="p1", country="AR", merchant="m1", lat=1, lon=2, fraud=False):
    from decimal import Decimal
    d = Decimal(str(amount)) if amount is not None else None
    return (i, customer, product, at, d, currency, None, "Purchase", "App", country, "mcc", " ", merchant, Decimal(lat) if lat is not None else None, Decimal(lon) if lon is not None else None, fraud)


def frame(spark, data, level="product"):
    df = labelled(spark.createDataFrame(data, SCHEMA))
    return {r["transaction_id"]: r.asDict() for r in behaviour_frame(df, level).collect()}


def test_same_time_rows_do_not_see_each_other(spark):
    hour = dt.timedelta(hours=1)
    got = frame(spark, [tx("a", T - hour), tx("b", T), tx("c", T), tx("d", T + hour, customer="c2")])
    assert [got[i]["customer_tx_count_1h"] for i in "abcd"] == [0, 1, 1, 0]
    assert got["b"]["seconds_since_prev_tx"] == 3600 and got["a"]["seconds_since_prev_tx"] is None


def test_ratio_needs_five_prior_rows_of_one_currency(spark):
    day = dt.timedelta(days=1)
    data = [tx(f"h{i}", T - day * (i + 1), 10) for i in range(5)] + [tx("cop", T - day, 900, "COP"), tx("now", T, 30), tx("cop2", T + day, 5, "COP"), tx("later", T + 2 * day, 99)]
    got = frame(spark, data)
    assert got["now"]["customer_amount_ratio_30d"] == pytest.approx(3.0)
    assert got["now"]["customer_same_currency_tx_count_30d"] == 5
    assert got["cop2"]["customer_amount_ratio_30d"] is None
    assert got["now"]["customer_same_currency_std_amount_30d"] == 0.0 and got["now"]["customer_amount_zscore_30d"] is None


def test_product_velocity_and_zscore(spark):
    minute = dt.timedelta(minutes=1)
    data = [tx(f"p{i}", T - minute * (5 - i), 10 * (i + 1)) for i in range(5)] + [tx("cop", T - minute, 999, "COP"), tx("x", T, 80), tx("y", T, 80)]
    got = frame(spark, data)["x"]
    assert got["product_tx_count_5m"] == 6
    assert got["product_same_currency_abs_amount_sum_1h"] == 150
    assert got["customer_amount_zscore_30d"] == pytest.approx((80 - 30) / statistics.stdev([10, 20, 30, 40, 50]))
    assert got["customer_amount_zscore_30d"] == pytest.approx(50 / math.sqrt(250))
    assert got["customer_new_country_30d"] == 0.0


def test_missing_customer_has_no_history_and_empty_geo_frame_is_null(spark):
    day = dt.timedelta(days=1)
    got = frame(spark, [tx("a", T - day, customer=None), tx("b", T, customer=None), tx("c", T, customer="z", lat=None)])
    assert got["b"]["customer_tx_count_7d"] == 0
    assert got["b"]["customer_prior_geo_count_30d"] is None
    assert got["c"]["customer_new_geo_30d"] is None and got["c"]["geo_present"] == 0.0
    assert got["a"]["transaction_category"] == "__missing__"


def test_labels_never_become_predictors():
    with pytest.raises(ValueError):
        check_predictors(["amount", "fraud_score"])
    with pytest.raises(ValueError):
        check_predictors(["label"])


EVENTS = ("event_id string, customer_id string, event_date timestamp_ntz, process_date date, event_type string, ip_country string, is_mobile boolean, duration_seconds int, "
          "platform string, browser string, channel string")


def ev(i, at, process=None, customer="c1", country="AR", kind="view"):
    return (i, customer, at, process or (at - dt.timedelta(days=1)).date(), kind, country, True, 5, "iOS", "B", "App")


def test_digital_history_boundaries(spark):
    h, d = dt.timedelta(hours=1), dt.timedelta(days=1)
    events = [ev("1", T - h), ev("2", T - d), ev("3", T - 7 * d, kind="Login"), ev("4", T), ev("5", T + dt.timedelta(seconds=1)),
              ev("6", T - h, process=T.date()), ev("7", T - h, customer="c2"), ev("8", T - h, customer=None), ev("9", T - h, country="BR")]
    tx_df = spark.createDataFrame([("t", "c1", T, "AR")], "transaction_id string, customer_id string, transaction_date timestamp_ntz, transaction_country string")
    row = digital_features(tx_df, spark.createDataFrame(events, EVENTS), 7).first()
    assert row["digital_count_7d"] == 4  # 1, 2, 3 and 9; same-day delivery, same time, future and other customers are out
    assert row["digital_count_1h"] == 2
    assert row["digital_latest_country_mismatch"] == 1.0  # 9 wins the tie with 1 by the larger id
    assert row["digital_seconds_since_latest"] == 3600.0


def test_digital_history_long_lookback(spark):
    d = dt.timedelta(days=1)
    events = [ev("1", T - 7 * d), ev("2", T - 30 * d), ev("3", T - 90 * d, kind="Error"), ev("4", T - 91 * d), ev("5", T - 7 * d)]
    tx_df = spark.createDataFrame([("t", "c1", T, "AR"), ("u", None, T, "AR")], "transaction_id string, customer_id string, transaction_date timestamp_ntz, transaction_country string")
    got = {r["transaction_id"]: r for r in digital_features(tx_df, spark.createDataFrame(events, EVENTS), 90).collect()}
    assert [got["t"][f"digital_count_{w}"] for w in ("7d", "30d", "90d")] == [2, 3, 4]
    assert got["t"]["digital_error_count_90d"] == 1
    assert got["u"]["digital_available"] == 0.0 and got["u"]["digital_count_90d"] == 0


def test_histories_agree_over_one_and_many_partitions(spark):
    import random

    r = random.Random(8)
    data = [tx(str(i), T + dt.timedelta(minutes=r.randrange(0, 60 * 24 * 40)), r.randrange(1, 50), r.choice(["USD", "COP", None]), r.choice(["c1", "c1", "c2", None]), r.choice(["p1", "p2"]),
               r.choice(["AR", None]), r.choice(["m1", "m2", None]), r.choice([1, 2, None]), r.choice([2, 3])) for i in range(200)]
    whole = frame(spark, data)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert frame(spark, data) == whole
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_coarse_position_is_exact(spark):
    row = spark.range(1).select(H.coarse(F.lit("12.25").cast("decimal(10,7)")).alias("x")).first()
    assert float(row["x"]) == 12.3


def test_model_frames_are_written_once(spark):
    """Preparation and training make many passes over frames that no longer hold the join."""
    from tellerlake.catalog.model_training import frames
    from tellerlake.standin import Bank

    for frame in frames(Bank(spark, "/root/testdata/sf0.001")):
        assert frame.count() and "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()
