"""Month-end savings balances rebuilt backwards from today's balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellerlake.operators.running import accumulate_before, epoch_us

MONTHS = 12


def cents(c: str) -> Column:
    return (F.col(c).cast("decimal(15,2)") * 100).cast("bigint")


def signed_cents() -> Column:
    """A deposit adds; withdrawals, payments and transfers take."""
    return F.when(F.col("transaction_type") == "Deposit", cents("amount")).otherwise(-cents("amount"))


def window_start(now: str) -> Column:
    """First day of the window: the 1st of the month eleven months before `now`."""
    return F.add_months(F.trunc(F.lit(now).cast("date"), "month"), -(MONTHS - 1))


def savings_history(accounts: DataFrame, movements: DataFrame, now: str) -> DataFrame:
    """(customer, currency, month, balance) for currencies whose balance never was negative inside the window.

    `accounts`: customer_id, currency, current_balance. `movements`: customer_id, currency, transaction_date,
    transaction_type, amount. Movements at one instant are one step, so the result does not depend on row order.
    """
    keys = ["customer_id", "currency"]
    current = accounts.groupBy(*keys).agg(F.coalesce(F.sum(cents("current_balance")), F.lit(0)).alias("_current"))
    inside = movements.where(F.to_date("transaction_date") >= window_start(now))
    steps = inside.groupBy(*keys, epoch_us("transaction_date").alias("_t")).agg(F.sum(signed_cents()).alias("_net")).withColumn("_back", -F.col("_t")).withColumn("_later", F.col("_net"))
    undone = accumulate_before(steps, keys, "_back", ["_later"])
    lowest = undone.groupBy(*keys).agg(F.max(F.coalesce("_later", F.lit(0)) + F.col("_net")).alias("_deepest"))
    sound = current.join(lowest, keys, "left").where((F.col("_current") >= 0) & (F.coalesce("_deepest", F.lit(0)) <= F.col("_current"))).select(*keys, "_current")
    month = F.trunc(F.to_date("transaction_date"), "month")
    monthly = inside.groupBy(*keys, month.alias("_month")).agg(F.sum(signed_cents()).alias("_net"))
    last = F.trunc(F.lit(now).cast("date"), "month")
    spine = sound.withColumn("_month", F.explode(F.sequence(window_start(now), last, F.expr("INTERVAL 1 MONTH"))))
    # Later months only: at most twelve rows per customer and currency. Movements dated after the last month count too.
    beyond = monthly.where(F.col("_month") > last).groupBy(*keys).agg(F.sum("_net").alias("_beyond"))
    after = Window.partitionBy(*keys).orderBy("_month").rowsBetween(1, Window.unboundedFollowing)
    joined = spine.join(monthly, [*keys, "_month"], "left").join(beyond, keys, "left")
    balance = F.col("_current") - F.coalesce(F.sum("_net").over(after), F.lit(0)) - F.coalesce("_beyond", F.lit(0))
    return joined.select(*keys, F.date_format("_month", "yyyy-MM").alias("month"), (balance / 100).alias("balance"))
