"""Charges a customer describes, matched to the customer's movements, verified and decided by policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.functions.text import normalise
from tellerlake.operators.latest import insert_absent, newest_per_group

# Fixed values of matching and policy.
DATE_TOLERANCE_DAYS, SEARCH_WINDOW_DAYS, MAX_OPTIONS = 3, 60, 5
POLICY_VERSION = "dispute-policy-v1"
DISPUTE_WINDOW_DAYS, AUTO_MAX_AMOUNT_USD, FRAUD_SCORE_ESCALATE, MAX_OPEN_CASES_FOR_AUTO = 120, 500.0, 70.0, 2
DEBIT_TYPES = ("Purchase", "Payment", "Withdrawal", "Transfer")
DEAD_STATUSES = {"Declined": "NE_DECLINED", "Pending": "NE_PENDING", "Reversed": "NE_REVERSED"}
BUCKET_DAYS = 7


def _day_bucket(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / BUCKET_DAYS)


def _amount_bucket(amount: Column) -> Column:
    """Monotone in the amount: unit steps up to 100, then steps of 2 percent."""
    value = amount.cast("double")
    return F.when(value < 100, F.floor(value)).otherwise(100 + F.floor(F.log(F.greatest(value, F.lit(100.0)) / 100) / 0.02))


def tolerance(amount: Column, absolute: float = 1.0, relative: float = 0.01) -> Column:
    return F.greatest(F.lit(absolute).cast("decimal(18,4)"), (amount * F.lit(relative).cast("decimal(6,4)")).cast("decimal(18,4)"))


def candidate_charges(claims: DataFrame, transactions: DataFrame, absolute: float = 1.0, relative: float = 0.01) -> DataFrame:
    """Claim and movement pairs of the same customer inside the claim's days and amount tolerance.

    Both sides meet on (customer, week) and, when the claim names an amount, on an amount band too, so the pairs a
    task compares are near matches even for a customer with a large share of all movements.
    """
    exact = F.col("claim_date").isNotNull()
    first = F.when(exact, F.date_sub("claim_date", DATE_TOLERANCE_DAYS)).otherwise(F.date_sub("as_of", SEARCH_WINDOW_DAYS))
    last = F.when(exact, F.least(F.date_add("claim_date", DATE_TOLERANCE_DAYS), F.col("as_of"))).otherwise(F.col("as_of"))
    ranged = claims.withColumn("_first", first).withColumn("_last", last).where("_first <= _last").withColumn(
        "_week", F.explode(F.sequence(_day_bucket(F.col("_first")), _day_bucket(F.col("_last")))))
    slack = tolerance(F.col("claim_amount"), absolute, relative)
    priced = ranged.where(F.col("claim_amount").isNotNull()).withColumn("_slack", slack).withColumn("_band", F.explode(F.sequence(
        _amount_bucket(F.col("claim_amount") - F.col("_slack")), _amount_bucket(F.col("claim_amount") + F.col("_slack")))))
    day = F.to_date("transaction_date")
    tx = transactions.withColumn("_day", day).withColumn("_week", _day_bucket(day)).withColumn("_band", _amount_bucket(F.col("amount")))
    inside = F.col("_day").between(F.col("_first"), F.col("_last"))
    near = F.abs(F.col("amount") - F.col("claim_amount")) <= F.col("_slack")
    by_price = priced.join(tx, ["customer_id", "_week", "_band"]).where(inside & near)
    by_day = ranged.where(F.col("claim_amount").isNull()).join(tx.drop("_band"), ["customer_id", "_week"]).where(inside)
    return by_price.drop("_slack", "_band").unionByName(by_day).drop("_first", "_last", "_week", "_day")


def _plain_names(claims: DataFrame) -> DataFrame:
    """Claim side of `merchant_hit`, normalised once per claim rather than per pair."""
    return claims.withColumn("_slot", normalise(F.col("claim_merchant"))).withColumn("_said", normalise(F.col("claim_text")))


def merchant_hit() -> Column:
    """The merchant's name is in the conversation, in the named merchant, or contains it."""
    merchant, slot, said = F.col("_merchant"), F.col("_slot"), F.col("_said")
    named = F.coalesce(F.contains(merchant, slot) | F.contains(slot, merchant), F.lit(False))
    return F.coalesce((merchant != "") & (named | F.coalesce(F.contains(said, merchant), F.lit(False))), F.lit(False))


def match_charges(claims: DataFrame, transactions: DataFrame, absolute: float = 1.0, relative: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(outcome per claim, up to five newest options per claim).

    A claim's merchant counts as given when it is named, or when the conversation names the merchant of any
    movement inside the claim's days, whatever its amount.
    """
    transactions = transactions.select("transaction_id", "customer_id", "transaction_date", "amount", normalise(F.col("merchant_name")).alias("_merchant"))
    claims = _plain_names(claims)
    # "Any movement of the days" ignores the amount, so it is asked on (customer, week) alone, for claims with text.
    spoken = claims.where(F.col("claim_text").isNotNull() & F.col("claim_merchant").isNull()).withColumn("claim_amount", F.lit(None).cast("decimal(15,2)"))
    heard = candidate_charges(spoken, transactions).where(merchant_hit()).select("claim_id").distinct().withColumn("_heard", F.lit(True))
    given = F.col("claim_merchant").isNotNull() | F.coalesce("_heard", F.lit(False))
    criteria = F.col("merchant_given") | F.col("claim_amount").isNotNull() | F.col("claim_date").isNotNull()
    asked = claims.join(heard, "claim_id", "left").withColumn("merchant_given", given).drop("_heard").withColumn("has_criteria", criteria)
    pairs = candidate_charges(asked.where("has_criteria"), transactions, absolute, relative).where(~F.col("merchant_given") | merchant_hit())
    counts = pairs.groupBy("claim_id").agg(F.count(F.lit(1)).alias("_n"))
    matches = F.coalesce("_n", F.lit(0))
    outcome = (F.when(~F.col("has_criteria"), "ask_details").when(matches == 0, "no_match").when(matches == 1, "confirm")
               .when(matches <= MAX_OPTIONS, "select").otherwise("too_many"))
    decided = asked.join(counts, "claim_id", "left").select("claim_id", "customer_id", "merchant_given", matches.alias("matches"), outcome.alias("outcome"))
    order = [F.desc("transaction_date"), F.asc("transaction_id")]
    options = newest_per_group(pairs.select("claim_id", "transaction_id", "transaction_date"), ["claim_id"], order, MAX_OPTIONS, rank="option")
    return decided, options.drop("transaction_date")


def verify_claims(claims: DataFrame, products: DataFrame, transactions: DataFrame) -> DataFrame:
    """Claimed facts against bank rows; the bank's values win, and the first missing step is the reason."""
    owned = products.groupBy("customer_id").agg(F.lit(True).alias("_has_products"))
    cards = products.where("is_card").groupBy("customer_id", F.col("product_number_last4").alias("card_last4")).agg(F.min("product_id").alias("product_id"))
    moved = transactions.groupBy("customer_id", "product_id").agg(F.lit(True).alias("_has_movements"))
    base = claims.join(owned, "customer_id", "left").join(cards, ["customer_id", "card_last4"], "left").join(moved, ["customer_id", "product_id"], "left")
    merchant = F.lower(F.trim(F.coalesce("merchant_name", F.lit(""))))
    tx = transactions.select("customer_id", "product_id", F.to_date("transaction_date").alias("claim_date"), merchant.alias("_merchant"),
                             F.struct("transaction_id", "merchant_name", "amount", "currency", "transaction_status").alias("_tx"))
    asked = base.where(F.col("product_id").isNotNull()).withColumn("_merchant", F.lower(F.trim(F.coalesce("claim_merchant", F.lit("")))))
    near = F.abs(F.col("_tx.amount") - F.col("claim_amount")) < F.lit(0.01).cast("decimal(4,2)")
    found = asked.join(tx, ["customer_id", "product_id", "claim_date", "_merchant"]).where(near).groupBy("claim_id").agg(
        F.min_by("_tx", F.col("_tx.transaction_id")).alias("_tx"))
    reason = (F.when(F.col("_has_products").isNull(), "no_products").when(F.col("product_id").isNull(), "card_not_found")
              .when(F.col("_has_movements").isNull(), "no_movements").when(F.col("_tx").isNull(), "charge_not_found"))
    return base.join(found, "claim_id", "left").select(
        "claim_id", "customer_id", reason.alias("reason"), F.col("_tx.transaction_id").alias("transaction_id"), F.col("_tx.merchant_name").alias("merchant"),
        F.col("_tx.amount").alias("amount"), F.col("_tx.currency").alias("currency"), F.col("_tx.transaction_status").alias("transaction_status"))


def dispute_policy(charges: DataFrame, customers: DataFrame, disputes: DataFrame) -> DataFrame:
    """Outcome, fired rule ids and policy version for every charge (columns of the transaction plus `as_of`).

    Ineligibility rules apply in order and stop; escalation rules are all listed; otherwise intake is automatic.
    """
    open_disputes = disputes.groupBy("customer_id", "transaction_id").agg(F.lit(True).alias("_disputed"))
    df = charges.join(open_disputes, ["customer_id", "transaction_id"], "left").join(customers.select("customer_id", "open_cases", "customer_status"), "customer_id", "left")
    age = F.datediff("as_of", F.to_date("transaction_date"))
    status = F.when(F.lit(False), F.lit(""))
    for name, rule in DEAD_STATUSES.items():
        status = status.when(F.col("transaction_status") == name, F.lit(rule))
    ineligible = (F.when(F.col("_disputed"), "NE_ALREADY_DISPUTED").when(~F.col("transaction_type").isin(*DEBIT_TYPES), "NE_NOT_A_DEBIT")
                  .when(status.isNotNull(), status).when(age > DISPUTE_WINDOW_DAYS, "NE_TOO_OLD"))
    signal = F.coalesce(F.col("is_fraud"), F.lit(False)) | (F.coalesce(F.col("fraud_score").cast("double"), F.lit(0.0)) >= FRAUD_SCORE_ESCALATE)
    escalations = {
        "ESC_NO_USD": F.col("amount_usd").isNull(), "ESC_AMOUNT": F.col("amount_usd") > AUTO_MAX_AMOUNT_USD, "ESC_FRAUD_SIGNAL": signal,
        "ESC_OPEN_CASES": F.coalesce("open_cases", F.lit(0)) >= MAX_OPEN_CASES_FOR_AUTO,
        "ESC_CUSTOMER_STATUS": ~F.col("customer_status").eqNullSafe("Active"),
    }
    fired = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in escalations.items()]))
    df = df.withColumn("_ineligible", ineligible).withColumn("_fired", fired)
    outcome = F.when(F.col("_ineligible").isNotNull(), "NOT_ELIGIBLE").when(F.size("_fired") > 0, "ESCALATE").otherwise("AUTO")
    rules = F.when(F.col("_ineligible").isNotNull(), F.array("_ineligible")).when(F.size("_fired") > 0, F.col("_fired")).otherwise(F.array(F.lit("AUTO_OK")))
    return df.withColumn("outcome", outcome).withColumn("rules", rules).withColumn("policy_version", F.lit(POLICY_VERSION)).drop("_disputed", "_ineligible", "_fired")


def triage(claims: DataFrame, transactions: DataFrame, customers: DataFrame, disputes: DataFrame) -> DataFrame:
    """New dispute cases for claims with exactly one matching charge; existing cases are never duplicated."""
    decided, options = match_charges(claims, transactions)
    unique = decided.where("outcome = 'confirm'").join(options, "claim_id").select("claim_id", "transaction_id")
    charges = unique.join(transactions, "transaction_id").join(claims.select("claim_id", "as_of"), "claim_id")
    cases = dispute_policy(charges, customers, disputes).where("outcome <> 'NOT_ELIGIBLE'")
    new = cases.select(
        F.concat(F.lit("DSP-"), "transaction_id").alias("case_id"), "customer_id", "transaction_id", "claim_id",
        F.when(F.col("outcome") == "AUTO", "Open").otherwise("Escalated").alias("status"), F.when(F.col("outcome") == "AUTO", "AUTO").otherwise("HUMAN").alias("route"),
        "amount", "currency", "amount_usd", F.to_json("rules").alias("policy_rules"))
    return insert_absent(disputes.select("case_id"), new, ["case_id"], ["claim_id"])
