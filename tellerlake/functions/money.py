"""Amounts, currencies, credit and cost expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed list prices of the cost estimate (USD).
INPUT_USD_PER_MILLION = 2.143 * 0.07
OUTPUT_USD_PER_MILLION = 17.143 * 0.07
APP_USD_PER_HOUR = 0.5 * 0.75

# Fixed product labels that carry credit, in the source's two spellings.
CREDIT_TYPES = ("Tarjeta Crédito", "Préstamo Personal", "Préstamo Hipotecario", "Credit Card", "Personal Loan", "Mortgage")


def usd_amount(amount: Column, currency: Column, amount_usd: Column) -> Column:
    """USD rows keep their amount, others use the supplied conversion; currencies are never mixed."""
    return F.when(F.upper(F.trim(currency)) == "USD", amount).otherwise(amount_usd)


def usd_backfill(amount: Column, currency: Column, amount_usd: Column, rate: Column) -> Column:
    """Supplied conversion first, then the amount itself in USD, then the daily rate."""
    return F.coalesce(amount_usd, F.when(currency == "USD", amount).otherwise(F.round(amount * rate, 2)).cast("decimal(18,2)"))


def log_abs(amount: Column) -> Column:
    return F.log1p(F.abs(amount.cast("double")))


def sign_or_null(amount: Column) -> Column:
    """-1, 0 or 1; NULL for a missing amount."""
    return F.when(amount > 0, 1).when(amount < 0, -1).when(amount == 0, 0)


def sign_or_zero(amount: Column) -> Column:
    """Like `sign_or_null` with 0 for a missing amount."""
    return F.when(amount > 0, 1.0).when(amount < 0, -1.0).otherwise(0.0)


def is_credit(product_type: Column) -> Column:
    return product_type.isin(*CREDIT_TYPES)


def utilisation(balance: Column, limit: Column) -> Column:
    return F.when(limit > 0, F.round(balance / limit, 4))


def is_delinquent(days_past_due: Column) -> Column:
    return F.coalesce(days_past_due, F.lit(0)) > 0


def cost_usd(input_tokens: Column, output_tokens: Column, duration_ms: Column) -> Column:
    """Estimated cost; unknown token usage stays unknown."""
    tokens = input_tokens * F.lit(INPUT_USD_PER_MILLION) + output_tokens * F.lit(OUTPUT_USD_PER_MILLION)
    return F.when(input_tokens.isNotNull() & output_tokens.isNotNull(),
                  tokens / F.lit(1_000_000) + duration_ms / F.lit(3_600_000) * F.lit(APP_USD_PER_HOUR))
