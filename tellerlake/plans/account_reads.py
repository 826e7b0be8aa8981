"""What one customer may read, for one customer (SQL table functions) and for all customers at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellerlake.functions.text import mask_sensitive
from tellerlake.operators.latest import newest_per_group

# Fixed product labels shown to customers, in the source's two spellings.
CARD_TYPES = ("Tarjeta Crédito", "Credit Card")
SAVINGS_TYPES = ("Cuenta Ahorro", "Savings Account")


def shown_products(products: DataFrame) -> DataFrame:
    """Active cards and savings accounts; available credit for cards only."""
    available = F.when(F.col("product_type").isin(*CARD_TYPES), F.col("credit_limit") - F.col("current_balance"))
    return products.where(F.col("product_type").isin(*CARD_TYPES, *SAVINGS_TYPES) & (F.col("product_status") == "Active")).withColumn("available_credit", available)


def owned_movements(transactions: DataFrame, products: DataFrame, last4: str | None = None) -> DataFrame:
    """Movements joined on product and customer, never on the product alone; `last4` filters only when given."""
    own = shown_products(products)
    if last4 is not None:
        own = own.where(F.col("product_number_last4") == last4)
    own = own.select("product_id", "customer_id", "product_type", "product_number_last4")
    return transactions.drop("product_type").join(own, ["product_id", "customer_id"])


def newest_movements(transactions: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """The newest `n` movements of every shown product."""
    return newest_per_group(owned_movements(transactions, products), ["customer_id", "product_id"], [F.desc("transaction_date"), F.asc("transaction_id")], n)


def newest_charge(transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Each customer's newest charge with a merchant on an active card."""
    cards = owned_movements(transactions, products).where(F.col("product_type").isin(*CARD_TYPES))
    usable = cards.where((F.coalesce("merchant_name", F.lit("")) != "") & F.col("amount").isNotNull() & F.col("transaction_date").isNotNull())
    row = F.struct("transaction_id", "transaction_date", "merchant_name", "amount", "currency", "product_number_last4")
    # Newest first; the lowest id among equal times.
    newest = usable.groupBy("customer_id", "transaction_date").agg(F.min_by(row, "transaction_id").alias("c"))
    return newest.groupBy("customer_id").agg(F.max_by("c", "transaction_date").alias("c")).select("customer_id", "c.*")


def recent_context(interactions: DataFrame, transcripts: DataFrame, n: int = 10) -> DataFrame:
    """The newest `n` interactions per customer with their transcript text masked."""
    recent = newest_per_group(interactions.select("customer_id", "interaction_id", "interaction_date", "channel", "contact_reason"), ["customer_id"],
                              [F.desc("interaction_date"), F.asc("interaction_id")], n)
    return recent.join(transcripts, "interaction_id", "left").withColumn("full_text", mask_sensitive(F.col("full_text")))


def identifier(name: str) -> str:
    """A plain SQL name; anything else is refused before it reaches a template."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"Not an identifier: {name!r}")
    return name


def register_reads(spark: SparkSession, products: str, transactions: str, cases: str) -> None:
    """Create the table functions `get_products`, `list_transactions` and `get_cases` over named views."""
    products, transactions, cases = identifier(products), identifier(transactions), identifier(cases)
    types = ", ".join(f"'{t}'" for t in (*CARD_TYPES, *SAVINGS_TYPES))
    cards = ", ".join(f"'{t}'" for t in CARD_TYPES)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION get_products(customer STRING) RETURNS TABLE (product_type STRING, product_number_last4 STRING, currency STRING,
      current_balance DECIMAL(18,2), credit_limit DECIMAL(18,2), available_credit DECIMAL(18,2)) RETURN
      SELECT product_type, product_number_last4, currency, current_balance, credit_limit, CASE WHEN product_type IN ({cards}) THEN credit_limit - current_balance END
      FROM {products} p WHERE p.customer_id = get_products.customer AND product_type IN ({types}) AND product_status = 'Active'""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION list_transactions(customer STRING, last4 STRING DEFAULT NULL) RETURNS TABLE (transaction_id STRING, transaction_date TIMESTAMP_NTZ, product_type STRING,
      product_number_last4 STRING, transaction_type STRING, merchant_name STRING, amount DECIMAL(18,2), currency STRING, transaction_status STRING) RETURN
      SELECT t.transaction_id, t.transaction_date, p.product_type, p.product_number_last4, t.transaction_type, t.merchant_name, t.amount, t.currency, t.transaction_status
      FROM {transactions} t JOIN {products} p ON t.product_id = p.product_id AND t.customer_id = p.customer_id
      WHERE t.customer_id = list_transactions.customer AND p.product_type IN ({types}) AND p.product_status = 'Active'
        AND (list_transactions.last4 IS NULL OR p.product_number_last4 = list_transactions.last4) ORDER BY t.transaction_date DESC, t.transaction_id LIMIT 10""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION get_cases(customer STRING) RETURNS TABLE (complaint_id STRING, creation_date TIMESTAMP_NTZ, case_type STRING, category STRING,
      claimed_amount DECIMAL(15,2), currency STRING, status STRING, is_open BOOLEAN) RETURN
      SELECT complaint_id, creation_date, case_type, category, claimed_amount, currency, status, is_open FROM {cases} c WHERE c.customer_id = get_cases.customer
      ORDER BY creation_date DESC, complaint_id LIMIT 10""")


def parameterised(spark: SparkSession, template: str, args: dict, **names: str) -> DataFrame:
    """A SQL template: names are checked identifiers, values are bound parameters."""
    return spark.sql(template.format(**{k: identifier(v) for k, v in names.items()}), args=args)
