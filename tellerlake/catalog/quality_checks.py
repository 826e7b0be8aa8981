"""Typing, contract, quality and key checks over raw text rows."""

from pyspark.sql import functions as F

from tellerlake.contract import Table, foreign_keys, parse_columns
from tellerlake.functions.typing import apply_contract, blank_to_null, lenient_boolean, lenient_int, normalise_alias
from tellerlake.operators.latest import keep_latest
from tellerlake.operators.quality import (
    blocking, column_set_difference, count_if, join_grain, key_uniqueness, orphan_report, orphan_rows, quality_report,
)
from tellerlake.operators.running import attach_one_row
from tellerlake.registry import query
from tellerlake.standin import MAPPINGS, oracle

RAW = Table("transactions", "fact", parse_columns(
    "transaction_id* STRING, transaction_date! TIMESTAMP, process_date! DATE, customer_id! STRING, amount! DECIMAL(15,2), "
    "installments INT, transaction_country! STRING, is_fraud! BOOLEAN, branch_id STRING, currency! STRING"), "process_date")

# The typed rows in the oracle's own words.
TYPED = """typed AS (
  SELECT nullif(trim(transaction_id), '') AS transaction_id, TRY_CAST(nullif(trim(transaction_date), '') AS TIMESTAMP) AS transaction_date,
    TRY_CAST(process_date AS DATE) AS process_date, trim(customer_id) AS customer_id,
    TRY_CAST(nullif(trim(amount), '') AS DECIMAL(15,2)) AS amount,
    CAST(trunc(TRY_CAST(installments AS DECIMAL(30,6))) AS INTEGER) AS installments,
    CASE trim(transaction_country) WHEN 'Mexico' THEN 'México' ELSE trim(transaction_country) END AS transaction_country,
    CASE WHEN lower(trim(is_fraud)) IN ('true', 'sí', 'si', 'yes') THEN true WHEN lower(trim(is_fraud)) IN ('n', '0', 'f') THEN false END AS is_fraud,
    trim(amount) AS raw_amount, trim(installments) AS raw_installments, trim(transaction_date) AS raw_date, trim(is_fraud) AS raw_fraud,
    trim(transaction_country) AS raw_country, channel_detail, _source_file, _ingested_at
  FROM bronze_transactions)"""


def typed_oracle(body: str) -> str:
    return oracle("bronze_transactions", f"WITH {TYPED} {body}")


@query("f01_blank_to_null", typed_oracle("SELECT transaction_id, count(*) AS n FROM typed GROUP BY 1"))
def _(b):
    return b.bronze_transactions.groupBy(blank_to_null(F.col("transaction_id")).alias("transaction_id")).agg(F.count(F.lit(1)).alias("n"))


@query("f02_lenient_boolean", typed_oracle("SELECT is_fraud, raw_fraud, count(*) AS n FROM typed GROUP BY ALL"))
def _(b):
    return (b.bronze_transactions.groupBy(lenient_boolean(F.col("is_fraud")).alias("is_fraud"), F.trim("is_fraud").alias("raw_fraud"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("f03_lenient_int", typed_oracle("SELECT installments, raw_installments, count(*) AS n FROM typed GROUP BY ALL"))
def _(b):
    return (b.bronze_transactions.groupBy(lenient_int(F.col("installments")).alias("installments"), F.trim("installments").alias("raw_installments"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("f04_safe_cast", typed_oracle(
    "SELECT transaction_id, transaction_date, process_date, CAST(amount AS DOUBLE) AS amount FROM typed WHERE transaction_id IS NOT NULL"))
def _(b):
    typed = apply_contract(b.bronze_transactions, RAW)
    return typed.where("transaction_id IS NOT NULL").select(
        "transaction_id", F.col("transaction_date").cast("timestamp_ntz").alias("transaction_date"), "process_date", F.col("amount").cast("double").alias("amount"))


@query("f05_value_alias", typed_oracle("SELECT transaction_country, raw_country, count(*) AS n FROM typed GROUP BY ALL"))
def _(b):
    return (b.bronze_transactions.groupBy(normalise_alias(F.col("transaction_country"), {"Mexico": "México"}).alias("transaction_country"),
                                          F.trim("transaction_country").alias("raw_country")).agg(F.count(F.lit(1)).alias("n")))


@query("f06_contract_projection", typed_oracle(
    "SELECT transaction_id, transaction_date, process_date, customer_id, CAST(amount AS DOUBLE) AS amount, installments, transaction_country, is_fraud, "
    "CAST(NULL AS VARCHAR) AS branch_id, CAST(NULL AS VARCHAR) AS currency, channel_detail, _source_file FROM typed"))
def _(b):
    df = apply_contract(b.bronze_transactions, RAW)
    return df.withColumn("transaction_date", F.col("transaction_date").cast("timestamp_ntz")).withColumn("amount", F.col("amount").cast("double")).drop("_ingested_at")


@query("q01_cast_failures", typed_oracle("""
  SELECT 'transaction_date' AS column_name, count(*) FILTER (WHERE raw_date <> '' AND transaction_date IS NULL) AS failed_rows, count(*) AS total_rows FROM typed
  UNION ALL SELECT 'amount', count(*) FILTER (WHERE raw_amount <> '' AND amount IS NULL), count(*) FROM typed
  UNION ALL SELECT 'installments', count(*) FILTER (WHERE raw_installments <> '' AND installments IS NULL), count(*) FROM typed
  UNION ALL SELECT 'is_fraud', count(*) FILTER (WHERE raw_fraud <> '' AND is_fraud IS NULL), count(*) FROM typed"""))
def _(b):
    return quality_report(b.bronze_transactions, RAW).where("check_name = 'cast_failure'").select("column_name", "failed_rows", "total_rows")


@query("q02_not_null_violations", typed_oracle("""
  SELECT unnest(['transaction_id', 'transaction_date', 'process_date', 'customer_id', 'amount', 'transaction_country', 'is_fraud', 'currency']) AS column_name,
    unnest([count(*) - count(transaction_id), count(*) - count(transaction_date), count(*) - count(process_date), count(*) - count(customer_id),
      count(*) - count(amount), count(*) - count(transaction_country), count(*) - count(is_fraud), count(*)]) AS failed_rows FROM typed"""))
def _(b):
    return quality_report(b.bronze_transactions, RAW).where("check_name = 'not_null_violation'").select("column_name", "failed_rows")


@query("q03_normalised_values", typed_oracle(
    "SELECT 'transaction_country' AS column_name, count(*) FILTER (WHERE raw_country = 'Mexico') AS failed_rows FROM typed"))
def _(b):
    return quality_report(b.bronze_transactions, RAW).where("check_name = 'normalized_value'").select("column_name", "failed_rows")


@query("q04_column_drift", typed_oracle(
    "SELECT c AS column_name, k AS check_name, n AS total_rows FROM (SELECT count(*) AS n FROM typed), "
    "(VALUES ('branch_id', 'missing_column'), ('currency', 'missing_column'), ('channel_detail', 'unexpected_column')) v(c, k)"))
def _(b):
    return (quality_report(b.bronze_transactions, RAW).where(F.col("check_name").isin("missing_column", "unexpected_column"))
            .select("column_name", "check_name", "total_rows"))


@query("q05_null_keys", typed_oracle("SELECT count(*) - count(transaction_id) AS null_pk, count(*) AS total FROM typed"))
def _(b):
    report = quality_report(b.bronze_transactions, RAW).where("check_name = 'null_primary_key'")
    return report.select(F.col("failed_rows").alias("null_pk"), F.col("total_rows").alias("total"))


@query("q06_duplicate_keys", typed_oracle(
    "SELECT count(transaction_id) - count(DISTINCT transaction_id) AS failed_rows, "
    "CASE WHEN (count(transaction_id) - count(DISTINCT transaction_id)) * 100.0 > count(*) * 5 THEN 'warning' ELSE 'info' END AS severity FROM typed"))
def _(b):
    return quality_report(b.bronze_transactions, RAW).where("check_name = 'duplicate_primary_key'").select("failed_rows", "severity")


@query("q07_blocking_gate", typed_oracle("""
  SELECT * FROM (
    SELECT 'cast_failure' AS check_name, c AS column_name, f AS failed_rows FROM (
      SELECT unnest(['amount', 'installments', 'is_fraud', 'transaction_date']) AS c, unnest([
        count(*) FILTER (WHERE raw_amount <> '' AND amount IS NULL), count(*) FILTER (WHERE raw_installments <> '' AND installments IS NULL),
        count(*) FILTER (WHERE raw_fraud <> '' AND is_fraud IS NULL), count(*) FILTER (WHERE raw_date <> '' AND transaction_date IS NULL)]) AS f, count(*) AS n FROM typed)
      WHERE f * 100.0 > n
    UNION ALL SELECT 'missing_column', 'currency', count(*) FROM typed
    UNION ALL SELECT 'null_primary_key', 'transaction_id', count(*) - count(transaction_id) FROM typed) WHERE failed_rows > 0"""))
def _(b):
    return blocking(quality_report(b.bronze_transactions, RAW)).select("check_name", "column_name", "failed_rows")


@query("q08_severity_and_pct", typed_oracle("""
  SELECT c AS column_name, CASE WHEN f = 0 THEN 'info' ELSE 'warning' END AS severity, round(f * 100.0 / greatest(n, 1), 3) AS failed_pct FROM (
    SELECT unnest(['transaction_id', 'transaction_date', 'process_date', 'customer_id', 'amount', 'transaction_country', 'is_fraud', 'currency']) AS c,
      unnest([count(*) - count(transaction_id), count(*) - count(transaction_date), count(*) - count(process_date), count(*) - count(customer_id),
        count(*) - count(amount), count(*) - count(transaction_country), count(*) - count(is_fraud), count(*)]) AS f, count(*) AS n FROM typed)"""))
def _(b):
    return quality_report(b.bronze_transactions, RAW).where("check_name = 'not_null_violation'").select("column_name", "severity", "failed_pct")


@query("q09_freshness", oracle("transactions interactions", """
  SELECT 'transactions' AS table_name, max(process_date) AS max_process_date FROM transactions
  UNION ALL SELECT 'transcripts', (SELECT CAST('2001-06-01' AS DATE) + CAST(max(doc_id % 60) AS INTEGER) FROM documents)"""))
def _(b):
    return (b.transactions.agg(F.max("process_date").alias("max_process_date")).select(F.lit("transactions").alias("table_name"), "max_process_date")
            .unionByName(b.transcripts.agg(F.max("process_date").alias("max_process_date")).select(F.lit("transcripts").alias("table_name"), "max_process_date")))


def _links(b):
    return [
        ("products", b.products, "customer_id", "customers", b.customers, "customer_id"),
        ("transactions", b.transactions, "customer_id", "customers", b.customers, "customer_id"),
        ("transactions", b.transactions, "product_id", "products", b.products, "product_id"),
        ("complaints", b.complaints, "customer_id", "customers", b.customers, "customer_id"),
        ("surveys", b.surveys, "interaction_id", "interactions", b.interactions, "interaction_id"),
        ("transcripts", b.transcripts, "interaction_id", "interactions", b.interactions, "interaction_id"),
    ]


def _orphan_sql(child, column, parent):
    return (f"SELECT '{child}' AS table_name, '{column}' AS column_name, count(*) FILTER (WHERE {column} NOT IN (SELECT {column} FROM {parent})) AS failed_rows, "
            f"count(*) AS total_rows FROM {child} WHERE {column} IS NOT NULL")


@query("q10_referential_integrity", oracle("customers products transactions complaints surveys transcripts interactions", " UNION ALL ".join(
    _orphan_sql(*x) for x in [("products", "customer_id", "customers"), ("transactions", "customer_id", "customers"),
                              ("transactions", "product_id", "products"), ("complaints", "customer_id", "customers"),
                              ("surveys", "interaction_id", "interactions"), ("transcripts", "interaction_id", "interactions")])))
def _(b):
    return orphan_report(_links(b)).select("table_name", "column_name", "failed_rows", "total_rows")


# Contract tables that the stand-in maps under a shorter name.
MAPPED_AS = {"call_center_interactions": "interactions", "call_transcripts": "transcripts", "satisfaction_surveys": "surveys"}


def mapped_links(b):
    """Every foreign key of the contract whose tables and columns the stand-in maps."""
    links = [(MAPPED_AS.get(t, t), c, MAPPED_AS.get(q, q), p) for t, c, q, p in foreign_keys()]
    frames = {t: getattr(b, t) for link in links for t in (link[0], link[2]) if t in MAPPINGS}
    return [(t, frames[t], c, q, frames[q], p) for t, c, q, p in links if t in frames and q in frames and c in frames[t].columns and p in frames[q].columns]


def _orphan_rows_sql(child, column, parent):
    return (f"SELECT '{child}' AS table_name, 'orphan_foreign_key' AS check_name, '{column}' AS column_name, n AS failed_rows, total AS total_rows, "
            f"'-> {parent}.{column}' AS detail, CASE WHEN n > 0 THEN 'warning' ELSE 'info' END AS severity, round(n * 100.0 / greatest(total, 1), 3) AS failed_pct "
            f"FROM (SELECT count(*) FILTER (WHERE {column} NOT IN (SELECT {column} FROM {parent})) AS n, count(*) AS total FROM {child} WHERE {column} IS NOT NULL)")


@query("q10_all_links", oracle("customers products transactions interactions digital_events complaints surveys transcripts", " UNION ALL ".join(
    _orphan_rows_sql(*x) for x in [("products", "customer_id", "customers"), ("transactions", "customer_id", "customers"),
                                   ("interactions", "customer_id", "customers"), ("digital_events", "customer_id", "customers"),
                                   ("complaints", "customer_id", "customers"), ("transactions", "product_id", "products"),
                                   ("transcripts", "interaction_id", "interactions"), ("surveys", "interaction_id", "interactions")])))
def _(b):
    return orphan_report(mapped_links(b))


@query("q11_join_grain", """
  SELECT (SELECT count(*) FROM orders) AS rows_before, count(*) AS rows_after, count(DISTINCT o_orderkey) AS distinct_after,
    (SELECT count(*) FROM orders) = count(*) AND count(*) = count(DISTINCT o_orderkey) AS grain_kept
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(b):
    extra = b.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return join_grain(b.orders, b.orders.join(extra, "o_orderkey", "left"), "o_orderkey")


@query("q12_integrity_summary", oracle("transactions", """
  SELECT count(*) AS total, count(DISTINCT transaction_id) AS distinct_ids, count(*) FILTER (WHERE transaction_id IS NULL) AS null_ids,
    count(*) FILTER (WHERE is_fraud IS NULL) AS null_labels, count(*) FILTER (WHERE transaction_date IS NULL) AS null_dates,
    count(*) FILTER (WHERE is_fraud) AS positives, min(transaction_date) AS min_date, max(transaction_date) AS max_date FROM transactions"""))
def _(b):
    tx = b.transactions
    wide = tx.agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("transaction_id").isNull()).alias("null_ids"), count_if(F.col("is_fraud").isNull()).alias("null_labels"),
        count_if(F.col("transaction_date").isNull()).alias("null_dates"), count_if(F.col("is_fraud")).alias("positives"),
        F.min("transaction_date").alias("min_date"), F.max("transaction_date").alias("max_date"))
    return attach_one_row(wide, tx.agg(F.count_distinct("transaction_id").alias("distinct_ids")))


@query("q13_dimension_timing", oracle("transactions customers products", """
  SELECT count(*) AS total, count(*) FILTER (WHERE c.customer_id IS NULL) AS customer_unmatched, count(*) FILTER (WHERE p.product_id IS NULL) AS product_unmatched,
    count(*) FILTER (WHERE c.registration_date > t.transaction_date) AS registered_later,
    count(*) FILTER (WHERE p.opening_date > CAST(t.transaction_date AS DATE)) AS opened_later,
    count(*) FILTER (WHERE c.date_of_birth > CAST(t.transaction_date AS DATE)) AS born_later
  FROM transactions t LEFT JOIN customers c USING (customer_id) LEFT JOIN products p USING (product_id)"""))
def _(b):
    c = b.customers.select("customer_id", "registration_date", "date_of_birth", F.lit(True).alias("_c"))
    p = b.products.select("product_id", "opening_date", F.lit(True).alias("_p"))
    day = F.to_date("transaction_date")
    return (b.transactions.select("customer_id", "product_id", "transaction_date").join(c, "customer_id", "left").join(p, "product_id", "left").agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("_c").isNull()).alias("customer_unmatched"), count_if(F.col("_p").isNull()).alias("product_unmatched"),
        count_if(F.col("registration_date") > F.col("transaction_date")).alias("registered_later"),
        count_if(F.col("opening_date") > day).alias("opened_later"), count_if(F.col("date_of_birth") > day).alias("born_later")))


@query("q14_digital_feed_audit", oracle("digital_events", """
  SELECT count(*) AS events, count(DISTINCT customer_id) AS identified_customers, count(*) - count(customer_id) AS null_customers,
    count(*) FILTER (WHERE date_trunc('day', event_date) = event_date) AS midnight_stamps,
    count(*) FILTER (WHERE process_date < CAST(event_date AS DATE)) AS processed_before, count(*) FILTER (WHERE process_date > CAST(event_date AS DATE)) AS processed_after,
    count(*) - count(platform) AS null_platform, count(*) - count(ip_country) AS null_country,
    count(*) FILTER (WHERE event_type = 'Login') AS logins, count(*) FILTER (WHERE event_type = 'Error') AS errors FROM digital_events"""))
def _(b):
    day, is_null = F.to_date("event_date"), lambda c: count_if(F.col(c).isNull())
    return b.digital_events.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("customer_id").alias("identified_customers"), is_null("customer_id").alias("null_customers"),
        count_if(F.col("event_date") == day.cast("timestamp_ntz")).alias("midnight_stamps"),
        count_if(F.col("process_date") < day).alias("processed_before"), count_if(F.col("process_date") > day).alias("processed_after"),
        is_null("platform").alias("null_platform"), is_null("ip_country").alias("null_country"),
        count_if(F.col("event_type") == "Login").alias("logins"), count_if(F.col("event_type") == "Error").alias("errors"))


@query("s13_key_uniqueness", oracle("customers transactions", """
  SELECT 'customers' AS table_name, count(*) AS row_count, count(DISTINCT customer_id) AS key_count, count(*) = count(DISTINCT customer_id) AS is_unique FROM customers
  UNION ALL SELECT 'transactions', count(*), count(DISTINCT (customer_id, transaction_id)), count(*) = count(DISTINCT (customer_id, transaction_id)) FROM transactions
  UNION ALL SELECT 'lineitem', count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem"""))
def _(b):
    return key_uniqueness({"customers": (b.customers, ["customer_id"]), "transactions": (b.transactions, ["customer_id", "transaction_id"]),
                           "lineitem": (b.lineitem, ["l_orderkey", "l_linenumber"])})


@query("w01_keep_latest", typed_oracle("""
  SELECT transaction_id, customer_id, process_date, CAST(amount AS DOUBLE) AS amount, _source_file FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY process_date DESC NULLS LAST, _ingested_at DESC, _source_file DESC) AS rn
    FROM typed WHERE transaction_id IS NOT NULL) WHERE rn = 1"""))
def _(b):
    typed = apply_contract(b.bronze_transactions, RAW)
    return keep_latest(typed, ["transaction_id"], ["process_date", "_ingested_at", "_source_file"]).select(
        "transaction_id", "customer_id", "process_date", F.col("amount").cast("double").alias("amount"), "_source_file")


@query("j09_orphan_rows", """
  SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = l_partkey)""")
def _(b):
    return orphan_rows(b.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", b.customer, "c_custkey")


@query("u04_column_set_difference", """
  SELECT 'branch_id' AS column_name, 'missing' AS kind, count(*) AS total_rows FROM orders
  UNION ALL SELECT 'currency', 'missing', count(*) FROM orders UNION ALL SELECT 'channel_detail', 'unexpected', count(*) FROM orders""")
def _(b):
    raw = b.bronze_transactions.drop("_source_file", "_ingested_at")
    missing, extra = column_set_difference(RAW.names, raw.columns)
    drift = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit("missing").alias("kind")) for c in missing],
                    *[F.struct(F.lit(c).alias("column_name"), F.lit("unexpected").alias("kind")) for c in extra])
    return b.orders.agg(F.count(F.lit(1)).alias("total_rows")).select(F.explode(drift).alias("d"), "total_rows").select("d.*", "total_rows")


@query("c12_quality_report", typed_oracle("""
  , stats AS (SELECT count(*) AS n, count(*) - count(transaction_id) AS null_id, count(transaction_id) - count(DISTINCT transaction_id) AS dups,
    count(*) - count(transaction_date) AS null_date, count(*) - count(amount) AS null_amount, count(*) - count(is_fraud) AS null_fraud,
    count(*) FILTER (WHERE raw_date <> '' AND transaction_date IS NULL) AS bad_date, count(*) FILTER (WHERE raw_amount <> '' AND amount IS NULL) AS bad_amount,
    count(*) FILTER (WHERE raw_installments <> '' AND installments IS NULL) AS bad_int, count(*) FILTER (WHERE raw_fraud <> '' AND is_fraud IS NULL) AS bad_fraud,
    count(*) FILTER (WHERE raw_country = 'Mexico') AS aliased FROM typed),
  checks AS (
    SELECT unnest([
      {'k': 'cast_failure', 'c': 'transaction_date', 'f': bad_date, 's': CASE WHEN bad_date * 100.0 > n THEN 'critical' ELSE 'warning' END},
      {'k': 'cast_failure', 'c': 'amount', 'f': bad_amount, 's': CASE WHEN bad_amount * 100.0 > n THEN 'critical' ELSE 'warning' END},
      {'k': 'cast_failure', 'c': 'installments', 'f': bad_int, 's': CASE WHEN bad_int * 100.0 > n THEN 'critical' ELSE 'warning' END},
      {'k': 'cast_failure', 'c': 'is_fraud', 'f': bad_fraud, 's': CASE WHEN bad_fraud * 100.0 > n THEN 'critical' ELSE 'warning' END},
      {'k': 'not_null_violation', 'c': 'transaction_id', 'f': null_id, 's': CASE WHEN null_id > 0 THEN 'warning' ELSE 'info' END},
      {'k': 'not_null_violation', 'c': 'transaction_date', 'f': null_date, 's': CASE WHEN null_date > 0 THEN 'warning' ELSE 'info' END},
      {'k': 'not_null_violation', 'c': 'process_date', 'f': 0, 's': 'info'}, {'k': 'not_null_violation', 'c': 'customer_id', 'f': 0, 's': 'info'},
      {'k': 'not_null_violation', 'c': 'amount', 'f': null_amount, 's': CASE WHEN null_amount > 0 THEN 'warning' ELSE 'info' END},
      {'k': 'not_null_violation', 'c': 'transaction_country', 'f': 0, 's': 'info'},
      {'k': 'not_null_violation', 'c': 'is_fraud', 'f': null_fraud, 's': CASE WHEN null_fraud > 0 THEN 'warning' ELSE 'info' END},
      {'k': 'not_null_violation', 'c': 'currency', 'f': n, 's': 'warning'},
      {'k': 'normalized_value', 'c': 'transaction_country', 'f': aliased, 's': 'info'},
      {'k': 'missing_column', 'c': 'branch_id', 'f': n, 's': 'warning'}, {'k': 'missing_column', 'c': 'currency', 'f': n, 's': 'critical'},
      {'k': 'unexpected_column', 'c': 'channel_detail', 'f': 0, 's': 'warning'},
      {'k': 'null_primary_key', 'c': 'transaction_id', 'f': null_id, 's': CASE WHEN null_id > 0 THEN 'critical' ELSE 'info' END},
      {'k': 'duplicate_primary_key', 'c': 'transaction_id', 'f': dups, 's': CASE WHEN dups * 100.0 > n * 5 THEN 'warning' ELSE 'info' END},
      {'k': 'freshness', 'c': 'process_date', 'f': 0, 's': 'info'}]) AS x, n FROM stats)
  SELECT 'transactions' AS table_name, x.k AS check_name, x.c AS column_name, x.f AS failed_rows, n AS total_rows, x.s AS severity,
    round(x.f * 100.0 / greatest(n, 1), 3) AS failed_pct FROM checks
    WHERE x.f > 0 OR x.k NOT IN ('cast_failure', 'normalized_value')""").replace("FROM bronze_transactions) ,", "FROM bronze_transactions),"))
def _(b):
    return quality_report(b.bronze_transactions, RAW).drop("detail")

