"""Deliveries, versions, publication and streaming jobs run over whole tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellerlake.catalog.quality_checks import RAW, typed_oracle
from tellerlake.contract import Table, parse_columns
from tellerlake.plans.pipeline import build_silver, silver_rows
from tellerlake.registry import query
from tellerlake.session import scratch
from tellerlake.sources import bronze as B
from tellerlake.sources import versioned as V
from tellerlake.sources.bucketed import read_buckets
from tellerlake.sources.publication import SERVED, publish_set, read_published
from tellerlake.standin import oracle
from tellerlake.standin_gold import gold_oracle
from tellerlake.streaming import live as L
from tellerlake.streaming.velocity import live_velocity


def delivered(b, name, parts=3):
    """The raw transactions as CSV files in dated delivery folders, written by Spark."""
    folder = scratch(b.spark, name)
    raw = b.bronze_transactions.drop("_source_file", "_ingested_at").withColumn("month", F.pmod(F.xxhash64("transaction_id"), F.lit(parts)))
    raw.write.partitionBy("month").option("header", "true").option("escape", '"').csv(f"{folder}/transactions")
    return folder


COUNTS = "SELECT count(*) AS n, count(DISTINCT customer_id) AS customers, count(nullif(trim(amount), '')) AS amounts, count(installments) AS installments FROM bronze_transactions"


def counts(df):
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("customers"),
                  F.count(F.nullif(F.trim("amount"), F.lit(""))).alias("amounts"), F.count("installments").alias("installments"))


@query("s01_raw_csv", oracle("bronze_transactions", COUNTS))
def _(b):
    return counts(B.read_raw_csv(b.spark, delivered(b, "s01")))


@query("s02_strip_bom", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(b):
    raw = b.lineitem.select(F.col("l_returnflag").alias(f"{B.BOM}l_returnflag"), F.col("l_linestatus").alias(" l_linestatus "))
    return B.strip_bom(raw).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("s03_lineage", "SELECT count(*) AS n, 1 AS files, count(*) AS stamped FROM orders")
def _(b):
    return B.with_lineage(b.orders).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_source_file").cast("int").alias("files"), F.count("_ingested_at").alias("stamped"))


def ingested(b, name):
    folder, (target, checkpoint) = delivered(b, name), B.generation(scratch(b.spark, name), "transactions", 1)
    for _ in range(2):  # the second run finds nothing new
        B.ingest(b.spark, f"{folder}/transactions", target, checkpoint)
    return B.read_bronze(b.spark, target)


@query("s04_incremental_ingest", oracle("bronze_transactions", COUNTS))
def _(b):
    return counts(ingested(b, "s04"))


@query("t01_available_now_stream", typed_oracle("""SELECT transaction_country, count(*) AS n, count(DISTINCT transaction_id) AS ids, CAST(sum(amount) AS DOUBLE) AS amount FROM typed GROUP BY 1"""))
def _(b):
    from tellerlake.functions.typing import apply_contract
    rows = apply_contract(ingested(b, "t01"), RAW)
    return rows.groupBy("transaction_country").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("transaction_id").alias("ids"), F.sum("amount").cast("double").alias("amount"))


@query("s05_schema_evolution", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-01-01') AS with_detail FROM orders")
def _(b):
    folder, (target, checkpoint) = scratch(b.spark, "s05"), B.generation(scratch(b.spark, "s05"), "orders", 1)
    rows = b.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate"), F.col("o_orderpriority").alias("channel_detail"))
    early = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    rows.where(early).select("id").write.option("header", "true").csv(f"{folder}/d1")
    B.ingest(b.spark, folder, target, checkpoint)
    rows.where(~early).select("id", "channel_detail").write.option("header", "true").csv(f"{folder}/d2")
    B.ingest(b.spark, folder, target, checkpoint)
    return B.read_bronze(b.spark, target).agg(F.count(F.lit(1)).alias("n"), F.count("channel_detail").alias("with_detail"))


@query("t03_stream_schema_evolution", "SELECT o_orderpriority AS channel_detail, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'")
def _(b):
    folder, (target, checkpoint) = scratch(b.spark, "t03"), B.generation(scratch(b.spark, "t03"), "orders", 1)
    rows = b.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate"), F.col("o_orderpriority").alias("channel_detail"))
    early = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    rows.where(early).select("id").write.option("header", "true").csv(f"{folder}/d1")
    rows.where(~early).select("id", "channel_detail").write.option("header", "true").csv(f"{folder}/d2")
    B.ingest(b.spark, folder, target, checkpoint)  # both headers in one micro-batch
    return B.read_bronze(b.spark, target).groupBy("channel_detail").agg(F.count(F.lit(1)).alias("n"))


@query("s06_reset", oracle("bronze_transactions", "SELECT g AS generation, count(*) AS n FROM bronze_transactions, (VALUES (1), (2)) v(g) GROUP BY 1"))
def _(b):
    folder, root = delivered(b, "s06"), scratch(b.spark, "s06")
    parts = []
    for g in (1, 2):
        target, checkpoint = B.generation(root, "transactions", g)
        B.ingest(b.spark, f"{folder}/transactions", target, checkpoint)
        parts.append(B.read_bronze(b.spark, target).agg(F.count(F.lit(1)).alias("n")).select(F.lit(g).alias("generation"), "n"))
    return parts[0].unionByName(parts[1])


@query("s07_delivery_routing")
def _(b):
    folder = delivered(b, "s07")
    routed = B.route(B.file_list(b.spark, folder), folder.split("://")[-1].split(":")[-1], ["transactions", "customers"])
    done = routed.where(F.col("relative").contains("month=0")).select("relative", "length")
    return B.to_copy(routed, done).groupBy("table").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query("s08_tables_without_files")
def _(b):
    folder = delivered(b, "s08")
    routed = B.route(B.file_list(b.spark, folder), folder.split("://")[-1].split(":")[-1], ["transactions", "customers"])
    return B.files_per_table(routed, ["transactions", "customers"])


# The gate passes here: the contract has only columns whose defects stay under the limits.
CLEAN = Table("transactions", "fact", parse_columns("transaction_id STRING, customer_id* STRING, process_date! DATE, amount STRING"), "process_date")


@query("s09_silver_version", oracle("bronze_transactions", """
  SELECT trim(customer_id) AS customer_id, max(CAST(process_date AS DATE)) AS process_date, 1 AS version FROM bronze_transactions GROUP BY 1"""))
def _(b):
    root = scratch(b.spark, "s09")
    version, problems = build_silver(b.bronze_transactions, CLEAN, root)
    kept, why = build_silver(b.bronze_transactions, RAW, root)  # blocked: the last good version stays
    assert not problems and kept is None and why
    return V.read_version(b.spark, root, "transactions").select("customer_id", "process_date", F.lit(version).cast("int").alias("version"))


@query("s10_quality_report_append", oracle("bronze_transactions", "SELECT 2 AS runs, count(*) AS total_rows FROM bronze_transactions"))
def _(b):
    root = scratch(b.spark, "s10")
    for _ in range(2):
        build_silver(b.bronze_transactions, RAW, root)
    report = V.read_report(b.spark, root)
    return report.agg(F.count_distinct("run_at").cast("int").alias("runs"), F.max("total_rows").alias("total_rows"))


@query("s11_version_pin", "SELECT 1 AS version, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, count(*) FROM orders")
def _(b):
    root = scratch(b.spark, "s11")
    V.write_version(b.orders.where("o_orderstatus = 'F'"), root, "orders")
    V.write_version(b.orders, root, "orders")
    parts = [V.read_version(b.spark, root, "orders", v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v or 2).alias("version"), "n") for v in (1, None)]
    return parts[0].unionByName(parts[1])


@query("s12_publish", oracle("transactions", "SELECT count(*) AS n, count(DISTINCT customer_id) AS customers, count(DISTINCT transaction_id) AS ids FROM transactions"))
def _(b):
    root = scratch(b.spark, "s12")
    V.publish(b.transactions, root, "customer_transactions", ["customer_id", "transaction_id"])
    return V.read_version(b.spark, root, "customer_transactions").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("customers"), F.count_distinct("transaction_id").alias("ids"))


def served(b):
    from tellerlake import standin_gold as G
    calls = b.transcripts.join(b.interactions.select("interaction_id", "customer_id"), "interaction_id").select("customer_id", "transcript_id", "interaction_id", "full_text")
    tables = {"customer_360": G.customer_360(b), "customers": b.customers, "customer_cases": G.cases(b), "call_transcripts": calls, "customer_products": G.products(b),
              "interaction_history": G.interactions(b).where("customer_id IS NOT NULL"), "customer_transactions": G.transactions(b)}
    return {name: (tables[name], keys) for name, keys in SERVED.items()}


@query("s12_publish_set", gold_oracle("g_360 g_cases g_products g_interactions g_transactions", """SELECT 1::BIGINT AS edition, table_name, row_count, customers FROM (
  SELECT 'customer_360' AS table_name, count(*) AS row_count, count(DISTINCT customer_id) AS customers FROM g_360
  UNION ALL SELECT 'customers', count(*), count(DISTINCT customer_id) FROM customers
  UNION ALL SELECT 'customer_cases', count(*), count(DISTINCT customer_id) FROM g_cases
  UNION ALL SELECT 'call_transcripts', count(*), count(DISTINCT customer_id) FROM transcripts JOIN interactions USING (interaction_id)
  UNION ALL SELECT 'customer_products', count(*), count(DISTINCT customer_id) FROM g_products
  UNION ALL SELECT 'interaction_history', count(*), count(DISTINCT customer_id) FROM g_interactions WHERE customer_id IS NOT NULL
  UNION ALL SELECT 'customer_transactions', count(*), count(DISTINCT customer_id) FROM g_transactions)"""))
def _(b):
    """All served tables become one edition; a second set with repeated keys is refused, so the first one stays readable."""
    root, tables = scratch(b.spark, "s12"), served(b)
    edition, _ = publish_set(tables, root)
    refused, _ = publish_set({"customers": (b.customers.unionByName(b.customers), ("customer_id",))}, root)
    parts = [read_published(b.spark, root, name).agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("customer_id").alias("customers")).select(
        F.lit(edition if refused is None else -1).cast("bigint").alias("edition"), F.lit(name).alias("table_name"), "row_count", "customers") for name in tables]
    return reduce(DataFrame.unionByName, parts)


@query("s14_publication_freshness", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01') AS updated, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-01-01') AS inserted FROM orders")
def _(b):
    root, early = scratch(b.spark, "s14"), F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    V.publish(b.orders.where(early).withColumn("state", F.lit("old")), root, "orders", ["o_custkey", "o_orderkey"])
    V.publish(b.orders.withColumn("state", F.when(early, "updated").otherwise("inserted")), root, "orders", ["o_custkey", "o_orderkey"])
    return V.read_version(b.spark, root, "orders").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("state") == "updated", 1)).alias("updated"), F.count(F.when(F.col("state") == "inserted", 1)).alias("inserted"))


@query("t02_late_corrections", typed_oracle("""
  SELECT transaction_id, process_date, CAST(amount AS DOUBLE) AS amount FROM typed WHERE transaction_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY process_date DESC NULLS LAST, _ingested_at DESC, _source_file DESC) = 1"""))
def _(b):
    folder, root = scratch(b.spark, "t02"), scratch(b.spark, "t02")
    raw = b.bronze_transactions
    for n, source in enumerate(("delivery-1.csv", "delivery-0.csv", "delivery-1.csv")):  # corrections first, then originals, then a resend
        raw.where(F.col("_source_file") == source).write.parquet(f"{folder}/d{n}")
        typed = silver_typed(arriving(b, raw, folder))
        L.merge_corrections(typed, root, "transactions", ["transaction_id"], ["process_date", "_ingested_at", "_source_file"], f"{root}/checkpoint", buckets=16)
    return read_buckets(b.spark, root, "transactions").select("transaction_id", "process_date", F.col("amount").cast("double").alias("amount"))


def arriving(b, rows, folder):
    """Each run of a stream over the folder takes what was written since the last one as a batch."""
    return b.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(folder)


def silver_typed(stream):
    from tellerlake.functions.typing import apply_contract
    return apply_contract(stream, RAW)


@query("t02_batch_silver", typed_oracle("""
  SELECT transaction_id, process_date, transaction_country FROM typed WHERE transaction_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY process_date DESC NULLS LAST, _ingested_at DESC, _source_file DESC) = 1"""))
def _(b):
    return silver_rows(b.bronze_transactions, RAW).select("transaction_id", "process_date", "transaction_country")


@query("t04_live_velocity", oracle("card_events", """
  SELECT transaction_id, CAST(count(*) OVER h AS DOUBLE) AS customer_tx_count_1h, CAST(count(*) OVER d AS DOUBLE) AS customer_tx_count_24h, CAST(count(*) OVER w AS DOUBLE) AS customer_tx_count_7d
  FROM (SELECT *, coalesce(customer_id, '__missing__' || transaction_id) AS k FROM card_events)
  WINDOW h AS (PARTITION BY k ORDER BY transaction_date RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    d AS (PARTITION BY k ORDER BY transaction_date RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    w AS (PARTITION BY k ORDER BY transaction_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"""))
def _(b):
    return live_features(b).select("transaction_id", "customer_tx_count_1h", "customer_tx_count_24h", "customer_tx_count_7d")


@query("t04_live_previous", oracle("card_events", """
  SELECT transaction_id, (epoch_us(transaction_date) - epoch_us(max(transaction_date) OVER p)) / CAST(1000000 AS DOUBLE) AS seconds_since_prev_tx
  FROM (SELECT *, coalesce(customer_id, '__missing__' || transaction_id) AS k FROM card_events)
  WINDOW p AS (PARTITION BY k ORDER BY transaction_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"""))
def _(b):
    return live_features(b).select("transaction_id", "seconds_since_prev_tx")


@query("t04_live_features", oracle("card_events", """
  SELECT transaction_id, CAST(count(*) OVER h AS DOUBLE) AS customer_tx_count_1h, CAST(count(*) OVER d AS DOUBLE) AS customer_tx_count_24h, CAST(count(*) OVER w AS DOUBLE) AS customer_tx_count_7d,
    (epoch_us(transaction_date) - epoch_us(max(transaction_date) OVER p)) / CAST(1000000 AS DOUBLE) AS seconds_since_prev_tx, false AS late
  FROM (SELECT *, coalesce(customer_id, '__missing__' || transaction_id) AS k FROM card_events)
  WINDOW h AS (PARTITION BY k ORDER BY transaction_date RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    d AS (PARTITION BY k ORDER BY transaction_date RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    w AS (PARTITION BY k ORDER BY transaction_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    p AS (PARTITION BY k ORDER BY transaction_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"""))
def _(b):
    """All four columns from keyed state, over three deliveries in time order, equal to the batch features."""
    return live_features(b).drop("_batch")


def live_features(b):
    folder, root = scratch(b.spark, "t04"), scratch(b.spark, "t04")
    rows, at = b.card_events, F.col("transaction_date")
    for n, (start, end) in enumerate((("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-03-01"))):
        rows.where((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))).write.parquet(f"{folder}/d{n}")
        live_velocity(arriving(b, rows, folder), root, f"{root}/checkpoint")
    return b.spark.read.parquet(f"{root}/features")


@query("t05_tumbling_windows", oracle("digital_events", """SELECT time_bucket(INTERVAL 1 HOUR, event_date) AS start, time_bucket(INTERVAL 1 HOUR, event_date) + INTERVAL 1 HOUR AS "end", channel, count(*) AS events,
  count(*) FILTER (WHERE event_type = 'Error') AS errors FROM digital_events GROUP BY ALL"""))
def _(b):
    return L.activity_windows(b.digital_events, "event_date", "1 hour", keys=("channel",))


@query("t05_sliding_windows", oracle("digital_events", """SELECT s AS start, s + INTERVAL 2 HOUR AS "end", count(*) AS events, count(*) FILTER (WHERE event_type = 'Error') AS errors FROM (
  SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, event_date), time_bucket(INTERVAL 1 HOUR, event_date) - INTERVAL 1 HOUR]) AS s FROM digital_events) GROUP BY ALL"""))
def _(b):
    return L.activity_windows(b.digital_events, "event_date", "2 hours", "1 hour")


@query("t05_sessions", oracle("digital_events", """SELECT min(event_date) AS start, max(event_date) + INTERVAL 1 HOUR AS "end", customer_id, count(*) AS events FROM (
    SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY event_date) AS s FROM (
      SELECT *, event_date - lag(event_date) OVER (PARTITION BY customer_id ORDER BY event_date) AS gap FROM digital_events WHERE customer_id IS NOT NULL)) GROUP BY customer_id, s"""))
def _(b):
    return L.activity_sessions(b.digital_events.where("customer_id IS NOT NULL"), "event_date", "1 hour", ("customer_id",))


@query("t06_quality_per_batch", typed_oracle("""SELECT count(*) AS total_rows, count(*) - count(transaction_id) AS null_keys, count(*) FILTER (WHERE raw_amount <> '' AND amount IS NULL) AS bad_amounts FROM typed GROUP BY _source_file"""))
def _(b):
    folder, root = scratch(b.spark, "t06"), scratch(b.spark, "t06")
    raw = b.bronze_transactions
    for n in (0, 1):
        raw.where(F.col("_source_file") == f"delivery-{n}.csv").write.parquet(f"{folder}/d{n}")
        L.quality_per_batch(arriving(b, raw, folder), RAW, root, f"{root}/checkpoint")
    report = V.read_report(b.spark, root)

    def failed(check, column):
        return F.coalesce(F.max(F.when((F.col("check_name") == check) & (F.col("column_name") == column), F.col("failed_rows"))), F.lit(0))
    return report.groupBy("batch_id").agg(F.max("total_rows").alias("total_rows"), failed("null_primary_key", "transaction_id").alias("null_keys"),
                                          failed("cast_failure", "amount").alias("bad_amounts")).drop("batch_id")
