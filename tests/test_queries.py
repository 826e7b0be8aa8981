"""The driver's contract: registry, smoke query, and products against their oracle SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "products_total" in df.columns


NAMES = ["c01_customer_transactions", "c02_customer_products", "c04_interaction_history", "c05_customer_360", "c06_contact_reason_daily", "c09_fraud_overview",
         "c11_service_metrics", "c12_quality_report", "c14_alert_budget_report", "c16_savings_history", "w04_prior_velocity_ties", "w11_latest_available_event", "f24_menu_rules", "t01_available_now_stream"]


@pytest.mark.parametrize("name", NAMES)
def test_against_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert compare(df.columns, df.collect(), [d[0] for d in cur.description], cur.fetchall()) == "ok"


def test_orphans_of_every_mapped_link(spark):
    """Interactions and digital events whose customer is unknown are in the report."""
    rows = {(r.table_name, r.column_name): r for r in entry.queries()["q10_all_links"](spark, SF).collect()}
    customers = {str(r[0]) for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id").collect()
    assert len(rows) == 8
    assert rows["interactions", "customer_id"].failed_rows == sum(str(r.user_id) not in customers for r in events)
    assert rows["digital_events", "customer_id"].failed_rows == sum(str(r.user_id) not in customers for r in events if r.event_id % 97)
