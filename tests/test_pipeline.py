"""Deliveries, contract gates, versions and streams on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tellerlake.contract import Table, foreign_keys, load_contract, parse_columns
from tellerlake.functions.typing import apply_contract, lenient_boolean, lenient_int
from tellerlake.operators.profile import bounded, evidence_json
from tellerlake.operators.quality import quality_report
from tellerlake.plans.pipeline import build_silver, run_silver
from tellerlake.sources import bronze as B
from tellerlake.sources import bucketed, publication
from tellerlake.sources import versioned as V
from tellerlake.streaming import live as L
from tellerlake.streaming.velocity import live_velocity, merge_times

TX = Table("transactions", "fact", parse_columns("transaction_id* STRING, process_date! DATE, status! STRING, amount DECIMAL(15,2)"), "process_date")


def put(folder, name, text, bom=False):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(("﻿" if bom else "") + text, encoding="utf-8")


def test_three_deliveries(spark, tmp_path):
    landing, (target, checkpoint) = tmp_path / "landing", B.generation(str(tmp_path / "bronze"), "transactions", 1)

    def deliver():
        B.ingest(spark, str(landing), target, checkpoint)
        return B.read_bronze(spark, target)

    head = "transaction_id,process_date,status,amount\n"
    put(landing, "year=2025/month=01/a.csv", head + 'T1,2025-01-01,Pending,10\nT2,2025-01-01,"Approved, ""late""\nline",20\n', bom=True)
    assert deliver().count() == 2
    put(landing, "year=2025/month=02/b.csv", head + "T3,2025-02-01,Approved,30\nT1,2025-02-02,Approved,11\nT2,2025-01-01,Approved,20\n", bom=True)
    put(landing, "year=2025/month=02/c.csv", "transaction_id,process_date,status,amount,channel_detail\nT4,2025-02-01,Approved,40,web\n", bom=True)
    assert deliver().count() == 6
    assert deliver().count() == 6  # nothing new
    bronze = B.read_bronze(spark, target)
    assert "year" not in bronze.columns and "transaction_id" in bronze.columns
    assert bronze.where("channel_detail IS NOT NULL").count() == 1
    root = str(tmp_path / "silver")
    version, problems = build_silver(bronze, TX, root)
    assert (version, problems) == (1, [])
    silver = {r["transaction_id"]: r for r in V.read_version(spark, root, "transactions").collect()}
    assert sorted(silver) == ["T1", "T2", "T3", "T4"] and silver["T1"]["status"] == "Approved"
    report = {(r["check_name"], r["column_name"]): r for r in V.read_report(spark, root).collect()}
    assert report["duplicate_primary_key", "transaction_id"]["failed_rows"] == 2
    assert report["unexpected_column", "channel_detail"]["severity"] == "warning"


def bronze_rows(spark, rows, columns="transaction_id string, process_date string, status string, amount string"):
    return spark.createDataFrame(rows, columns).withColumn("_source_file", F.lit("f")).withColumn("_ingested_at", F.current_timestamp())


@pytest.mark.parametrize("rows,blocks", [
    ([("T1", "2025-01-01", "A", "1"), (" ", "2025-01-01", "A", "1")], "null_primary_key"),
    ([(f"T{i}", "2025-01-01", "A", "x" if i < 3 else "1") for i in range(100)], "cast_failure"),
    ([], "empty_table"),
])
def test_blocking_checks_keep_last_good_version(spark, tmp_path, rows, blocks):
    root = str(tmp_path)
    assert build_silver(bronze_rows(spark, [("T0", "2025-01-01", "A", "5")]), TX, root)[0] == 1
    version, problems = build_silver(bronze_rows(spark, rows), TX, root)
    assert version is None and any(p.startswith(blocks) for p in problems)
    assert V.latest_version(spark, root, "transactions") == 1 and V.read_version(spark, root, "transactions").count() == 1


def test_missing_required_column_fails_the_run_at_the_end(spark, tmp_path):
    good = bronze_rows(spark, [("T0", "2025-01-01", "A", "5")])
    other = Table("other", "fact", TX.columns, "process_date")
    with pytest.raises(RuntimeError, match="missing_column: status"):
        run_silver(spark, {"transactions": good.drop("status"), "other": good}, {"transactions": TX, "other": other}, str(tmp_path))
    assert V.latest_version(spark, str(tmp_path), "other") == 1


def test_duplicates_above_the_limit_only_warn(spark, tmp_path):
    rows = [(f"T{i}", "2025-01-01", "A", "1") for i in range(94)] + [(f"T{i}", "2025-01-02", "B", "1") for i in range(6)]
    report = {r["check_name"]: r for r in quality_report(bronze_rows(spark, rows), TX).collect()}
    assert report["duplicate_primary_key"]["severity"] == "warning" and report["duplicate_primary_key"]["failed_pct"] == 6.0
    assert build_silver(bronze_rows(spark, rows), TX, str(tmp_path))[1] == []


def test_lenient_types(spark):
    df = spark.createDataFrame([(" ",), ("sí",), ("N",), ("3.0",), ("x",)], "v string")
    got = df.select(lenient_boolean(F.col("v")), lenient_int(F.col("v"))).collect()
    assert [r[0] for r in got] == [None, True, False, None, None]
    assert [r[1] for r in got] == [None, None, None, 3, None]
    table = Table("t", "fact", parse_columns("country* STRING, note STRING"))
    assert apply_contract(spark.createDataFrame([("Mexico",)], "country string"), table).first()["country"] == "México"


def test_contract_text():
    contract = load_contract()
    assert len(contract) == 13 and contract["daily_exchange_rates"].pk == ["date", "source_currency", "target_currency"]
    assert {c.type for c in contract["transactions"].columns if c.name == "amount"} == {"DECIMAL(15,2)"}
    links = foreign_keys()
    assert len(links) == 24 and all(c in contract[t].names and p in contract[q].names for t, c, q, p in links)


def test_versions_are_pinned_and_failed_writes_are_invisible(spark, tmp_path):
    root = str(tmp_path)
    V.write_version(spark.range(3), root, "t")
    bad = spark.range(2).select(F.raise_error(F.lit("stop")).cast("string").alias("id"))
    with pytest.raises(Exception):
        V.write_version(bad, root, "t")
    assert V.latest_version(spark, root, "t") == 1
    V.write_version(spark.range(5), root, "t")
    assert V.read_version(spark, root, "t", 1).count() == 3 and V.read_version(spark, root, "t").count() == 5
    with pytest.raises(ValueError):
        V.read_version(spark, root, "t", 9)


def test_routing_and_unchanged_files(spark, tmp_path):
    put(tmp_path, "customers.csv", "a\n1\n")
    put(tmp_path, "transactions/year=2025/x.csv", "a\n1\n")
    put(tmp_path, "transactions/notes.txt", "no")
    put(tmp_path, "other/z.csv", "a\n")
    routed = B.route(B.file_list(spark, str(tmp_path)), str(tmp_path), ["customers", "transactions", "products"])
    assert {(r["table"], r["relative"]) for r in routed.collect()} == {("customers", "customers.csv"), ("transactions", "transactions/year=2025/x.csv")}
    done = spark.createDataFrame([("customers.csv", 4), ("transactions/year=2025/x.csv", 99)], "relative string, length bigint")
    assert [r["table"] for r in B.to_copy(routed, done).collect()] == ["transactions"]
    assert {r["table"]: r["files"] for r in B.files_per_table(routed, ["customers", "products"]).collect()} == {"customers": 1, "products": 0}


def test_watermark_drops_late_rows(spark, tmp_path):
    base = dt.datetime(2025, 1, 1, 10)
    schema = "event_type string, at timestamp"
    for n, minutes in enumerate(([0, 5, 65], [200], [230], [1, 250], [600], [700])):
        spark.createDataFrame([("Error", base + dt.timedelta(minutes=m)) for m in minutes], schema).coalesce(1).write.parquet(str(tmp_path / f"in/d{n}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = L.activity_windows(stream, "at", "1 hour", late="30 minutes")
    out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r["start"].hour: r["events"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[10] == 2  # the row of minute 1 came after the watermark
    assert got[13] == 2


def test_bounded_export_fails_instead_of_truncating(spark):
    assert bounded(spark.range(3), 3).count() == 3
    with pytest.raises(Exception, match="aggregate exceeds 2 rows"):
        bounded(spark.range(3), 2).collect()


def test_evidence_has_no_nan(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", 1.5)], "k string, v double")
    assert [r["payload"] for r in evidence_json(df, ["v"]).orderBy("payload").collect()] == ['{"k":"a","v":null}', '{"k":"b","v":null}', '{"k":"c","v":1.5}']


def test_live_previous_transaction_has_no_bound(spark, tmp_path):
    """A gap of more than the stored days, in later batches, over batches without the customer, and within a batch."""
    at = lambda day, hour=0: dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)
    deliveries = [[(1, "a", at(0)), (2, "b", at(1)), (3, None, at(1))], [(4, "b", at(12)), (5, None, at(13))], [(6, "a", at(30)), (7, "a", at(30, 5)), (8, "b", at(45)), (9, "c", at(45))]]
    schema = "transaction_id long, customer_id string, transaction_date timestamp_ntz"
    for n, rows in enumerate(deliveries):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live_velocity(L.replay(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    day = 86400.0
    got = {r.transaction_id: (r.seconds_since_prev_tx, r.customer_tx_count_7d) for r in spark.read.parquet(str(tmp_path / "out/features")).collect()}
    assert got == {1: (None, 0), 2: (None, 0), 3: (None, 0), 4: (11 * day, 0), 5: (None, 0), 6: (30 * day, 0), 7: (5 * 3600.0, 1), 8: (33 * day, 0), 9: (None, 0)}


VELOCITY = "transaction_id long, customer_id string, transaction_date timestamp_ntz"


def arrive(spark, folder, rows, **options):
    spark.createDataFrame(rows, VELOCITY).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    live_velocity(L.replay(spark, str(folder / "in"), VELOCITY), str(folder / "out"), str(folder / "checkpoint"), **options)


def velocities(spark, folder):
    return {r.transaction_id: (r.customer_tx_count_1h, r.customer_tx_count_24h, r.customer_tx_count_7d, r.seconds_since_prev_tx, r.late) for r in spark.read.parquet(str(folder / "out/features")).collect()}


def test_late_rows_find_their_predecessor(spark, tmp_path):
    """A row that arrives a batch later than newer ones sees what lies before it; one beyond the allowed lateness is marked."""
    at = lambda h: dt.datetime(2024, 3, 1) + dt.timedelta(hours=h)
    arrive(spark, tmp_path, [(1, "a", at(0)), (2, "a", at(10)), (3, "b", at(1))], lateness=24 * 3_600_000_000)
    arrive(spark, tmp_path, [(4, "a", at(5)), (5, "a", at(10)), (6, "b", at(0))], lateness=24 * 3_600_000_000)
    arrive(spark, tmp_path, [(7, "a", at(24 * 40))], lateness=24 * 3_600_000_000)
    arrive(spark, tmp_path, [(8, "a", at(24 * 39)), (9, "a", at(24 * 2))], lateness=24 * 3_600_000_000)
    got = velocities(spark, tmp_path)
    assert got[4] == (0, 1, 1, 5 * 3600.0, False) and got[5] == (0, 2, 2, 5 * 3600.0, False) and got[6] == (0, 0, 0, None, False)
    assert got[7] == (0, 0, 0, (24 * 40 - 10) * 3600.0, False)
    assert got[8][:4] == (0, 0, 0, (24 * 39 - 48) * 3600.0) and not got[8][4] and got[9][4]


def test_idle_state_expires_and_the_newest_time_stays(spark, tmp_path):
    import time

    at = lambda h: dt.datetime(2024, 3, 1) + dt.timedelta(hours=h)
    arrive(spark, tmp_path, [(1, "a", at(0)), (2, "a", at(1))], idle_ms=500)
    time.sleep(2)
    arrive(spark, tmp_path, [(3, "a", at(2)), (4, "a", at(0.5))], idle_ms=500)
    got = velocities(spark, tmp_path)
    assert got[3][3:] == (3600.0, True) and got[4][4]


def test_merged_times_equal_brute_force():
    import random

    import numpy as np

    r, times, before, seen = random.Random(4), np.empty(0, np.int64), None, []
    hour = 3_600_000_000
    for _ in range(30):
        arrived = np.array([r.randrange(0, 60 * 24) * hour // 2 for _ in range(r.randint(1, 6))], np.int64)
        seen += arrived.tolist()
        times, before, found = merge_times(times, before, arrived, 10_000 * hour)
        for i, t in enumerate(arrived.tolist()):
            past = [x for x in seen if x < t]
            assert found["24h"][i] == sum(x >= t - 24 * hour for x in past) and found["previous"][i] == max(past, default=np.iinfo(np.int64).min)


def bucket_files(root):
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("change=*/**/*.parquet")}


def test_a_correction_writes_only_its_buckets(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "id long, day int, v string"
    rows = spark.createDataFrame([(i, 1, "old") for i in range(200)], schema)
    assert bucketed.merge_change(rows, root, "tx", ["id"], ["day"], 0, buckets=8) == list(range(8))
    before = bucket_files(tmp_path)
    late = spark.createDataFrame([(5, 2, "new"), (5, 0, "older"), (None, 9, "no key")], schema)
    touched = bucketed.merge_change(late, root, "tx", ["id"], ["day"], 1, buckets=8)
    assert len(touched) == 1 and before.items() <= bucket_files(tmp_path).items()
    paths = bucketed.bucket_paths(spark, root, "tx")
    assert sum("change=0000000001" in p for p in paths.values()) == 1 and len(paths) == 8
    got = {r["id"]: r["v"] for r in bucketed.read_buckets(spark, root, "tx").collect()}
    assert got == {i: "new" if i == 5 else "old" for i in range(200)}
    assert bucketed.merge_change(late, root, "tx", ["id"], ["day"], 1, buckets=8) == touched  # a retry
    assert bucketed.read_buckets(spark, root, "tx").count() == 200
    assert bucketed.merge_change(late.limit(0), root, "tx", ["id"], ["day"], 2, buckets=8) == []
    with pytest.raises(ValueError):
        bucketed.read_buckets(spark, root, "other")


def test_an_edition_is_published_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "serving")
    make = lambda *rows: spark.createDataFrame(rows, "customer_id string, product_id string, v int")
    keys = ("customer_id", "product_id")
    good = {"a": (make(("1", "x", 1), ("1", "y", 1)), keys), "b": (make(("1", "x", 1)), ("customer_id",))}
    assert publication.publish_set(good, root)[0] == 1
    for broken in (make(("1", "x", 2), ("1", "x", 3)), make(("1", None, 2))):
        edition, report = publication.publish_set({**good, "a": (broken, keys)}, root)
        assert edition is None and {r["table_name"]: r["accepted"] for r in report.collect()} == {"a": False, "b": True}
        assert publication.read_published(spark, root, "a").count() == 2
    assert publication.publish_set({**good, "a": (make(("1", "x", 4)), keys)}, root)[0] == 2
    assert [r["v"] for r in publication.read_published(spark, root, "a").collect()] == [4]
    assert publication.read_published(spark, root, "a", edition=1).count() == 2
    with pytest.raises(ValueError):
        publication.read_published(spark, root, "c")


def test_keys_are_counted_without_moving_them(spark, monkeypatch):
    """Sound keys are counted by hash alone; missing and repeated ones, and different keys of one hash, as they are."""
    make = lambda *rows: spark.createDataFrame(rows, "a string, b string")
    check = lambda df: tuple(publication.key_check(df, "t", ("a", "b")).first())
    sound = make(*((str(i % 7), str(i)) for i in range(50)))
    assert check(sound) == ("t", "a,b", 50, 0, 0, True)
    assert "_k0" not in publication.key_check(sound, "t", ("a", "b"))._jdf.queryExecution().analyzed().toString()
    odd = make(("1", "x"), ("1", "x"), ("1", "x"), ("2", "y"), ("2", "y"), (None, "x"), (None, "x"), ("1", None), ("x", None), ("3", "z"))
    assert check(odd) == ("t", "a,b", 10, 4, 3, False)
    assert check(make()) == ("t", "a,b", 0, 0, 0, True)
    monkeypatch.setattr(publication.F, "xxhash64", lambda *keys: F.lit(1).cast("bigint"))
    assert check(sound) == ("t", "a,b", 50, 0, 0, True) and check(odd) == ("t", "a,b", 10, 4, 3, False)


def test_a_repeated_batch_replaces_its_report(spark, tmp_path):
    report = spark.createDataFrame([(1, "x")], "batch_id long, check_name string")
    for _ in range(2):
        V.append_report(report, str(tmp_path), "stream-1")
    V.append_report(report, str(tmp_path))
    assert V.read_report(spark, str(tmp_path)).count() == 2
