"""Running totals and frames against brute force, in one partition and in many."""

import random

import pytest
from pyspark.sql import functions as F

from tellerlake.operators.history import open_interval_distinct
from tellerlake.operators.running import History, accumulate_before, prior_windows

PARTITIONS = [1, 3, 40]


@pytest.fixture(params=PARTITIONS)
def partitions(spark, request):
    """So many ranges, whatever the size of the table."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def rows(seed, n=300, keys=("a", "b", None), span=5_000):
    r = random.Random(seed)
    # Key "a" holds most of the rows, and times collide often.
    return [(i, "a" if r.random() < 0.7 else r.choice(keys), r.randrange(-200, span) // 7 * 7, r.randrange(1, 100)) for i in range(n)]


def test_accumulate_before(spark, partitions):
    data = [(i, k, t, None if v < 20 else v) for i, k, t, v in rows(1)]
    df = spark.createDataFrame(data, "id int, k string, t bigint, v bigint").withColumn("m", F.when(F.col("v") > 50, F.struct("t", "v")))
    out = accumulate_before(df, ["k"], "t", ["v"], ["m"])
    assert out.columns == df.columns
    for r in out.collect():
        earlier = [d for d in data if d[1] == r["k"] and d[2] < r["t"] and d[3] is not None]
        assert r["v"] == (sum(d[3] for d in earlier) if earlier else None)
        assert (tuple(r["m"]) if r["m"] else None) == max(((d[2], d[3]) for d in earlier if d[3] > 50), default=None)
    assert out.count() == len(data)
    assert accumulate_before(df.limit(0), ["k"], "t", ["v"], ["m"]).collect() == []


def test_prior_windows_own_history(spark, partitions):
    data = rows(2)
    df = spark.createDataFrame(data, "id int, k string, t bigint, v bigint")
    h = History("k", ["k"], {"short": 50, "long": 700, "all": None}, {"n": F.lit(1).cast("bigint"), "v": F.col("v")},
                {"last": F.struct("t", "id")})
    other = History("o", ["k", "v"], {"long": 700}, {"n": F.lit(1).cast("bigint"), "d": (F.col("v") * F.col("v")).cast("decimal(30,0)") * F.lit(10**12).cast("decimal(13,0)")})
    out = {r["id"]: r for r in prior_windows(df, "id", "t", [h, other]).collect()}
    assert len(out) == len(data)
    for i, k, t, v in data:
        past = [d for d in data if d[1] == k and d[2] < t]
        for label, d in (("short", 50), ("long", 700), ("all", 10**9)):
            frame = [x for x in past if x[2] >= t - d]
            assert out[i][f"k_n_{label}"] == len(frame)
            assert out[i][f"k_v_{label}"] == sum(x[3] for x in frame)
        last = max(((x[2], x[0]) for x in past), default=None)
        assert (tuple(out[i]["k_last"]) if out[i]["k_last"] else None) == last
        same = [x for x in past if x[3] == v and x[2] >= t - 700]
        assert out[i]["o_n_long"] == len(same)
        assert int(out[i]["o_d_long"]) == sum(x[3] ** 2 for x in same) * 10**12


def test_prior_windows_other_stream(spark, partitions):
    facts, probes = rows(3, 400), rows(4, 120, keys=("a", "c"))
    f = spark.createDataFrame(facts, "e int, k string, t bigint, v bigint")
    p = spark.createDataFrame(probes, "id int, k string, t bigint, v bigint")
    h = History("x", ["k"], {"w": 300}, {"n": F.lit(1).cast("bigint")}, {"last": F.struct("t", "e")})
    out = {r["id"]: r for r in prior_windows(p, "id", "t", [h], facts=f).collect()}
    assert len(out) == len(probes)
    for i, k, t, _ in probes:
        past = [d for d in facts if d[1] == k and d[2] < t]
        assert out[i]["x_n_w"] == sum(d[2] >= t - 300 for d in past)
        assert (tuple(out[i]["x_last"]) if out[i]["x_last"] else None) == max(((d[2], d[0]) for d in past), default=None)


def test_lower_bound_in_same_time_out(spark):
    data = [(1, "c", 0), (2, "c", 3600), (3, "c", 3600), (4, "d", 3599)]
    df = spark.createDataFrame(data, "id int, k string, t bigint")
    h = History("k", ["k"], {"1h": 3600}, {"n": F.lit(1).cast("bigint")})
    got = {r["id"]: r["k_n_1h"] for r in prior_windows(df, "id", "t", [h]).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_distinct_members_in_frame(spark, partitions):
    r = random.Random(7)
    facts = [(r.choice("ab"), r.choice("xyz"), r.randrange(0, 2000)) for _ in range(300)]
    probes = [(i, r.choice("ab"), r.randrange(0, 2200)) for i in range(80)]
    f, p = spark.createDataFrame(facts, "k string, s string, t bigint"), spark.createDataFrame(probes, "id int, k string, t bigint")
    got = {x["id"]: x["distinct_members"] for x in open_interval_distinct(f, ["k"], "s", "t", p, "id", 60).collect()}
    assert got == {i: len({s for k2, s, t2 in facts if k2 == k and t - 60 <= t2 < t}) for i, k, t in probes}


def test_hot_key_over_many_partitions(spark, partitions):
    """One key owns half of the rows and its frames reach over several partitions; no partition holds much more than the others."""
    data = [(i, -1 if i % 2 else i % 700, i * 3 // 2, i % 11) for i in range(6000)]
    df = spark.createDataFrame(data, "id int, k int, t bigint, v bigint").repartition(5)
    h = History("k", ["k"], {"short": 100, "long": 4000, "all": None}, {"v": F.col("v")}, {"last": F.struct("t", "id")})
    got = {r["id"]: r for r in prior_windows(df, "id", "t", [h]).collect()}
    by = {}
    for i, k, t, v in data:
        by.setdefault(k, []).append((t, i, v))
    for i, k, t, _ in data[:: 97 if partitions > 1 else 501]:
        past = [x for x in by[k] if x[0] < t]
        assert [got[i][f"k_v_{f}"] for f in ("short", "long", "all")] == [sum(x[2] for x in past if x[0] >= t - d) for d in (100, 4000, 10**9)]
        assert (tuple(got[i]["k_last"]) if got[i]["k_last"] else None) == max(((x[0], x[1]) for x in past), default=None)
    assert len(got) == len(data)


def test_rows_without_a_time_have_no_history(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "a", 9)], "id int, k string, t bigint")
    h = History("k", ["k"], {"all": None}, {"n": F.lit(1).cast("bigint")}, {"last": F.struct("t", "id")})
    assert sorted((r["id"], r["k_n_all"], r["k_last"] and r["k_last"]["id"]) for r in prior_windows(df, "id", "t", [h]).collect()) == [(1, 0, None), (2, 0, None), (3, 1, 1)]


def test_partitions_of_a_timeline_are_bounded(spark, monkeypatch):
    """More rows make more ranges, not larger ones: a partition is in memory as a whole."""
    from tellerlake.operators import running

    monkeypatch.setattr(running, "RANGE_ROWS", 100)
    rows = spark.range(6000).select((F.col("id") % 7).alias("k"), F.col("id").alias("at"), F.lit(1).alias("n"))
    parts, laid = [], running.laid_out
    monkeypatch.setattr(running, "laid_out", lambda *a: parts.append(laid(*a)) or parts[-1])
    got = running.accumulate_before(rows, ["k"], "at", ["n"])
    assert {(r.k, r.at): r.n for r in got.collect()} == {(i % 7, i): i // 7 or None for i in range(6000)}
    assert max(r["count"] for r in parts[0].where("_read").groupBy("_part").count().collect()) < 300
