"""Positions, running sums and percentiles over ranges, against brute force on several partitions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellerlake.operators import evaluation as E
from tellerlake.operators.ordering import cumulate_groups, exact_percentiles, global_rank, in_ranges, positions, running_sums


@pytest.fixture(autouse=True)
def partitions(spark):
    """Small tables would end up in one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_sums_with_hot_and_null_keys(spark):
    r = random.Random(5)
    data = [(i, "hot" if r.random() < 0.6 else r.choice(["a", "b", None, ""]), r.choice([None, 1.5, 2.5]), r.choice([None, *range(-5, 50)])) for i in r.sample(range(10_000), 600)]
    df = spark.createDataFrame(data, "id long, k string, g double, v int")
    got = {x["id"]: (x["cum_v"], x["cum_one"]) for x in running_sums(df.withColumn("one", F.lit(1)), ["k", "g"], [F.asc("id")], ["v", "one"]).collect()}
    total = Counter()
    for i, k, g, v in sorted(data):
        total[k, g, "v"] += v or 0
        total[k, g, "n"] += 1
        assert got[i] == (total[k, g, "v"], total[k, g, "n"])
    assert len(got) == len(data)
    assert running_sums(df.limit(0), ["k"], [F.asc("id")], ["v"]).collect() == []


@pytest.mark.parametrize("scores", [[0.9, 0.5, 0.5, 0.123, None], [0.5], None])
def test_global_rank(spark, scores):
    """Ties, equal scores throughout, and continuous scores of which most are 0."""
    r = random.Random(6)
    pick = (lambda: r.choice(scores)) if scores else (lambda: 0.0 if r.random() < 0.8 else r.random())
    data = [(i, pick()) for i in r.sample(range(10_000), 400)]
    df = spark.createDataFrame(data, "id bigint, score double")
    got = {x["id"]: x["rank"] for x in global_rank(df, "score", "id").collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(data, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])), 1)}


@pytest.mark.parametrize("equal", [True, False])
def test_no_partition_is_much_larger_than_the_others(spark, equal):
    df = spark.range(200_000).select("id", F.when(F.lit(equal) | (F.col("id") % 5 > 0), 0.0).otherwise(F.rand(1)).alias("score"))
    sizes = sorted(x["count"] for x in in_ranges(df, [], [F.desc("score"), F.asc("id")]).groupBy("_part").count().collect())
    assert sum(sizes) == 200_000 and len(sizes) == 8 and sizes[-1] < 3 * sizes[len(sizes) // 2]


def test_hot_key_is_spread(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    sizes = sorted(x["count"] for x in in_ranges(df, ["k"], [F.asc("id")]).groupBy("_part").count().collect())
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]
    top = running_sums(df.withColumn("one", F.lit(1)), ["k"], [F.asc("id")], ["one"]).groupBy("k").agg(F.max("cum_one").alias("n")).orderBy(F.desc("n")).first()
    assert (top["k"], top["n"]) == (-1, 50_000)


def test_percentiles(spark):
    r = random.Random(5)
    data = [(r.choice("ab"), r.randrange(0, 200) / 4) for _ in range(500)] + [("c", 7.0), (None, 1.0), (None, 2.0), ("d", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = {"p1": 0.01, "p50": 0.5, "p95": 0.95}
    cont = {x["k"]: x for x in exact_percentiles(df, ["k"], "v", probs).collect()}
    disc = {x["k"]: x for x in exact_percentiles(df, ["k"], "v", probs, "disc").collect()}
    assert cont.keys() == disc.keys() == {"a", "b", "c", None}
    for k in cont:
        values = [v for g, v in data if g == k]
        for name, p in probs.items():
            assert cont[k][name] == pytest.approx(np.percentile(values, p * 100))
            assert disc[k][name] == np.percentile(values, p * 100, method="inverted_cdf")
        assert cont[k]["n_values"] == len(values)
    every = exact_percentiles(df, [], "v", {"p50": 0.5}).first()
    assert every["p50"] == np.percentile([v for _, v in data if v is not None], 50)


def test_cumulate_groups_descending(spark):
    df = spark.createDataFrame([(float(v), v) for v in range(1, 60)], "s double, n bigint")
    got = {r["s"]: r["cum_n"] for r in cumulate_groups(df, [], "s", ["n"], descending=True).collect()}
    assert got == {float(v): sum(range(v, 60)) for v in range(1, 60)}


def test_budgets_cut_through_ties(spark):
    r = random.Random(8)
    data = [(i, r.choice([0.9, 0.4, 0.4, 0.1]), r.randint(0, 1)) for i in range(300)]
    df = spark.createDataFrame(data, "id bigint, score double, label int")
    ranked = sorted(data, key=lambda x: (-x[1], x[0]))
    got = {x["fraction"]: (x["capacity"], x["reviewed"], x["tp"]) for x in E.topk_by_rank(df, (0.001, 0.1, 0.35, 1.0)).collect()}
    assert got == {f: (n, n, sum(y for _, _, y in ranked[:n])) for f, n in ((0.001, 1), (0.1, 30), (0.35, 105), (1.0, 300))}
    assert E.topk_by_rank(df.limit(0)).collect() == []


def test_positions_of_an_empty_table(spark):
    assert positions(spark.range(0), [F.asc("id")]).collect() == []
