"""Budgets, targets, bounds and ranking metrics on hand-made scores."""

import random

import pytest

from tellerlake.operators import evaluation as E
from tellerlake.plans.models import class_weights, impute_medians


def scored(spark, groups):
    rows, i = [], 0
    for score, n, positives in groups:
        for j in range(n):
            rows.append((i, float(score), int(j < positives)))
            i += 1
    return spark.createDataFrame(rows, "id bigint, score double, label int")


def test_budget_never_splits_ties(spark):
    groups = E.score_groups(scored(spark, [(0.9, 2, 1), (0.8, 2, 1), (0.7, 6, 0)]))
    got = {r["budget"]: r["threshold"] for r in E.budget_thresholds(groups, (0.1, 0.3, 0.4)).collect()}
    assert got == {0.3: 0.9, 0.4: 0.8}


def test_topk_bounds(spark):
    groups = E.score_groups(scored(spark, [(0.9, 5, 2), (0.8, 10, 4), (0.1, 1, 0)]))
    r = E.topk_bounds(groups, (0.5,)).first()
    assert (r["capacity"], r["slots"], r["tp_worst"], r["tp_best"]) == (8, 3, 2, 5)


def test_precision_target(spark):
    groups = E.score_groups(scored(spark, [(0.9, 100, 90), (0.5, 9900, 210)]))
    got = {r["target_precision"]: r for r in E.precision_targets(groups, (0.8, 0.95)).collect()}
    assert got[0.8]["feasible"] and got[0.8]["alerts"] == 100 and got[0.8]["precision"] == 0.9 and got[0.8]["recall"] == pytest.approx(0.3)
    assert not got[0.95]["feasible"] and got[0.95]["threshold"] is None
    few = E.score_groups(scored(spark, [(0.9, 1, 1), (0.5, 9999, 0)]))
    assert not E.precision_targets(few, (0.8,)).first()["feasible"]


def test_ranking_metrics_match_pair_counting(spark):
    r = random.Random(3)
    data = [(round(r.random(), 1), int(r.random() < 0.3)) for _ in range(200)]
    df = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(data)], "id bigint, score double, label int")
    got = E.ranking_metrics(E.score_groups(df)).first()
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got["roc_auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    ap, previous = 0.0, 0.0
    for s in sorted({s for s, _ in data}, reverse=True):
        tp, alerts = sum(y for x, y in data if x >= s), sum(x >= s for x, _ in data)
        ap, previous = ap + (tp / len(pos) - previous) * tp / alerts, tp / len(pos)
    assert got["average_precision"] == pytest.approx(ap)


def test_no_positives_gives_null_metrics(spark):
    got = E.ranking_metrics(E.score_groups(scored(spark, [(0.5, 4, 0)]))).first()
    assert got["average_precision"] is None and got["roc_auc"] is None


def test_confusion_with_no_alert_has_null_precision(spark):
    r = E.at_threshold(scored(spark, [(0.5, 4, 1)]), 0.9).first()
    assert r["precision"] is None and r["recall"] == 0 and r["tn"] == 3


def test_empirical_rank(spark):
    ref = spark.createDataFrame([(0.1,), (0.1,), (0.5,)], "score double")
    q = spark.createDataFrame([(1, 0.1), (2, 0.7)], "id bigint, score double")
    got = {r["id"]: r["rank"] for r in E.empirical_rank(ref, q, "score", "rank").collect()}
    assert got == {1: pytest.approx(2 / 3), 2: 1.0}


def test_gate(spark):
    cols = ("average_precision double, prevalence double, precision double, recall double, alerts bigint, roc_auc double, baseline_average_precision double, baseline_precision double")
    df = spark.createDataFrame([(0.004, 0.001, 0.002, 0.5, 200, 0.7, 0.001, 0.001), (0.004, 0.001, 0.02, 0.5, 200, 0.7, 0.001, 0.001)], cols)
    assert [r[0] for r in df.select(E.clears_gate()).collect()] == [False, True]


def test_permutation_keeps_pairs_and_breaks_order(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2) * 10) for i in range(200)], "id bigint, label int, weight double")
    got = E.permuted_labels(df, "id", ["label", "weight"]).collect()
    assert len({r["id"] for r in got}) == 200 and sum(r["label"] for r in got) == 100
    assert all(r["weight"] == r["label"] * 10 for r in got)
    assert any(r["label"] != r["id"] % 2 for r in got)


def test_weights_and_medians(spark):
    w = {r["label"]: r["class_weight"] for r in class_weights(scored(spark, [(0.5, 10, 2)])).collect()}
    assert w == {1: 2.5, 0: 0.625}
    df = spark.createDataFrame([(1, True, 1.0), (2, True, 3.0), (3, False, 100.0), (4, False, None)], "id int, fit boolean, v double")
    got = {r["id"]: (r["v"], r["v_missing"]) for r in impute_medians(df, df["fit"], ["v"]).collect()}
    assert got[4] == (2.0, 1.0) and got[3] == (100.0, 0.0)


def test_a_period_without_both_classes_stops_the_evaluation(spark):
    rows = [("fit", 1, True), ("fit", 2, False), ("selection", 3, False)]
    df = spark.createDataFrame(rows, "period string, at int, y boolean")
    summary = E.split_summary(df, "period", "at", "y")
    assert E.gated_split(summary, ["fit"]).count() == 2
    for periods in (["fit", "selection"], ["fit", "later"]):
        with pytest.raises(Exception, match=f"periods without both classes: {periods[1]}"):
            E.gated_split(summary, periods).collect()
