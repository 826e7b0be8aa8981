"""Ranking quality and review budgets on score groups; equal scores are never split.

Everything starts from one row per distinct score (per key), so the row-level data is aggregated once, before
any shuffle, and thresholds, curves and bounds are DataFrames over those groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.operators.latest import newest_per_group
from tellerlake.operators.ordering import cumulate_groups, positions, running_sums
from tellerlake.operators.running import attach_one_row

# Fixed protocol values.
REVIEW_BUDGETS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.10, 0.20)


def ratio(part: Column, whole: Column) -> Column:
    """NULL on a zero denominator, never 0 or 1."""
    return F.when(whole != 0, part / whole)


def attach_totals(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return attach_one_row(df, totals)
    renamed = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], *[c for c in totals.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
    return df.join(renamed, on).drop(*[f"_t_{k}" for k in keys])


def score_groups(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Rows and positives per score, their running totals from the highest score, and the totals `n` and `positives_all`."""
    groups = df.groupBy(*keys, F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    cum = cumulate_groups(groups, keys, "score", ["rows", "positives"], descending=True)
    totals = groups.groupBy(*keys).agg(F.sum("rows").alias("n"), F.sum("positives").alias("positives_all"))
    return attach_totals(cum, totals, keys)


def ranking_metrics(groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average precision and ROC area from score groups, ties kept whole; NULL without positives (or negatives)."""
    negatives, p, n = F.col("rows") - F.col("positives"), F.col("positives_all"), F.col("n")
    above = F.col("cum_positives") - F.col("positives")
    # Twice the number of (positive above negative) pairs, ties counted once: exact in integers.
    pairs = F.sum((2 * above + F.col("positives")) * negatives)
    gain = F.sum(F.col("positives") * F.col("cum_positives") / F.col("cum_rows"))
    out = groups.groupBy(*keys).agg(F.max("n").alias("rows"), F.max("positives_all").alias("positives"), F.count(F.lit(1)).alias("distinct_scores"),
                                    gain.alias("_gain"), pairs.alias("_pairs"))
    p, n = F.col("positives"), F.col("rows")
    return out.select(*keys, "rows", "positives", "distinct_scores", (p / n).alias("prevalence"), ratio(F.col("_gain"), p).alias("average_precision"),
                      ratio(F.col("_pairs") / 2, p * (n - p)).alias("roc_auc"))


def _point() -> list[Column]:
    alerts, tp = F.col("cum_rows"), F.col("cum_positives")
    return [F.col("score").alias("threshold"), alerts.alias("alerts"), tp.alias("tp"), (alerts - tp).alias("fp"), ratio(tp, alerts).alias("precision"),
            ratio(tp, F.col("positives_all")).alias("recall"), (alerts / F.col("n")).alias("alert_rate")]


def confusion(alerts: str = "alerts", tp: str = "tp", n: str = "n", positives: str = "positives_all") -> dict[str, Column]:
    a, t, total, p = F.col(alerts), F.col(tp), F.col(n), F.col(positives)
    return {"fp": a - t, "fn": p - t, "tn": total - p - (a - t), "precision": ratio(t, a), "recall": ratio(t, p), "alert_rate": a / total}


def at_threshold(df: DataFrame, threshold: float, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    hit, positive = F.col(score) >= threshold, F.col(label) == 1
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(positive, 1)).alias("positives_all"), F.count(F.when(hit, 1)).alias("alerts"),
                                    F.count(F.when(hit & positive, 1)).alias("tp"))
    return counted.select("*", *[c.alias(n) for n, c in confusion().items()])


def _per_value(groups: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    return groups.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def budget_thresholds(groups: DataFrame, budgets: Sequence[float] = REVIEW_BUDGETS, keys: Sequence[str] = ()) -> DataFrame:
    """Per budget, the lowest score whose whole tie group still fits floor(n * budget); no row when none fits."""
    fits = _per_value(groups, "budget", budgets).where(F.col("cum_rows") <= F.floor(F.col("n") * F.col("budget")))
    row = F.struct(*[c for c in groups.columns if c not in keys])
    return fits.groupBy(*keys, "budget").agg(F.max_by(row, "cum_rows").alias("g")).select(*keys, "budget", "g.*").select(*keys, "budget", *_point())


def precision_targets(groups: DataFrame, targets: Sequence[float], max_alert_rate: float = 0.01, min_alerts: int = 100, min_recall: float = 0.2,
                      keys: Sequence[str] = ()) -> DataFrame:
    """Per target, the supported point with most true positives, then fewest alerts; infeasible targets are listed."""
    points = groups.select(*keys, "cum_rows", "cum_positives", *_point())
    ok = ((F.col("precision") >= F.col("target")) & (F.col("recall") >= min_recall) & (F.col("alerts") >= min_alerts) & (F.col("alert_rate") <= max_alert_rate))
    best = F.max_by(F.struct("threshold", "alerts", "tp", "fp", "precision", "recall", "alert_rate"), F.when(ok, F.struct("tp", (-F.col("alerts")).alias("fewest"))))
    return (_per_value(points, "target", targets).groupBy(*keys, F.col("target").alias("target_precision")).agg(best.alias("g"))
            .select(*keys, "target_precision", F.col("g").isNotNull().alias("feasible"), "g.*"))


def topk_bounds(groups: DataFrame, fractions: Sequence[float] = REVIEW_BUDGETS, keys: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Best and worst true positives when the top ceil(n * fraction) rows cut through a tie group. `extra`: columns of the groups to keep, and
    `higher_tp`, the true positives above that group."""
    spread = _per_value(groups, "fraction", fractions).withColumn("capacity", F.ceil(F.col("n") * F.col("fraction")))
    cut = spread.where((F.col("cum_rows") >= F.col("capacity")) & (F.col("cum_rows") - F.col("rows") < F.col("capacity")))
    higher_rows, higher_tp = F.col("cum_rows") - F.col("rows"), F.col("cum_positives") - F.col("positives")
    slots = F.greatest(F.lit(0), F.least(F.col("rows"), F.col("capacity") - higher_rows))
    low = higher_tp + F.greatest(F.lit(0), slots - (F.col("rows") - F.col("positives")))
    high = higher_tp + F.least(slots, F.col("positives"))
    return cut.select(*keys, "fraction", "capacity", F.col("score").alias("boundary_score"), slots.alias("slots"), F.col("rows").alias("tie_rows"),
                      F.col("positives").alias("tie_positives"), low.alias("tp_worst"), high.alias("tp_best"),
                      (low / F.col("capacity")).alias("precision_worst"), (high / F.col("capacity")).alias("precision_best"), (slots < F.col("rows")).alias("tie_split"),
                      *[higher_tp.alias(c) if c == "higher_tp" else F.col(c) for c in extra])


def topk_by_rank(df: DataFrame, fractions: Sequence[float] = REVIEW_BUDGETS, score: str = "score", row_id: str = "id", label: str = "label") -> DataFrame:
    """Reviewed rows, true positives, recall and lift for each budget under the deterministic rank (score, then id).

    Whole groups of equal scores above the capacity count as they are; only the rows of the group that the capacity cuts are put in order."""
    cut = topk_bounds(score_groups(df, (), score, label), fractions, extra=("n", "positives_all", "higher_tp"))
    edges = cut.select(F.col("boundary_score").alias("_edge")).distinct()  # no more rows than fractions
    tied = df.select(F.col(score).alias("_edge"), row_id, F.col(label).cast("bigint").alias("_positive"), F.lit(1).alias("_row")).join(F.broadcast(edges), "_edge")
    tied = running_sums(tied, ["_edge"], [F.asc(row_id)], ["_row", "_positive"]).select("_edge", "cum__row", "cum__positive")
    out = tied.join(F.broadcast(cut), (F.col("_edge") == F.col("boundary_score")) & (F.col("cum__row") == F.col("slots")))
    out = out.withColumn("reviewed", F.col("capacity")).withColumn("tp", F.col("higher_tp") + F.col("cum__positive"))
    precision = ratio(F.col("tp"), F.col("reviewed"))
    return out.select("fraction", "capacity", "reviewed", "tp", ratio(F.col("tp"), F.col("positives_all")).alias("recall"), precision.alias("precision"),
                      ratio(precision, F.col("positives_all") / F.col("n")).alias("lift"))


def frozen_evaluation(df: DataFrame, thresholds: DataFrame, slices: dict[str, Column], score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts of every slice value at thresholds chosen elsewhere. `thresholds` has a row per budget."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), c.cast("string").alias("value")) for n, c in slices.items()]))
    counted = df.select(F.col(score).alias("score"), F.col(label).alias("_label"), pairs.alias("s")).groupBy("s.slice", "s.value", "score").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("_label").cast("bigint")).alias("positives"))
    listed = thresholds.agg(F.collect_list(F.struct("budget", "threshold")).alias("_points"))  # one entry per budget
    at = attach_one_row(counted, listed).select("*", F.explode("_points").alias("p"))
    hit = F.col("score") >= F.col("p.threshold")
    out = at.groupBy("slice", "value", F.col("p.budget").alias("budget"), F.col("p.threshold").alias("threshold")).agg(
        F.sum("rows").alias("n"), F.sum("positives").alias("positives_all"), F.coalesce(F.sum(F.when(hit, F.col("rows"))), F.lit(0)).alias("alerts"),
        F.coalesce(F.sum(F.when(hit, F.col("positives"))), F.lit(0)).alias("tp"))
    return out.select("*", *[c.alias(n) for n, c in confusion().items()])


def empirical_rank(reference: DataFrame, scored: DataFrame, score: str, name: str) -> DataFrame:
    """Fraction of reference scores at or below each row's score; equal scores get equal ranks."""
    points = reference.select(F.col(score).alias("_s"), F.lit(1).alias("_n")).unionByName(scored.select(F.col(score).alias("_s"), F.lit(0).alias("_n")))
    groups = points.groupBy("_s").agg(F.sum("_n").alias("_n"))
    cum = attach_one_row(cumulate_groups(groups, [], "_s", ["_n"]), groups.agg(F.sum("_n").alias("_all")))
    ranks = cum.select("_s", (F.col("cum__n") / F.col("_all")).alias(name))
    return scored.join(ranks, F.col(score) == F.col("_s")).drop("_s")


def permuted_labels(df: DataFrame, row_id: str, pairs: Sequence[str], seed: int = 42) -> DataFrame:
    """Control data: label and weight stay together but move to another row, by rank of a seeded hash."""
    by_id = positions(df.drop(*pairs), [F.asc(row_id)])
    hashed = df.select(row_id, *pairs, F.xxhash64(F.col(row_id), F.lit(seed)).alias("_hash"))
    by_hash = positions(hashed, [F.desc("_hash"), F.asc(row_id)]).select("rank", *pairs)
    return by_id.join(by_hash, "rank").drop("rank")


def best_candidate(attempts: DataFrame, by: str = "average_precision", name: str = "candidate") -> DataFrame:
    return attempts.orderBy(F.desc_nulls_last(by), F.asc(name)).limit(1)


def clears_gate(prefix: str = "", baseline: str = "baseline_") -> Column:
    """A worthwhile ranking gain with support; not a promotion."""
    def c(n: str) -> Column:
        return F.col(prefix + n)
    return F.coalesce(
        (c("average_precision") >= F.greatest(3 * c("prevalence"), 1.5 * F.col(f"{baseline}average_precision")))
        & (c("precision") >= F.greatest(F.lit(0.01), 2 * F.coalesce(F.col(f"{baseline}precision"), F.lit(0.0))))
        & (c("recall") >= 0.10) & (c("alerts") >= 100) & (c("roc_auc") >= 0.60), F.lit(False))


def baselines(df: DataFrame, label: str = "label") -> DataFrame:
    """What a constant score and an always-negative rule achieve."""
    out = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    rate = F.col("positives") / F.col("n")
    return out.select("n", "positives", rate.alias("constant_average_precision"), F.lit(0.5).alias("constant_roc_auc"), (1 - rate).alias("always_negative_accuracy"))


def split_summary(df: DataFrame, period: str, at: str, label: str) -> DataFrame:
    """Rows, positives and range per period, and whether both classes are present."""
    out = df.groupBy(period).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(label).cast("int") == 1, 1)).alias("positives"),
                                 F.min(at).alias("min_date"), F.max(at).alias("max_date"))
    return out.withColumn("both_classes", (F.col("positives") > 0) & (F.col("positives") < F.col("rows")))


def gated_split(summary: DataFrame, periods: Sequence[str]) -> DataFrame:
    """The split, or an error that names the periods which are absent or lack a class: nothing is evaluated on them."""
    found = summary.agg(F.collect_set(F.when(F.col("both_classes"), F.col("period"))).alias("_ready"))  # one entry per period
    missing = F.array_except(F.array(*[F.lit(p) for p in periods]), F.col("_ready"))
    fails = F.raise_error(F.concat(F.lit("periods without both classes: "), F.array_join(missing, ", "))).cast("boolean")
    return attach_one_row(summary, found).where(F.when(F.size(missing) > 0, fails).otherwise(F.lit(True))).drop("_ready")


def snapshot_checks(points: DataFrame) -> DataFrame:
    """Internal consistency of confusion counts before they are published."""
    a, t = F.col("alerts"), F.col("tp")
    return points.select("*", (
        (t + F.col("fp") == a) & (t + F.col("fn") == F.col("positives_all")) & (a + F.col("fn") + F.col("tn") == F.col("n")) & (t <= a) & (a <= F.col("n"))).alias("consistent"))


def feature_diagnostics(fit: DataFrame, later: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Missing share and distinct values on the fit period, and the share of later rows with an unseen category."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count(F.when(F.col(c).isNull(), 1)).alias(f"m_{c}") for c in (*numeric, *categorical)]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"m_{c}") / F.col("n")).alias("missing_fraction")) for c in (*numeric, *categorical)])
    missing = fit.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")

    def long(df: DataFrame, names: Sequence[str]) -> DataFrame:
        pair = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in names]))
        return df.select(pair.alias("p")).groupBy("p.feature", "p.value").agg(F.count(F.lit(1)).alias("n"))
    seen = long(fit, [*numeric, *categorical])
    distinct = seen.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct_values"))
    known = seen.select(F.col("feature").alias("_f"), F.col("value").alias("_v"))
    checked = long(later, categorical).join(known, (F.col("feature") == F.col("_f")) & F.col("value").eqNullSafe(F.col("_v")), "left")
    unseen = checked.groupBy("feature").agg((F.coalesce(F.sum(F.when(F.col("_f").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("unseen_fraction"))
    return missing.join(distinct, "feature").join(unseen, "feature", "left")
