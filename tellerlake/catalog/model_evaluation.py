"""Ranking metrics, budgets and protocol checks on labelled scores."""

from pyspark.sql import functions as F

from tellerlake.operators import evaluation as E
from tellerlake.operators.ordering import exact_percentiles, global_rank
from tellerlake.registry import query
from tellerlake.standin import oracle

BUDGETS, TARGETS = (0.01, 0.05, 0.1, 0.3), (0.05, 0.1, 0.2, 0.9)
GROUPS = """groups AS (SELECT score, count(*) AS rows, sum(label)::BIGINT AS positives FROM scored GROUP BY 1),
  cum AS (SELECT *, sum(rows) OVER (ORDER BY score DESC)::BIGINT AS cum_rows, sum(positives) OVER (ORDER BY score DESC)::BIGINT AS cum_positives,
    (SELECT count(*) FROM scored) AS n, (SELECT sum(label)::BIGINT FROM scored) AS positives_all FROM groups)"""
KEYED = """cum AS (SELECT period, score, rows, positives, sum(rows) OVER w::BIGINT AS cum_rows, sum(positives) OVER w::BIGINT AS cum_positives, sum(rows) OVER p::BIGINT AS n, sum(positives) OVER p::BIGINT AS positives_all
  FROM (SELECT period, score, count(*) AS rows, sum(label)::BIGINT AS positives FROM scored GROUP BY ALL) WINDOW w AS (PARTITION BY period ORDER BY score DESC), p AS (PARTITION BY period))"""
METRICS = """max(n) AS rows, max(positives_all) AS positives, count(*) AS distinct_scores, max(positives_all) / max(n) AS prevalence,
  round(sum(positives * cum_positives / cum_rows) / nullif(max(positives_all), 0), 9) AS average_precision,
  round(sum((2 * (cum_positives - positives) + positives) * (rows - positives))::DOUBLE / 2 / nullif(max(positives_all) * (max(n) - max(positives_all)), 0), 9) AS roc_auc"""
POINT = "score AS threshold, cum_rows AS alerts, cum_positives AS tp, cum_rows - cum_positives AS fp, cum_positives / cum_rows AS precision, cum_positives / positives_all AS recall, cum_rows / n AS alert_rate"


def values(name, numbers):
    return f"(VALUES {', '.join(f'({x}::DOUBLE)' for x in numbers)}) v({name})"


def scored_oracle(body):
    return oracle("scored", f"WITH {GROUPS} {body}")


def rounded(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c in names else c for c in df.columns])


@query("w16_cumulative_score_groups", scored_oracle("SELECT score, rows, positives, cum_rows, cum_positives FROM cum"))
def _(b):
    return E.score_groups(b.scored).drop("n", "positives_all")


@query("w17_global_rank", oracle("scored", "SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored"))
def _(b):
    return global_rank(b.scored.select("id", "score"), "score", "id")


@query("w17_global_rank_orders", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def _(b):
    return global_rank(b.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("w17_rank_bunched_scores", """SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
  SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_linenumber <= 5 THEN 0 ELSE CAST(l_extendedprice AS DOUBLE) / 1e6 END AS score FROM lineitem)""")
def _(b):
    """Most scores are 0, the others continuous."""
    score = F.when(F.col("l_linenumber") <= 5, 0.0).otherwise(F.col("l_extendedprice").cast("double") / 1e6)
    return global_rank(b.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), score.alias("score")), "score", "id")


@query("w17_rank_equal_scores", "SELECT o_orderkey, 0.5::DOUBLE AS score, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders")
def _(b):
    return global_rank(b.orders.select("o_orderkey", F.lit(0.5).alias("score")), "score", "o_orderkey")


@query("w16_continuous_score_curve", """SELECT score, rows, positives, sum(rows) OVER (ORDER BY score DESC)::BIGINT AS cum_rows, sum(positives) OVER (ORDER BY score DESC)::BIGINT AS cum_positives
  FROM (SELECT CASE WHEN l_linenumber <= 3 THEN 0 ELSE CAST(l_extendedprice AS DOUBLE) / 1e6 END AS score, count(*) AS rows, count(*) FILTER (WHERE l_returnflag = 'R') AS positives FROM lineitem GROUP BY 1)""")
def _(b):
    score = F.when(F.col("l_linenumber") <= 3, 0.0).otherwise(F.col("l_extendedprice").cast("double") / 1e6)
    rows = b.lineitem.select(score.alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return E.score_groups(rows).drop("n", "positives_all")


RANKED = f"""r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () AS n, sum(label) OVER ()::BIGINT AS p FROM scored),
  k AS (SELECT fraction, CAST(ceil(n * fraction) AS BIGINT) AS capacity, rank, label, n, p FROM r, {values('fraction', E.REVIEW_BUDGETS)})"""


@query("o03_budget_topk", oracle("scored", f"""WITH {RANKED} SELECT fraction, max(capacity) AS capacity, count(*) FILTER (WHERE rank <= capacity) AS reviewed,
  count(*) FILTER (WHERE rank <= capacity AND label = 1) AS tp FROM k GROUP BY 1"""))
def _(b):
    return E.topk_by_rank(b.scored).select("fraction", "capacity", "reviewed", "tp")


@query("m21_lift", oracle("scored", f"""WITH {RANKED}, t AS (SELECT fraction, count(*) FILTER (WHERE rank <= capacity) AS reviewed, count(*) FILTER (WHERE rank <= capacity AND label = 1) AS tp, max(n) AS n, max(p) AS p FROM k GROUP BY 1)
  SELECT fraction, tp / reviewed AS precision, tp / p AS recall, (tp / reviewed) / (p / n) AS lift FROM t"""))
def _(b):
    return E.topk_by_rank(b.scored).select("fraction", "precision", "recall", "lift")


@query("m12_empirical_rank", oracle("scored", """
  SELECT id, (SELECT count(*) FROM scored r WHERE period = 'fit' AND r.score <= s.score) / (SELECT count(*) FROM scored WHERE period = 'fit') AS rank_a,
    (SELECT count(*) FROM scored r WHERE period = 'fit' AND r.other_score <= s.other_score) / (SELECT count(*) FROM scored WHERE period = 'fit') AS rank_b FROM scored s""").replace(
    "SELECT id, (SELECT", "SELECT id, rank_a, rank_b, (rank_a + rank_b) / 2 AS blend FROM (SELECT id, (SELECT") + ")")
def _(b):
    fit = b.scored.where("period = 'fit'")
    both = E.empirical_rank(fit, E.empirical_rank(fit, b.scored, "score", "rank_a"), "other_score", "rank_b")
    return both.select("id", "rank_a", "rank_b", ((F.col("rank_a") + F.col("rank_b")) / 2).alias("blend"))


@query("m13_permuted_labels")
def _(b):
    return E.permuted_labels(b.scored.select("id", "score", "label", F.lit(1.0).alias("weight")), "id", ["label", "weight"])


@query("m13_permutation_keeps_counts", oracle("scored", "SELECT count(*) AS n, sum(label)::BIGINT AS positives, count(DISTINCT id) AS ids FROM scored"))
def _(b):
    out = E.permuted_labels(b.scored.select("id", "label"), "id", ["label"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.count_distinct("id").alias("ids"))


@query("m16_ranking_metrics", oracle("scored", f"WITH {KEYED} SELECT period, {METRICS} FROM cum GROUP BY period"))
def _(b):
    return rounded(E.ranking_metrics(E.score_groups(b.scored, ["period"]), ["period"]), "average_precision", "roc_auc")


@query("m17_confusion", oracle("scored", """
  WITH t AS (SELECT country, count(*) AS n, sum(label)::BIGINT AS positives_all, count(*) FILTER (WHERE score >= 0.9) AS alerts, count(*) FILTER (WHERE score >= 0.9 AND label = 1) AS tp FROM scored GROUP BY 1)
  SELECT *, alerts - tp AS fp, positives_all - tp AS fn, n - positives_all - (alerts - tp) AS tn, tp / nullif(alerts, 0) AS precision, tp / nullif(positives_all, 0) AS recall, alerts / n AS alert_rate FROM t"""))
def _(b):
    return E.at_threshold(b.scored, 0.9, ["country"])


@query("m18_budget_thresholds", scored_oracle(f"""SELECT budget, {POINT} FROM (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY cum_rows DESC) AS k
  FROM cum, {values('budget', BUDGETS)} WHERE cum_rows <= floor(n * budget)) WHERE k = 1"""))
def _(b):
    return E.budget_thresholds(E.score_groups(b.scored), BUDGETS)


@query("m19_precision_targets", scored_oracle(f""", ok AS (SELECT target, {POINT}, row_number() OVER (PARTITION BY target ORDER BY cum_positives DESC, cum_rows) AS k
    FROM cum, {values('target', TARGETS)} WHERE cum_positives / cum_rows >= target AND cum_positives / positives_all >= 0.1 AND cum_rows >= 10 AND cum_rows / n <= 0.5)
  SELECT v.target AS target_precision, ok.target IS NOT NULL AS feasible, threshold, alerts, tp, fp, precision, recall, alert_rate
  FROM {values('target', TARGETS)} LEFT JOIN ok ON ok.target = v.target AND k = 1""").replace("FROM groups) ,", "FROM groups),"))
def _(b):
    return E.precision_targets(E.score_groups(b.scored), TARGETS, max_alert_rate=0.5, min_alerts=10, min_recall=0.1)


@query("m20_topk_bounds", scored_oracle(f""", c AS (SELECT *, CAST(ceil(n * fraction) AS BIGINT) AS capacity FROM cum, {values('fraction', BUDGETS)}),
  h AS (SELECT *, cum_rows - rows AS hr, cum_positives - positives AS hp, least(rows, capacity - (cum_rows - rows)) AS slots FROM c WHERE cum_rows >= capacity AND cum_rows - rows < capacity)
  SELECT fraction, capacity, score AS boundary_score, slots, rows AS tie_rows, positives AS tie_positives, hp + greatest(0, slots - (rows - positives)) AS tp_worst, hp + least(slots, positives) AS tp_best,
    (hp + greatest(0, slots - (rows - positives))) / capacity AS precision_worst, (hp + least(slots, positives)) / capacity AS precision_best, slots < rows AS tie_split FROM h""").replace("FROM groups) ,", "FROM groups),"))
def _(b):
    return E.topk_bounds(E.score_groups(b.scored), BUDGETS)


FROZEN = f"""op AS (SELECT score, sum(count(*)) OVER (ORDER BY score DESC)::BIGINT AS cum_rows, (SELECT count(*) FROM scored WHERE period = 'operating_point') AS n FROM scored WHERE period = 'operating_point' GROUP BY score),
  th AS (SELECT budget, min(score) AS threshold FROM op, {values('budget', (0.05, 0.1, 0.3))} WHERE cum_rows <= floor(n * budget) GROUP BY 1),
  t AS (SELECT slice, value, budget, threshold, count(*) AS n, sum(label)::BIGINT AS positives_all, count(*) FILTER (WHERE score >= threshold) AS alerts, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp
    FROM (SELECT label, score, unnest(['country', 'channel']) AS slice, unnest([country, channel]) AS value FROM scored WHERE period = 'exploratory_validation'), th GROUP BY ALL)"""


def frozen(b):
    points = E.budget_thresholds(E.score_groups(b.scored.where("period = 'operating_point'")), (0.05, 0.1, 0.3))
    later = b.scored.where("period = 'exploratory_validation'")
    return E.frozen_evaluation(later, points, {"country": F.col("country"), "channel": F.col("channel")})


@query("m22_frozen_thresholds", oracle("scored", f"""WITH {FROZEN} SELECT *, alerts - tp AS fp, positives_all - tp AS fn, n - positives_all - (alerts - tp) AS tn, tp / nullif(alerts, 0) AS precision,
  tp / nullif(positives_all, 0) AS recall, alerts / n AS alert_rate FROM t"""))
def _(b):
    return frozen(b)


@query("m26_evidence_snapshot", oracle("scored", f"WITH {FROZEN} SELECT slice, value, budget, alerts, tp, true AS consistent FROM t"))
def _(b):
    return E.snapshot_checks(frozen(b)).select("slice", "value", "budget", "alerts", "tp", "consistent")


def attempts(b):
    parts = []
    for name in ("score", "other_score"):
        parts.append(E.ranking_metrics(E.score_groups(b.scored, score=name)).withColumn("candidate", F.lit(name)))
    return parts[0].unionByName(parts[1])


CANDIDATES = """att AS (SELECT 'score' AS candidate, {m} FROM cum UNION ALL SELECT 'other_score', {m} FROM (
    SELECT *, sum(rows) OVER (ORDER BY score DESC)::BIGINT AS cum_rows, sum(positives) OVER (ORDER BY score DESC)::BIGINT AS cum_positives, (SELECT count(*) FROM scored) AS n, (SELECT sum(label)::BIGINT FROM scored) AS positives_all
    FROM (SELECT other_score AS score, count(*) AS rows, sum(label)::BIGINT AS positives FROM scored GROUP BY 1)))""".replace("{m}", METRICS)


@query("m14_best_candidate", scored_oracle(f", {CANDIDATES} SELECT * FROM att ORDER BY average_precision DESC, candidate LIMIT 1").replace("FROM groups) ,", "FROM groups),"))
def _(b):
    return rounded(E.best_candidate(attempts(b)), "average_precision", "roc_auc")


@query("a30_side_by_side", scored_oracle(f""", {CANDIDATES} SELECT metric, max(value) FILTER (WHERE candidate = 'score') AS score, max(value) FILTER (WHERE candidate = 'other_score') AS other_score
  FROM (SELECT candidate, unnest(['average_precision', 'roc_auc', 'prevalence']) AS metric, unnest([average_precision, roc_auc, prevalence]) AS value FROM att) GROUP BY metric""").replace("FROM groups) ,", "FROM groups),"))
def _(b):
    long = attempts(b).unpivot(["candidate"], ["average_precision", "roc_auc", "prevalence"], "metric", "value")
    wide = long.groupBy("metric").pivot("candidate", ["score", "other_score"]).agg(F.max("value"))
    return wide.select("metric", *[F.when(F.col("metric") == "prevalence", F.col(c)).otherwise(F.round(c, 9)).alias(c) for c in ("score", "other_score")])


@query("m23_exploratory_gate", scored_oracle(f""", {CANDIDATES}, g AS (SELECT *, (SELECT average_precision FROM att WHERE candidate = 'other_score') AS bap FROM att),
  t AS (SELECT count(*) FILTER (WHERE score >= 0.5) AS alerts, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, sum(label)::BIGINT AS p FROM scored)
  SELECT candidate, coalesce(average_precision >= greatest(3 * prevalence, 1.5 * bap) AND tp / alerts >= greatest(0.01, 2 * 0.05) AND tp / p >= 0.1 AND alerts >= 100 AND roc_auc >= 0.6, false) AS passed
  FROM g, t WHERE candidate = 'score'""").replace("FROM groups) ,", "FROM groups),"))
def _(b):
    from tellerlake.operators.running import attach_one_row
    rows = attempts(b)
    base = rows.where("candidate = 'other_score'").select(F.col("average_precision").alias("baseline_average_precision"), F.lit(0.05).alias("baseline_precision"))
    point = E.at_threshold(b.scored, 0.5).select("alerts", "precision", "recall")
    own = attach_one_row(attach_one_row(rows.where("candidate = 'score'"), base), point)
    return own.select("candidate", E.clears_gate().alias("passed"))


@query("m24_baselines", oracle("scored", """SELECT count(*) AS n, sum(label)::BIGINT AS positives, sum(label) / count(*) AS constant_average_precision, 0.5::DOUBLE AS constant_roc_auc,
  1 - sum(label) / count(*) AS always_negative_accuracy FROM scored"""))
def _(b):
    return E.baselines(b.scored)


@query("c14_alert_budget_report", oracle("scored", f"""WITH {KEYED}, c AS (SELECT *, CAST(ceil(n * fraction) AS BIGINT) AS capacity FROM cum, {values('fraction', E.REVIEW_BUDGETS)}),
  h AS (SELECT *, cum_positives - positives AS hp, least(rows, capacity - (cum_rows - rows)) AS slots FROM c WHERE cum_rows >= capacity AND cum_rows - rows < capacity),
  f AS (SELECT period, fraction AS budget, min(score) AS threshold, max(cum_rows) AS alerts, max(cum_positives) AS tp FROM c WHERE cum_rows <= floor(n * fraction) GROUP BY ALL)
  SELECT h.period, fraction, capacity, threshold, alerts, tp, hp + greatest(0, slots - (rows - positives)) AS tp_worst, hp + least(slots, positives) AS tp_best FROM h LEFT JOIN f ON f.period = h.period AND f.budget = h.fraction"""))
def _(b):
    groups = E.score_groups(b.scored, ["period"])
    fixed = E.budget_thresholds(groups, keys=["period"]).select("period", F.col("budget").alias("fraction"), "threshold", "alerts", "tp")
    return E.topk_bounds(groups, keys=["period"]).join(fixed, ["period", "fraction"], "left").select(
        "period", "fraction", "capacity", "threshold", "alerts", "tp", "tp_worst", "tp_best")


PERIOD = "CASE WHEN transaction_date < TIMESTAMP '1999-01-01' THEN 'fit' WHEN transaction_date < TIMESTAMP '2000-01-01' THEN 'selection' WHEN transaction_date < TIMESTAMP '2000-07-01' THEN 'operating_point' ELSE 'exploratory_validation' END"


def periods():
    from tellerlake.functions.calendar import development_period
    return development_period(F.col("transaction_date"), "1999-01-01", "2000-01-01", "2000-07-01")


@query("f11_period_labels", oracle("transactions", f"""SELECT transaction_id, {PERIOD} AS period, CASE WHEN transaction_date < TIMESTAMP '1999-07-01' THEN 'train' WHEN transaction_date < TIMESTAMP '2001-01-01' THEN 'validation'
  ELSE 'final_test' END AS split FROM transactions"""))
def _(b):
    from tellerlake.functions.calendar import split_label
    return b.transactions.select("transaction_id", periods().alias("period"), split_label(F.col("transaction_date"), "1999-07-01", "2001-01-01").alias("split"))


SPLIT = """SELECT period, count(*) AS rows, count(*) FILTER (WHERE is_fraud) AS positives, min(transaction_date) AS min_date, max(transaction_date) AS max_date,
  count(*) FILTER (WHERE is_fraud) BETWEEN 1 AND count(*) - 1 AS both_classes FROM p GROUP BY 1"""


@query("a32_split_summary", oracle("transactions", f"WITH p AS (SELECT *, {PERIOD} AS period FROM transactions WHERE transaction_date < TIMESTAMP '2001-01-01') {SPLIT}"))
def _(b):
    from tellerlake.functions.calendar import before
    tx = b.transactions.where(before(F.col("transaction_date"), "2001-01-01"))
    return E.split_summary(tx.withColumn("period", periods()), "period", "transaction_date", "is_fraud")


@query("m27_period_freeze", oracle("transactions", f"WITH p AS (SELECT *, {PERIOD} AS period FROM transactions), s AS ({SPLIT}) SELECT count(*) AS periods, bool_and(both_classes) AS ready FROM s"))
def _(b):
    rows = E.split_summary(b.transactions.withColumn("period", periods()), "period", "transaction_date", "is_fraud")
    return rows.agg(F.count(F.lit(1)).alias("periods"), F.bool_and("both_classes").alias("ready"))


DATED = ("fit", "selection", "operating_point", "exploratory_validation")


@query("m27_gated_split", oracle("transactions", f"WITH p AS (SELECT *, {PERIOD} AS period FROM transactions) {SPLIT}"))
def _(b):
    """The split passes the gate: every period is there and holds both classes."""
    rows = E.split_summary(b.transactions.withColumn("period", periods()), "period", "transaction_date", "is_fraud")
    return E.gated_split(rows, DATED)


def _diagnostic(c, categorical):
    unseen = f"(SELECT count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM p f WHERE f.period = 'fit' AND f.{c} IS NOT DISTINCT FROM s.{c})) / count(*) FROM p s WHERE period = 'selection')" if categorical else "NULL"
    return f"SELECT '{c}' AS feature, (SELECT count(*) FILTER (WHERE {c} IS NULL) / count(*) FROM p WHERE period = 'fit') AS missing_fraction, (SELECT count(*) FROM (SELECT DISTINCT {c} FROM p WHERE period = 'fit')) AS distinct_values, {unseen} AS unseen_fraction"


@query("a33_feature_diagnostics", oracle("transactions", f"WITH p AS (SELECT *, {PERIOD} AS period FROM transactions) " + " UNION ALL ".join(
    _diagnostic(c, k) for c, k in (("amount", False), ("amount_usd", False), ("merchant_name", True), ("transaction_country", True)))))
def _(b):
    tx = b.transactions.withColumn("period", periods())
    return E.feature_diagnostics(tx.where("period = 'fit'"), tx.where("period = 'selection'"), ["amount", "amount_usd"], ["merchant_name", "transaction_country"])


@query("m06_median_imputation", oracle("transactions", f"""WITH p AS (SELECT *, {PERIOD} AS period FROM transactions), m AS (SELECT quantile_cont(amount_usd::DOUBLE, 0.5) AS med FROM p WHERE period = 'fit')
  SELECT transaction_id, coalesce(CAST(amount_usd AS DOUBLE), med) AS amount_usd, CASE WHEN amount_usd IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS amount_usd_missing FROM p, m"""))
def _(b):
    from tellerlake.plans.models import impute_medians
    tx = b.transactions.withColumn("period", periods()).withColumn("amount_usd", F.col("amount_usd").cast("double"))
    return impute_medians(tx, F.col("period") == "fit", ["amount_usd"]).select("transaction_id", "amount_usd", "amount_usd_missing")


@query("m08_class_weights", oracle("scored", """SELECT id, label, CASE WHEN label = 1 THEN n / (2.0::DOUBLE * p) ELSE n / (2.0::DOUBLE * (n - p)) END AS class_weight
  FROM scored, (SELECT count(*) AS n, sum(label) AS p FROM scored)"""))
def _(b):
    from tellerlake.plans.models import class_weights
    return class_weights(b.scored.select("id", "label"))
