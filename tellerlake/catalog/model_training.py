"""spark.ml preparation, candidates and scoring on the first feature frame."""

from pyspark.sql import functions as F

from tellerlake.plans import models as M
from tellerlake.plans.training import basic_frame, labelled
from tellerlake.registry import query
from tellerlake.session import cut_lineage

NUMERIC = ["amount", "log_abs_amount", "amount_sign", "amount_usd_norm", "weekday", "is_weekend"]
CATEGORICAL = ["currency", "transaction_type", "channel", "merchant_category"]


def frames(b):
    rows = labelled(b.transactions).select("transaction_id", "label", (F.col("transaction_date") < F.lit("2000-01-01").cast("timestamp_ntz")).alias("fit"))
    # Preparation and training make many passes: the join is written once, with the columns that they read.
    frame = cut_lineage(basic_frame(b.transactions).join(rows, "transaction_id").select("transaction_id", "label", "fit", *NUMERIC, *CATEGORICAL))
    return frame.where("fit"), frame.where("NOT fit")


def attempts_frame(b, attempts):
    return b.spark.createDataFrame([(a["candidate"], a["status"], a["area_under_pr"], a["area_under_roc"]) for a in attempts],
                                   "candidate string, status string, area_under_pr double, area_under_roc double")


@query("m07_category_vectors")
def _(b):
    fit, later = frames(b)
    model = M.preparation(NUMERIC, CATEGORICAL).fit(M.nan_for_null(fit, NUMERIC))
    return model.transform(M.nan_for_null(later, NUMERIC)).select("transaction_id", F.col("currency_index").cast("int").alias("currency_index"), F.col("channel_index").cast("int").alias("channel_index"))


@query("m09_model_candidates")
def _(b):
    fit, later = frames(b)
    _, _, attempts = M.fit_candidates(fit, later, NUMERIC, CATEGORICAL, ["logistic_regression", "decision_tree", "random_forest"])
    return attempts_frame(b, attempts)


@query("m10_boosted_trees")
def _(b):
    fit, later = frames(b)
    sampled = M.sample_negatives(fit, "transaction_id")
    prep = M.preparation(NUMERIC, CATEGORICAL).fit(M.nan_for_null(sampled, NUMERIC))
    held_out = F.pmod(F.xxhash64("transaction_id"), F.lit(5)) == 0
    train = cut_lineage(prep.transform(M.nan_for_null(sampled, NUMERIC)).withColumn("held_out", held_out).select("transaction_id", "label", "features", "sample_weight", "held_out"))
    model = M.candidates("sample_weight", "held_out")["boosted_trees"].fit(train)
    return M.with_scores(model, prep.transform(M.nan_for_null(later, NUMERIC))).select("transaction_id", "label", "score")


@query("m11_balanced_forest")
def _(b):
    fit, later = frames(b)
    prep = M.preparation(NUMERIC, CATEGORICAL).fit(M.nan_for_null(fit, NUMERIC))
    model = M.balanced_forest(prep.transform(M.nan_for_null(fit, NUMERIC)))
    return M.with_scores(model, prep.transform(M.nan_for_null(later, NUMERIC))).select("transaction_id", "label", "score")


NOVELTY = """WITH p AS (SELECT o_orderkey AS id, o_totalprice AS a, ln(o_totalprice) AS l, o_orderdate < TIMESTAMP '2000-01-01' AS fit FROM orders),
  q AS (SELECT quantile_cont(a, 0.25) AS a1, quantile_cont(a, 0.5) AS a2, quantile_cont(a, 0.75) AS a3, quantile_cont(l, 0.25) AS l1, quantile_cont(l, 0.5) AS l2, quantile_cont(l, 0.75) AS l3 FROM p WHERE fit)
  SELECT id, round((abs(a - a2) / (a3 - a1) + abs(l - l2) / (l3 - l1)) / 2, 6) AS novelty FROM p, q"""


@query("m11_novelty_score", NOVELTY)
def _(b):
    rows = b.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"), F.log("o_totalprice").alias("l"), "o_orderdate")
    fitted = F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    return M.novelty_score(rows, fitted, ["a", "l"]).select("id", F.round("novelty", 6).alias("novelty"))


@query("m15_spark_areas")
def _(b):
    fit, later = frames(b)
    _, _, attempts = M.fit_candidates(fit, later, NUMERIC, CATEGORICAL, ["decision_tree"])
    return attempts_frame(b, attempts).select("candidate", "area_under_pr", "area_under_roc")


@query("m25_batch_scores")
def _(b):
    fit, later = frames(b)
    prep, fitted, _ = M.fit_candidates(fit, later, NUMERIC, CATEGORICAL, ["decision_tree"])
    scored = M.with_scores(fitted["decision_tree"], prep.transform(M.nan_for_null(later, NUMERIC)))
    return M.batch_scores(scored, 0.5, "tree-v1")
