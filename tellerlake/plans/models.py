"""Preparation, training and scoring with spark.ml; nothing row-level reaches the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.operators.ordering import column_percentiles
from tellerlake.operators.running import attach_one_row
from tellerlake.session import cut_lineage

# Fixed protocol values.
SEED = 42
NEGATIVE_FRACTION = 0.1
MIN_PRIOR_AMOUNTS = 5


def impute_medians(df: DataFrame, fitted_on: Column, columns: Sequence[str]) -> DataFrame:
    """Exact medians of the fit rows replace missing values everywhere; `<c>_missing` flags keep the fact."""
    out = attach_one_row(df, column_percentiles(df.where(fitted_on), columns, {"_m": 0.5}))
    for c in columns:
        out = out.withColumn(f"{c}_missing", F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).withColumn(c, F.coalesce(F.col(c), F.col(f"{c}__m"))).drop(f"{c}__m")
    return out


def support_flags(df: DataFrame) -> DataFrame:
    """Whether enough prior amounts and any prior position stand behind the history columns."""
    enough = F.coalesce((F.col("customer_same_currency_tx_count_30d") >= MIN_PRIOR_AMOUNTS).cast("double"), F.lit(0.0))
    located = F.coalesce((F.col("customer_prior_geo_count_30d") > 0).cast("double"), F.lit(0.0))
    return df.withColumn("has_prior_amount_support", enough).withColumn("has_observed_prior_geo", located)


def class_weights(df: DataFrame, label: str = "label", balanced: bool = True) -> DataFrame:
    """`n / (2 * class size)` per class, or 1."""
    if not balanced:
        return df.withColumn("class_weight", F.lit(1.0))
    totals = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p"))
    weight = F.when(F.col(label) == 1, F.col("_n") / (2.0 * F.col("_p"))).otherwise(F.col("_n") / (2.0 * (F.col("_n") - F.col("_p"))))
    return attach_one_row(df, totals).withColumn("class_weight", weight).drop("_n", "_p")


def sample_negatives(df: DataFrame, row_id: str, label: str = "label", fraction: float = NEGATIVE_FRACTION, seed: int = SEED) -> DataFrame:
    """All positives and a repeatable hash sample of negatives, weighted by inverse inclusion."""
    kept = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    return df.where((F.col(label) == 1) | kept).withColumn("sample_weight", F.when(F.col(label) == 1, 1.0).otherwise(1.0 / fraction))


def preparation(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """Median imputation, category indexes with unseen values kept, one-hot columns, one vector."""
    filled, indexed, encoded = ([f"{c}_{s}" for c in names] for names, s in ((numeric, "filled"), (categorical, "index"), (categorical, "onehot")))
    stages = [Imputer(inputCols=list(numeric), outputCols=filled, strategy="median"),
              StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep", stringOrderType="frequencyDesc"),
              OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep", dropLast=False),
              VectorAssembler(inputCols=[*filled, *encoded], outputCol="features", handleInvalid="error")]
    return Pipeline(stages=stages)


def nan_for_null(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) if c in numeric else F.col(c) for c in df.columns])


def candidates(weight: str = "class_weight", validation: str | None = None) -> dict[str, object]:
    """The estimators that are compared; boosting stops early on the validation rows when they are marked."""
    boosted = GBTClassifier(labelCol="label", weightCol=weight, maxIter=15, maxDepth=4, stepSize=0.1, seed=SEED, subsamplingRate=0.8)
    if validation:
        boosted = boosted.setValidationIndicatorCol(validation)
    return {
        "logistic_regression": LogisticRegression(labelCol="label", weightCol=weight, maxIter=30, regParam=0.01, standardization=True),
        "decision_tree": DecisionTreeClassifier(labelCol="label", weightCol=weight, maxDepth=5, minInstancesPerNode=20, seed=SEED),
        "random_forest": RandomForestClassifier(labelCol="label", weightCol=weight, numTrees=20, maxDepth=6, seed=SEED),
        "boosted_trees": boosted,
    }


def balanced_forest(train: DataFrame, ratio: float = 0.2, trees: int = 20, seed: int = SEED):
    """Random forest on all positives and as many hashed negatives as make positives / negatives = `ratio`."""
    totals = train.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("label").cast("bigint")).alias("_p"))
    share = F.col("_p") / F.lit(ratio) / F.greatest(F.col("_n") - F.col("_p"), F.lit(1))
    drawn = F.pmod(F.xxhash64(F.col("transaction_id"), F.lit(seed)), F.lit(1_000_000)) / 1e6
    # The forest makes a pass for each level: the rows it draws are written once, reduced to what it reads.
    balanced = cut_lineage(attach_one_row(train, totals).where((F.col("label") == 1) | (drawn < share)).select("label", "features"))
    return RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=8, minInstancesPerNode=5, seed=seed).fit(balanced)


def novelty_score(df: DataFrame, fitted_on: Column, columns: Sequence[str]) -> DataFrame:
    """Mean distance from the fit median in units of the interquartile range; missing values count as typical."""
    scored = attach_one_row(df, column_percentiles(df.where(fitted_on), columns, {"_a": 0.25, "_b": 0.5, "_c": 0.75}))
    total = F.lit(0.0)
    for c in columns:
        spread = F.col(f"{c}__c") - F.col(f"{c}__a")
        total = total + F.coalesce(F.when(spread > 0, F.abs(F.col(c) - F.col(f"{c}__b")) / spread), F.lit(0.0))
    return scored.withColumn("novelty", total / len(columns)).select(*df.columns, "novelty")


def with_scores(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def area(df: DataFrame, metric: str) -> float:
    """spark.ml's areaUnderPR or areaUnderROC (a stepwise area, not the tie-aware average precision)."""
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName=metric).evaluate(df)


def batch_scores(scored: DataFrame, threshold: float, version: str) -> DataFrame:
    """Published scores: review flag, model version, and no automatic decision; a missing score stays missing."""
    return scored.select(
        "transaction_id", "score", F.when(F.col("score").isNotNull(), F.col("score") >= threshold).alias("fraud_prediction"),
        F.lit(version).alias("model_version"), F.lit(True).alias("review_required"), F.lit(False).alias("automatic_decisions_enabled"),
        F.when(F.col("score").isNotNull(), "experimental_prediction").otherwise("unavailable").alias("score_status"))


def fit_candidates(train: DataFrame, selection: DataFrame, numeric: Sequence[str], categorical: Sequence[str], names: Sequence[str]) -> tuple[PipelineModel, dict, list[dict]]:
    """Fit preparation on `train` only, then every named candidate; a non-converged regression is left out."""
    prep = preparation(numeric, categorical).fit(nan_for_null(train, numeric))
    # Every candidate makes many passes: both frames are written once, reduced to what the estimators read.
    columns = ["transaction_id", "label", "features"]
    ready = cut_lineage(class_weights(prep.transform(nan_for_null(train, numeric))).select(*columns, "class_weight"))
    later = cut_lineage(prep.transform(nan_for_null(selection, numeric)).select(*columns))
    models, attempts = {}, []
    for name, estimator in candidates().items():
        if name not in names:
            continue
        model = estimator.fit(ready)
        if name == "logistic_regression" and model.summary.totalIterations >= estimator.getMaxIter():
            attempts.append({"candidate": name, "status": "not converged", "area_under_pr": None, "area_under_roc": None})
            continue
        models[name] = model
        out = model.transform(later)
        attempts.append({"candidate": name, "status": "ok", "area_under_pr": area(out, "areaUnderPR"), "area_under_roc": area(out, "areaUnderROC")})
    return prep, models, attempts
