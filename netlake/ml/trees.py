"""Weighted multiclass tree classifier, cross-validation, importances."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators.dataset import class_weights, fold_stats, moments_without, standardize
from .boosting import BoostModel, BoostParams, train_boosted
from .forest import ForestModel, train_forest
from .metrics import classification_report, classification_summary


BINS = 64


def assembler(features: list[str] | None = None) -> VectorAssembler:
    """M1: fixed 77-name order; callers coalesce missing values to 0.0 first."""
    return VectorAssembler(inputCols=features or config.FEATURE_NAMES, outputCol="features", handleInvalid="keep")


def with_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """A10 weights joined on the class (one row per class: broadcast-sized by construction)."""
    w = class_weights(train)
    return train.join(F.broadcast(w), label).withColumn(label, F.col(label).cast("double"))


def train_classifier(train: DataFrame, features: list[str] | None = None, trees: int = 500, depth: int = 20,
                     seed: int = 42, label: str = "label", seen: list[tuple] | None = None) -> ForestModel:
    """M4: random forest with balanced class weights applied once; ``seen`` is what is known of the features' values (``forest.cut_points``)."""
    feats = features or config.FEATURE_NAMES
    return train_forest(assembler(feats).transform(with_weights(train, label)), feats, trees, min(depth, 30), BINS, seed, label, seen=seen)


def train_boosted_classifier(train: DataFrame, features: list[str] | None = None,
                             params: BoostParams = BoostParams(), label: str = "label") -> BoostModel:
    """M4, boosted branch: 500 rounds of depth 10 by default, with balanced class weights."""
    return train_boosted(with_weights(train, label), features, params, label)


def predict(model: PipelineModel | ForestModel | BoostModel, df: DataFrame) -> DataFrame:
    """M8 tree part: ``prediction`` and ``probability`` as ``array<double>``."""
    if isinstance(model, (ForestModel, BoostModel)):
        return model.transform(df)
    out = model.transform(df)
    return out.withColumn("probability", vector_to_array("probability")).drop("features", "rawPrediction")


def feature_importance(model: PipelineModel | ForestModel | BoostModel, features: list[str] | None = None, top: int = 20) -> DataFrame:
    """Top-``top`` importances with the bar length relative to the largest."""
    feats = features or config.FEATURE_NAMES
    imp = (model.importances() if isinstance(model, (ForestModel, BoostModel))
           else model.stages[-1].featureImportances.toArray()).tolist()
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(feats, imp)], "feature string, importance double")
    top_df = df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top)
    mx = df.agg(F.max("importance").alias("_mx"))
    return top_df.crossJoin(F.broadcast(mx)).select(
        "feature", "importance",
        F.when(F.col("_mx") > 0, F.col("importance") / F.col("_mx")).otherwise(F.lit(0.0)).alias("relative"))


AT_ONCE = 3         # folds trained side by side: each has a written table of its rows


def cross_validate(df: DataFrame, folds_col: str = "fold", k: int = 5, trees: int = 200, depth: int = 8,
                   seed: int = 42, label: str = "label") -> DataFrame:
    """M5: k-fold CV (fold = rank within label mod k); accuracy and weighted F1 per fold.

    Scaler moments and class weights are fitted inside each training fold, on
    unscaled rows; the mean and population deviation over the folds stand
    beside each fold's figures.  What a training fold needs to know of its columns comes from
    one pass over all folds, and folds are trained side by side.
    """
    from ..plans.stage import materialize
    df = materialize(df, "cv-folds")        # k trainings read one written table
    stats = fold_stats(df.filter(F.col(label).isNotNull()), folds_col, config.FEATURE_NAMES, BINS)

    def one(f: int) -> tuple:
        tr = df.filter(F.col(folds_col) != f)
        te = df.filter(F.col(folds_col) == f)
        moments, seen = moments_without(stats, f, config.FEATURE_NAMES, BINS)
        m = train_classifier(standardize(tr, moments), trees=trees, depth=depth, seed=seed, label=label, seen=seen)
        p = materialize(predict(m, standardize(te, moments)).select(label, "prediction"), "cv-predictions")     # read twice
        summ = classification_summary(classification_report(p, label), p, label).first()
        return f, float(summ["accuracy"]), float(summ["f1_weighted"])

    with ThreadPoolExecutor(AT_ONCE) as pool:
        rows = list(pool.map(inheritable_thread_target(one), range(k)))
    folds = df.sparkSession.createDataFrame(rows, "fold int, accuracy double, f1_weighted double")
    over = folds.agg(*[f(c).alias(f"{c}_{n}") for c in ("accuracy", "f1_weighted")
                       for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return folds.crossJoin(F.broadcast(over))           # one row
