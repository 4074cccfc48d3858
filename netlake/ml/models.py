"""Training job and model persistence."""
from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.stats import exact_percentile
from ..operators import dataset as ds
from ..plans.stage import materialize
from ..session import checkpoint_dir
from . import autoenc, iforest, trees
from .boosting import BoostModel, BoostParams
from .forest import ForestModel
from .metrics import classification_report, classification_summary, detector_rates


@dataclass
class Models:
    classifier: PipelineModel | ForestModel | BoostModel
    moments: list[tuple[str, float, float]]
    forest_nodes: DataFrame
    psi: int
    iso_cut: float
    ae: autoenc.LinearAE | None
    metadata: dict = field(default_factory=dict)


def train(df: DataFrame, test_fraction: float = 0.2, trees_n: int = 500, depth: int = 20, iso_trees: int = 300,
          iso_samples: int = 80_000, ae_k: int = 32, train_ae: bool = True, seed: int = 42,
          boost: BoostParams | None = None, cv_folds: int = 0, cv_trees: int = 200, cv_depth: int = 8,
          ) -> tuple[Models, DataFrame]:
    """Cleaned labelled flows -> models + the scored held-out split.

    ``boost`` trains the boosted classifier instead of the forest.  With
    ``cv_folds`` the metadata's CV means come from that many folds of the
    whole table; without, they are the held-out figures.
    """
    t0 = time.time()
    sp = ds.stratified_split(df, test_fraction, seed)
    tr_raw, te_raw = sp.filter(~F.col("is_test")), sp.filter(F.col("is_test"))
    moments = [(r["feature"], float(r["mean"]), float(r["std"])) for r in ds.scaler_moments(tr_raw).collect()]
    tr, te = ds.standardize(tr_raw, moments), ds.standardize(te_raw, moments)
    clf = (trees.train_boosted_classifier(tr, params=boost) if boost
           else trees.train_classifier(tr, trees=trees_n, depth=depth, seed=seed))
    pred = trees.predict(clf, te)
    told = materialize(pred.select("label", "prediction"), "model-predictions")       # read twice
    summ = classification_summary(classification_report(told), told).first()
    benign = tr.filter(F.col("label") == 0)
    nodes, psi = iforest.fit_iforest(benign, config.FEATURE_NAMES, iso_trees, iso_samples, seed)
    train_scores = iforest.score_iforest(df.sparkSession, benign, nodes, psi, config.FEATURE_NAMES)
    cut = float(exact_percentile(train_scores, "iso_score", config.ANOMALY_CONTAMINATION) or 0.0)
    scored = iforest.score_iforest(df.sparkSession, pred, nodes, psi, config.FEATURE_NAMES)
    scored = scored.withColumn("iso_flag", F.when(F.col("iso_score") < cut, -1).otherwise(1))
    rates = detector_rates(scored.withColumn("flagged", F.col("iso_flag") == -1)).first()
    ae = autoenc.fit_autoencoder(tr_raw.filter(F.col("label") == 0), k=ae_k) if train_ae else None
    cv_accuracy, cv_f1 = float(summ["accuracy"]), float(summ["f1_weighted"])
    if cv_folds:
        cv = trees.cross_validate(ds.stratified_folds(sp, cv_folds), k=cv_folds, trees=cv_trees, depth=cv_depth,
                                  seed=seed).first()
        cv_accuracy, cv_f1 = float(cv["accuracy_mean"]), float(cv["f1_weighted_mean"])
    meta = {
        "trained_at": time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime()),
        "n_samples": int(sp.count()), "n_features": len(config.FEATURE_NAMES),
        "n_classes": int(sp.select("label").distinct().count()), "model_type": "Boosted" if boost else "RandomForest",
        "test_accuracy": float(summ["accuracy"]), "test_f1_weighted": float(summ["f1_weighted"]),
        "test_f1_macro": float(summ["f1_macro"]), "iso_detection_rate": float(rates["detection_rate"]),
        "iso_false_positive_rate": float(rates["false_positive_rate"]), "iso_cut": cut,
        "cv_accuracy_mean": cv_accuracy, "cv_f1_mean": cv_f1, "autoencoder_trained": ae is not None,
        "attack_labels": json.dumps(config.ATTACK_LABELS, sort_keys=True),
        "ae_threshold": ae.threshold if ae else float("nan"), "train_seconds": round(time.time() - t0, 1),
    }
    return Models(clf, moments, nodes, psi, cut, ae, meta), scored


def metadata_frame(spark: SparkSession, meta: dict) -> DataFrame:
    """The metadata record as a one-row DataFrame."""
    return spark.createDataFrame([tuple(meta.values())], list(meta.keys()))


def save(models: Models, path: str | None = None, spark: SparkSession | None = None) -> str:
    """Classifier pipeline, forest node table, scaler moments, AE and metadata under one folder."""
    spark = spark or models.forest_nodes.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/netlake/models-{uuid.uuid4().hex}"
    boosted, forest = isinstance(models.classifier, BoostModel), isinstance(models.classifier, ForestModel)
    if boosted or forest:
        models.classifier.save(spark, f"{path}/classifier")
    else:
        models.classifier.write().overwrite().save(f"{path}/classifier")
    models.forest_nodes.write.mode("overwrite").parquet(f"{path}/forest")
    extra = {"boosted": boosted, "forest": forest, "moments": models.moments, "psi": models.psi, "iso_cut": models.iso_cut, "metadata": models.metadata,
             "ae": None if models.ae is None else {
                 "features": models.ae.features, "lo": models.ae.lo.tolist(), "hi": models.ae.hi.tolist(),
                 "mean": models.ae.mean.tolist(), "comps": models.ae.comps.tolist(),
                 "threshold": models.ae.threshold}}
    spark.createDataFrame([(json.dumps(extra),)], "doc string").coalesce(1).write.mode("overwrite").text(
        f"{path}/meta")
    return path


def load(spark: SparkSession, path: str) -> Models:
    extra = json.loads(spark.read.text(f"{path}/meta").first()[0])
    a = extra["ae"]
    ae = None if a is None else autoenc.LinearAE(a["features"], np.array(a["lo"]), np.array(a["hi"]),
                                                 np.array(a["mean"]), np.array(a["comps"]), a["threshold"])
    clf = (BoostModel.load(spark, f"{path}/classifier") if extra["boosted"]
           else ForestModel.load(spark, f"{path}/classifier") if extra.get("forest")
           else PipelineModel.load(f"{path}/classifier"))
    return Models(clf, [tuple(m) for m in extra["moments"]],
                  spark.read.parquet(f"{path}/forest"), extra["psi"], extra["iso_cut"], ae, extra["metadata"])


def score_flows(models: Models, flows: DataFrame) -> DataFrame:
    """M8: flows -> probability, iso_score, ae_error (+ ae_score / is_zero_day) columns."""
    x = flows.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_raw_{c}")
                            for c in config.FEATURE_NAMES])
    z = ds.standardize(x, models.moments)
    p = trees.predict(models.classifier, z)
    p = iforest.score_iforest(flows.sparkSession, p, models.forest_nodes, models.psi, config.FEATURE_NAMES)
    # restore unscaled features for the reconstruction detector and the output
    p = p.select(*[F.col(f"_raw_{c}").alias(c) for c in config.FEATURE_NAMES],
                 *[c for c in p.columns if c not in config.FEATURE_NAMES and not c.startswith("_raw_")])
    if models.ae is not None:
        p = autoenc.reconstruction_error(p, models.ae)
    return p
