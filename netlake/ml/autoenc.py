"""Reconstruction-error detector (M7, F13, A13) as a linear autoencoder.

MinMax scaling + PCA(k) fitted with pyspark.ml on benign rows; the error of a
row is the mean squared difference between its scaled features and their
projection back from k components.  The reference uses a small non-linear
network; the output contract (error, p95 threshold, score, zero-day flag) is
the same and the linear model is a declared divergence.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.stats import exact_percentile


@dataclass
class LinearAE:
    features: list[str]
    lo: np.ndarray
    hi: np.ndarray
    mean: np.ndarray
    comps: np.ndarray      # d x k
    threshold: float


def fit_autoencoder(df: DataFrame, features: list[str] | None = None, k: int = 32,
                    pct: float = config.AE_THRESHOLD_PCT) -> LinearAE:
    feats = features or config.FEATURE_NAMES
    va = VectorAssembler(inputCols=feats, outputCol="_v", handleInvalid="keep")
    v = va.transform(df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats]))
    mm = MinMaxScaler(inputCol="_v", outputCol="_s").fit(v)
    s = mm.transform(v)
    pca = PCA(k=min(k, len(feats)), inputCol="_s", outputCol="_p").fit(s)
    arr = vector_to_array("_s")
    mean = np.array(list(s.agg(*[F.avg(arr[i]).alias(f"m{i}") for i in range(len(feats))]).first()), dtype=float)
    model = LinearAE(feats, mm.originalMin.toArray(), mm.originalMax.toArray(), mean, pca.pc.toArray(), 0.0)
    errs = reconstruction_error(df, model)
    model.threshold = float(exact_percentile(errs, "ae_error", pct / 100.0) or 0.0)
    return model


def reconstruction_error(df: DataFrame, m: LinearAE, out: str = "ae_error") -> DataFrame:
    """Per-row MSE between min-max scaled features and their k-component reconstruction."""
    lo, span = m.lo, np.where(m.hi - m.lo == 0, 1.0, m.hi - m.lo)
    mean, comps = m.mean, m.comps
    const = (m.hi - m.lo) == 0

    @F.pandas_udf("double")
    def err(xs: pd.Series) -> pd.Series:
        if len(xs) == 0:
            return pd.Series([], dtype="float64")
        x = np.vstack(xs.to_numpy())
        z = np.where(const, 0.5, (x - lo) / span)      # the scaler maps constant columns to 0.5
        c = z - mean
        rec = c @ comps @ comps.T + mean
        return pd.Series(np.mean((z - rec) ** 2, axis=1))
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in m.features])
    return df.withColumn(out, err(vec))
