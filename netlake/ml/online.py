"""Incremental classifier (M9, T10): mergeable Gaussian naive Bayes.

State per class and feature is (n, sum x, sum x^2); a micro-batch adds one
``groupBy(label)`` aggregate (classes x features numbers), so updates are
distributed and the state is tiny.  Prediction is an Arrow UDF (argmax of
per-class Gaussian log-likelihoods over a k x d parameter matrix).  The reference's online learner is a
Hoeffding tree whose leaves use this same estimator; splits are not built.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from .boosting import _matrix


class OnlineNB:
    def __init__(self, features: list[str] | None = None, var_smoothing: float = 1e-9, ready_at: int = 100):
        self.features = features or config.FEATURE_NAMES
        self.eps = var_smoothing
        self.ready_at = ready_at
        self.stats: dict[int, dict] = {}     # class -> {"n": int, "s": [..], "q": [..]}

    @property
    def n_seen(self) -> int:
        return sum(v["n"] for v in self.stats.values())

    @property
    def ready(self) -> bool:
        return self.n_seen >= self.ready_at

    def update(self, batch: DataFrame, label: str = "label") -> "OnlineNB":
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(self.features):
            x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            aggs += [F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}")]
        for r in batch.groupBy(F.col(label).cast("int").alias("_y")).agg(*aggs).collect():   # <= classes rows
            st = self.stats.setdefault(int(r["_y"]), {"n": 0, "s": [0.0] * len(self.features),
                                                     "q": [0.0] * len(self.features)})
            st["n"] += int(r["n"])
            for i in range(len(self.features)):
                st["s"][i] += float(r[f"s{i}"] or 0.0)
                st["q"][i] += float(r[f"q{i}"] or 0.0)
        return self

    def params(self) -> tuple[list[int], "np.ndarray", "np.ndarray", "np.ndarray"]:
        """classes, log priors, means (k x d), variances (k x d) — a few hundred numbers."""
        classes = sorted(self.stats)
        total = self.n_seen
        means = np.array([[s / self.stats[y]["n"] for s in self.stats[y]["s"]] for y in classes])
        var = np.array([[max(q / self.stats[y]["n"] - m * m, 0.0) for q, m in zip(self.stats[y]["q"], means[i])]
                        for i, y in enumerate(classes)])
        var = var + self.eps * max(float(var.max()) if var.size else 0.0, 1.0)
        prior = np.log(np.array([self.stats[y]["n"] / total for y in classes]))
        return classes, prior, means, var

    def predict(self, df: DataFrame, out: str = "online_prediction") -> DataFrame:
        """Argmax of per-class Gaussian log-likelihoods, one Arrow batch at a time."""
        if not self.stats:
            return df.withColumn(out, F.lit(None).cast("int"))
        classes, prior, means, var = self.params()
        cls = np.array(classes)
        const = prior - 0.5 * np.log(2 * math.pi * var).sum(axis=1)
        width = len(self.features)

        @F.arrow_udf("int")
        def nb(xs: pa.Array) -> pa.Array:
            x = _matrix(xs, width)
            ll = np.stack([c - ((x - m) ** 2 / (2 * v)).sum(axis=1) for c, m, v in zip(const, means, var)], axis=1)
            return pa.array(cls[np.argmax(ll, axis=1)], pa.int32())
        vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features])
        return df.withColumn(out, nb(vec))


def prequential(model: OnlineNB, batches: list[DataFrame], label: str = "label") -> list[tuple[int, int, int]]:
    """T10 + A14: test-then-train over batches; returns (batch, correct, scored) once the model is ready."""
    out = []
    for i, b in enumerate(batches):
        if model.ready:
            r = model.predict(b).agg(F.count_if(F.col("online_prediction") == F.col(label).cast("int")).alias("c"),
                                     F.count(F.lit(1)).alias("n")).first()
            out.append((i, int(r["c"]), int(r["n"])))
        model.update(b, label)
    return out
