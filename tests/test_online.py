"""The incremental naive Bayes: a batch is read without the other batches, predictions equal a plain formula."""
import glob
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlake.ml import online
from netlake.plans.stage import materialize
from netlake.queries_more import q_online_accuracy

from conftest import SF001


def test_each_batch_is_read_alone(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(online, "prequential", lambda model, batches: seen.extend(batches) or [])
    q_online_accuracy(spark, SF001)
    whole = set(seen[0].inputFiles())           # of the table, before filters
    scans = [b._jdf.queryExecution().executedPlan().toString() for b in seen]
    assert len(seen) == 8 and all("PartitionFilters: [isnotnull(_b" in s for s in scans)
    assert {f.rsplit("/", 2)[1] for f in whole} == {f"_b={i}" for i in range(8)}
    total = sum(b.count() for b in seen)
    assert total == spark.read.parquet(glob.escape(next(iter(whole)).rsplit("/", 2)[0])).count() > 0


def test_table_by_a_column_keeps_rows_and_schema(spark):
    df = spark.range(20).select("id", (F.col("id") % 3).alias("k"))
    for want in (df, df.limit(0)):
        got = materialize(want, "by", by="k")
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_predictions_equal_the_formula(spark):
    rng = np.random.default_rng(3)
    rows = [(int(y), *map(float, rng.normal(y, 1 + y, 3))) for y in rng.integers(0, 3, 400)]
    df = spark.createDataFrame(rows + [(1, None, 0.5, 2.0)], "label int, a double, b double, c double").repartition(4)
    m = online.OnlineNB(["a", "b", "c"]).update(df)
    classes, prior, means, var = m.params()
    for r in m.predict(df).collect():
        x = [r["a"] or 0.0, r["b"], r["c"]]
        ll = [prior[i] - sum((v - means[i][j]) ** 2 / (2 * var[i][j]) + 0.5 * math.log(2 * math.pi * var[i][j])
                             for j, v in enumerate(x)) for i in range(len(classes))]
        assert ll[classes.index(r["online_prediction"])] == pytest.approx(max(ll))
    assert m.predict(df.limit(0)).count() == 0
