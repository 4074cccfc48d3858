"""Evaluation metrics as aggregations (A11, A12, A14, A13 via functions.stats)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import keyed_scan


def _safe(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A11 per class: precision, recall, F1, support (zero division -> 0).

    One ``groupBy(label, prediction)`` (at most classes^2 rows) feeds every number.
    """
    cm = pred.groupBy(F.col(label).cast("int").alias("t"), F.col(prediction).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    # each cell counts for its true and for its predicted class
    side = F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(True).alias("own")), F.struct(F.col("p").alias("c"), F.lit(False).alias("own"))))
    per = cm.select("t", "p", "n", side.alias("x")).where("x.c is not null").groupBy(F.col("x.c").alias("c")).agg(
        F.coalesce(F.sum(F.when(F.col("x.own") & F.col("t").eqNullSafe(F.col("p")), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(~F.col("x.own") & ~F.col("t").eqNullSafe(F.col("p")), F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("x.own") & ~F.col("t").eqNullSafe(F.col("p")), F.col("n"))), F.lit(0)).alias("fn"))
    p = _safe(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _safe(F.col("tp"), F.col("tp") + F.col("fn"))
    out = per.select(F.col("c").alias("class"), p.alias("precision"), r.alias("recall"),
                     (F.col("tp") + F.col("fn")).cast("long").alias("support"))
    return out.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"),
                                      F.col("precision") + F.col("recall")))


def classification_summary(report: DataFrame, pred: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """A11 summary: accuracy, weighted F1, macro F1 (one row)."""
    acc = pred.agg(F.avg(F.when(F.col(label).cast("int") == F.col(prediction).cast("int"), 1.0).otherwise(0.0))
                   .alias("accuracy"))
    f = report.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
                   F.avg("f1").alias("f1_macro"))
    return acc.crossJoin(F.broadcast(f))        # both one row


def detector_rates(pred: DataFrame, flag: str = "flagged", label: str = "label", normal_label: int = 0) -> DataFrame:
    """Share of attacks flagged (detection rate) and of normal rows flagged (FPR); 0 when empty."""
    is_att = F.col(label) != normal_label
    f = F.col(flag).cast("double")
    return pred.agg(F.coalesce(F.avg(F.when(is_att, f)), F.lit(0.0)).alias("detection_rate"),
                    F.coalesce(F.avg(F.when(~is_att, f)), F.lit(0.0)).alias("false_positive_rate"))


def running_accuracy(pred: DataFrame, ts: str, tie: str, label: str = "label", prediction: str = "prediction",
                     bucket: int = 1 << 20) -> DataFrame:
    """Cumulative accuracy after each prediction in ``(ts, tie)`` order.

    A global running sum, computed as a bucketed scan (one constant key split
    over ``ts`` buckets), never a single-partition window.
    """
    d = pred.withColumn("_all", F.lit(0)).withColumn(
        "_correct", (F.col(label).cast("int") == F.col(prediction).cast("int")).cast("int"))
    s = keyed_scan(d, ["_all"], ts, tie, bucket, sums=[("_n_correct", F.col("_correct")), ("_n_seen", F.lit(1))])
    return s.withColumn("running_accuracy", F.col("_n_correct") / F.col("_n_seen")).drop("_all", "_correct",
                                                                                         "_scan_b")
