"""The bucketed keyed scan equals a plain per-key window for any bucket width."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from netlake.plans.scan import keyed_scan, sliding_count

from conftest import SF001


def _events(spark):
    e = spark.read.parquet(f"{SF001}/events.parquet")
    return e.select((F.col("user_id") % 7).alias("k"), F.expr("unix_micros(cast(ts as timestamp)) div 4000").alias("ts"),
                    F.col("event_id").alias("id"), F.col("value"))


def test_scan_matches_window(spark):
    e = _events(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = e.select("id", F.lag("ts").over(w).alias("lag_ts"),
                   F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
                   F.last(F.when(F.col("id") % 5 == 0, F.col("id")), True).over(
                       w.rowsBetween(Window.unboundedPreceding, -1)).alias("last5"))
    expect = {r["id"]: (r["lag_ts"], round(r["run"], 6), r["last5"]) for r in ref.collect()}
    for bucket in (1, 50_000, 10_000_000, 10 ** 15):
        got = keyed_scan(e, ["k"], "ts", "id", bucket, lags=[("lag_ts", F.col("ts"))],
                         sums=[("run", F.col("value"))],
                         lasts=[("last5", F.when(F.col("id") % 5 == 0, F.col("id")))]).collect()
        assert {r["id"]: (r["lag_ts"], round(r["run"], 6), r["last5"]) for r in got} == expect, bucket


def test_sliding_count_matches_range_window(spark):
    e = _events(spark)
    reach = 3_000_000
    w = Window.partitionBy("k").orderBy("ts", "id")
    older = Window.partitionBy("k").orderBy("ts").rangeBetween(Window.unboundedPreceding, -(reach + 1))
    ref = e.select("id", (F.row_number().over(w) - F.coalesce(F.count(F.lit(1)).over(older), F.lit(0))).alias("c"))
    expect = {r["id"]: r["c"] for r in ref.collect()}
    for bucket in (100_000, 10 ** 12):
        got = sliding_count(e, ["k"], "ts", "id", reach, bucket, out="c").collect()
        assert {r["id"]: r["c"] for r in got} == expect
