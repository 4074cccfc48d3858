"""Connected components of a link table by alternating large-star and small-star steps.

Each step groups by one endpoint and takes a minimum (pre-aggregated before
the shuffle), then joins the minimum back; a hub with a third of all links is a
skewed join that adaptive execution splits.  No component is ever gathered.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import materialize, release


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` long -> ``(node, component)`` with the smallest node reachable; nodes without links are absent.

    Nulls and self links are ignored, repeated links count once, an empty table gives an empty result.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e, "cc")
    seen = None
    while True:
        before = e
        # large star: neighbours above u go to u's minimum
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        m = e.groupBy("u").agg(F.min("v").alias("m"))
        s = e.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(s.union(m.select("u", F.col("m").alias("v"))).distinct(), "cc")
        release(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
