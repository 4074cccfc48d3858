"""Distributed exact order statistics.

Spark's exact ``percentile`` aggregate keeps every distinct value of the
column in one aggregation buffer, i.e. in one task.  ``exact_percentile``
instead narrows the value window with ``percentile_approx`` passes (each a
normal partial aggregation) until few distinct values are left around the wanted
rank, then ranks by the counts per value.  Ties cost nothing: a value that
holds any share of the rows is one counted row.  Result = numpy/DuckDB linear
interpolation (``quantile_cont``).
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import materialize


def exact_percentile(df: DataFrame, col: str, q: float, max_values: int = 10_000, accuracy: int = 10_000) -> float | None:
    """Exact ``q``-quantile (0..1, linear interpolation) of a numeric column; None if empty.

    Nulls and NaN are left out.  At most ``max_values`` (value, count) rows reach the driver.
    """
    x = materialize(df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x")), "rank")
    n = x.count()
    if n == 0:
        return None
    pos = q * (n - 1)
    k_lo, k_hi = math.floor(pos), math.ceil(pos)
    below, m, cand = 0, n, x
    while True:
        few = cand.groupBy("x").count().limit(max_values + 1).collect()
        if len(few) <= max_values:
            break
        r_lo = max((k_lo - below) / m - 3.0 / accuracy, 0.0)
        r_hi = min((k_hi - below) / m + 3.0 / accuracy, 1.0)
        a, b = cand.agg(F.percentile_approx("x", [r_lo, r_hi], accuracy)).first()[0]
        stats = cand.agg(F.count_if(F.col("x") < a).alias("lt"), F.count_if(F.col("x").between(a, b)).alias("mid")).first()
        nb = below + stats["lt"]
        if nb > k_lo or nb + stats["mid"] <= k_hi or stats["mid"] == m:  # missed, or no narrower: look closer
            accuracy *= 10
            continue
        below, m = nb, stats["mid"]
        cand = x.filter(F.col("x").between(F.lit(a), F.lit(b)))

    def at(rank: int) -> float:
        seen = below
        for value, count in sorted(few):
            seen += count
            if rank < seen:
                return value
        raise AssertionError("rank outside the window")

    v_lo, v_hi = at(k_lo), at(k_hi)
    return v_lo + (v_hi - v_lo) * (pos - k_lo)
