"""Ordered per-key scans that do not put a hot key into one task.

Flow assembly, per-IP running scores and sliding DNS rates all need, for
every row, something about the *preceding* rows of the same key in time
order: the previous row (``lag``), a running sum, or the last non-null value
of an expression.  A plain ``Window.partitionBy(key)`` sends every row of a
key to one task; one flooding 5-tuple or source address can hold a third of
the data.

``keyed_scan`` splits each key into time buckets (``ts div bucket_us``) and
runs the classic two-level parallel scan:

1. local window per ``(key, bucket)`` — bounded work per task;
2. one summary row per ``(key, bucket)`` (sum, last row, last non-null),
   computed on the already partitioned data, so no extra exchange;
3. a window over the summary (one row per bucket, small) gives each bucket
   its carry from all earlier buckets of the key;
4. the carry is joined back on ``(key, bucket)``; the big side keeps its
   partitioning, only the summary moves.

The result equals a single window over ``partitionBy(key).orderBy(ts, tie)``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_COL = "_scan_b"


def keyed_scan(df: DataFrame, keys: Sequence[str], ts: str, tie: str, bucket_us: int,
               lags: Sequence[tuple[str, Column]] = (),
               sums: Sequence[tuple[str, Column]] = (),
               lasts: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """Add scan columns to ``df``.

    ``lags``  — (name, expr): value of ``expr`` on the previous row of the key (null on the first).
    ``sums``  — (name, expr): running sum of ``expr`` up to and including the current row.
    ``lasts`` — (name, expr): last non-null value of ``expr`` strictly before the current row.

    Rows are ordered by ``(ts, tie)``; ``tie`` must be unique within a key and
    key columns must be non-null.
    ``bucket_us`` bounds the rows one task sorts for a key; any positive
    width gives the same answer.
    """
    keys = list(keys)
    if BUCKET_COL not in df.columns:
        df = df.withColumn(BUCKET_COL, F.floor(F.col(ts) / F.lit(bucket_us)).cast("long"))
    order = F.struct(F.col(ts), F.col(tie))

    lag_src = [f"_lg_src{i}" for i in range(len(lags))]
    sum_src = [f"_sm_src{i}" for i in range(len(sums))]
    last_src = [f"_ls_src{i}" for i in range(len(lasts))]
    # The input is read twice: by the row window (one hash exchange on
    # (key, bucket)) and by the bucket summary (partial aggregation before its
    # small exchange, only the columns it needs).  Callers cut the lineage in
    # front of a scan whose input is expensive (plans.stage.materialize).
    d = df.select("*", *[e.alias(n) for n, (_, e) in zip(lag_src, lags)],
                  *[e.alias(n) for n, (_, e) in zip(sum_src, sums)],
                  *[e.alias(n) for n, (_, e) in zip(last_src, lasts)])

    w = Window.partitionBy(*keys, BUCKET_COL).orderBy(F.col(ts), F.col(tie))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = [F.row_number().over(w).alias("_scan_rn")]
    if lags:
        local.append(F.lag(F.struct(*[F.col(c) for c in lag_src])).over(w).alias("_scan_llag"))
    local += [F.sum(F.col(c)).over(run).alias(f"_scan_lsum{i}") for i, c in enumerate(sum_src)]
    local += [F.last(F.col(c), ignorenulls=True).over(before).alias(f"_scan_llast{i}")
              for i, c in enumerate(last_src)]
    rows = d.select("*", *local)

    # one row per (key, bucket)
    aggs = [F.count(F.lit(1)).alias("_b_n")]
    if lags:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in lag_src]), order).alias("_b_lastrow"))
    aggs += [F.sum(F.col(c)).alias(f"_b_sum{i}") for i, c in enumerate(sum_src)]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"_b_last{i}")
             for i, c in enumerate(last_src)]
    summ = d.groupBy(*keys, BUCKET_COL).agg(*aggs)

    ws = Window.partitionBy(*keys).orderBy(BUCKET_COL)
    prev_b = ws.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.col(k).alias(f"_ck_{k}") for k in keys] + [F.col(BUCKET_COL).alias("_ck_b")]
    if lags:
        carry.append(F.lag("_b_lastrow").over(ws).alias("_c_lag"))
    carry += [F.coalesce(F.sum(f"_b_sum{i}").over(prev_b), F.lit(0)).alias(f"_c_sum{i}")
              for i in range(len(sums))]
    carry += [F.last(f"_b_last{i}", ignorenulls=True).over(prev_b).alias(f"_c_last{i}")
              for i in range(len(lasts))]
    carry_df = summ.select(*carry)

    # plain equality keeps the (key, bucket) partitioning of the row side: only the
    # carry table moves.  Keys must be non-null.
    cond = [F.col(k) == F.col(f"_ck_{k}") for k in keys] + [F.col(BUCKET_COL) == F.col("_ck_b")]
    j = rows.join(carry_df, on=cond, how="left")

    out = []
    if lags:
        prev = F.when(F.col("_scan_rn") == 1, F.col("_c_lag")).otherwise(F.col("_scan_llag"))
        for i, (name, _) in enumerate(lags):
            out.append(prev.getField(lag_src[i]).alias(name))
    for i, (name, _) in enumerate(sums):
        out.append((F.col(f"_c_sum{i}") + F.col(f"_scan_lsum{i}")).alias(name))
    for i, (name, _) in enumerate(lasts):
        out.append(F.coalesce(F.col(f"_scan_llast{i}"), F.col(f"_c_last{i}")).alias(name))
    return j.select(*[F.col(c) for c in df.columns], *out)


def sliding_count(df: DataFrame, keys: Sequence[str], ts: str, tie: str, reach_us: int, bucket_us: int,
                  out: str = "recent", extra_sums: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """Per row: how many rows of the same key, up to and including this one in
    ``(ts, tie)`` order, have ``ts >= this.ts - reach_us``.

    Computed as ``rank - #rows with ts < this.ts - reach_us``.  The second
    term counts "shadow" copies of the rows shifted by ``reach_us + 1``: a
    shadow sorts before real rows of equal time, so its running count at a
    real row is exactly the number of rows that fell out of the window.  Real
    rows and shadows go through one ``keyed_scan`` (one exchange); nothing is
    held per key beyond one bucket.  ``extra_sums`` are running sums over the
    real rows only.  ``tie`` must be a non-negative integer column.
    """
    if BUCKET_COL in df.columns:
        df = df.drop(BUCKET_COL)
    # each row and its shadow come out of one explode: the input is read once
    both = df.select("*", F.explode(F.array(
        F.struct(F.col(ts).alias("_sc_ts"), F.col(tie).alias("_sc_tie"), F.lit(1).alias("_sc_real")),
        F.struct((F.col(ts) + F.lit(reach_us + 1)).alias("_sc_ts"), (F.lit(-1) - F.col(tie)).alias("_sc_tie"),
                 F.lit(0).alias("_sc_real")))).alias("_sc"))
    both = both.select(*[F.col(c) for c in df.columns if c not in (ts, tie)],
                       F.col("_sc._sc_ts").alias(ts), F.col("_sc._sc_tie").alias(tie), F.col("_sc._sc_real").alias("_sc_real"))
    sums = [("_sc_rank", F.col("_sc_real")), ("_sc_gone", F.lit(1) - F.col("_sc_real"))]
    sums += [(n, F.when(F.col("_sc_real") == 1, e).otherwise(F.lit(0))) for n, e in extra_sums]
    s = keyed_scan(both, keys, ts, tie, bucket_us, sums=sums)
    return (s.filter(F.col("_sc_real") == 1)
            .select(*[F.col(c) for c in df.columns], *[F.col(n) for n, _ in extra_sums],
                    (F.col("_sc_rank") - F.col("_sc_gone")).alias(out)))
