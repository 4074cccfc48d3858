"""Keyed streaming state for the sequential operators (T4, T5, T6) and the
native windowed aggregations (T3, T7, T8).

State per key is O(1) (T4, T5) or bounded by the reference's own buffers
(T6: the last 500 event times, the set of ports seen).
"""
from __future__ import annotations

import json
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import config
from ..functions.columns import round_bin
from ..operators.behavior import REJECT_IPS, SEVERE

ONE = T.StructType([T.StructField("s", T.StringType())])


def _ordered(pdfs, *by: str) -> dict:
    """A group's rows as arrays sorted by the columns ``by``: most groups are a few rows, for which frames cost more than the work."""
    parts = list(pdfs)
    cols = {c: np.concatenate([p[c].to_numpy() for p in parts]) if len(parts) > 1 else parts[0][c].to_numpy() for c in parts[0].columns}
    order = np.lexsort([cols[c] for c in reversed(by)])
    return {c: v[order] for c, v in cols.items()}


def _with_time(df: DataFrame, watermark: str) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", watermark)


# ---------------------------------------------------------------- T4
def stream_throttle(alerts: DataFrame, by: str = "label", gap_s: float = config.ALERT_COOLDOWN_S,
                    tie: str = "alert_id", watermark: str = "10 minutes") -> DataFrame:
    """T4: per-key last *emitted* time in state; emits the alerts that pass the cooldown."""
    gap_us = int(round(gap_s * 1e6))
    schema = T.StructType([f for f in alerts.schema.fields])

    def step(key, pdfs, state):
        last = json.loads(state.get[0]) if state.exists else None
        pdf = pd.concat(list(pdfs)).sort_values(["ts_us", tie])
        keep = []
        for i, ts in enumerate(pdf["ts_us"].to_numpy()):
            if last is None or int(ts) - last >= gap_us:
                keep.append(i)
                last = int(ts)
        state.update((json.dumps(last),))
        if keep:
            yield pdf.iloc[keep][[f.name for f in schema.fields]]
    return _with_time(alerts, watermark).groupBy(by).applyInPandasWithState(
        step, schema, ONE, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- T5
def stream_strikes(attacks: DataFrame, threshold: int = config.BLOCK_THRESHOLD,
                   duration_s: float = config.BLOCK_DURATION_S, whitelist: list[str] | None = None,
                   ip: str = "src_ip", tie: str = "event_id", watermark: str = "10 minutes") -> DataFrame:
    """T5: strikes / blocks per source with (pending strikes, blocked until) in state.

    The block expires exactly at +duration (event time); an event-time timeout
    at that moment clears the state so idle sources do not stay in the store.
    """
    dur_us = int(round(duration_s * 1e6))
    wl = config.DEFAULT_WHITELIST if whitelist is None else whitelist
    a = attacks.filter(~F.col(ip).isin(*wl)) if wl else attacks
    schema = T.StructType(list(a.schema.fields) + [T.StructField("status", T.StringType()),
                                                   T.StructField("strike_no", T.LongType())])

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        pending, until = json.loads(state.get[0]) if state.exists else (0, None)
        cols = _ordered(pdfs, "ts_us", tie)
        status, nos = [], []
        for ts in cols["ts_us"].tolist():
            if until is not None and ts < until:
                status.append("ignored")
                nos.append(0)
                continue
            if until is not None:
                pending, until = 0, None
            pending += 1
            nos.append(pending)
            if pending >= threshold:
                status.append("blocked")
                until = ts + dur_us
            else:
                status.append("strike")
        if until is not None and until // 1000 + 1 <= state.getCurrentWatermarkMs():
            pending, until = 0, None             # the block already ended behind the watermark
        if until is None and pending == 0:
            state.remove()
        else:
            state.update((json.dumps([pending, until]),))
        if until is not None:
            state.setTimeoutTimestamp(until // 1000 + 1)
        cols |= {"status": status, "strike_no": nos}
        yield pd.DataFrame({f.name: cols[f.name] for f in schema.fields})
    return _with_time(a, watermark).groupBy(ip).applyInPandasWithState(
        step, schema, ONE, "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- T6
def stream_profiles(events: DataFrame, id_col: str = "flow_id", window_s: int = config.BEHAVIOR_WINDOW_S,
                    recent_cap: int = config.BEHAVIOR_RECENT_CAP, stale_s: int = config.BEHAVIOR_STALE_S,
                    watermark: str = "10 minutes") -> DataFrame:
    """Running profile score per event; a profile idle for ``stale_s`` is evicted by timeout."""
    w_us, stale_us = int(window_s * 1e6), int(stale_s * 1e6)
    ev = events.filter(F.col("src_ip").isNotNull() & ~F.col("src_ip").isin(*REJECT_IPS))
    out_schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("src_ip", T.StringType()),
                               T.StructField("ts_us", T.LongType()), T.StructField("attack_count", T.LongType()),
                               T.StructField("normal_count", T.LongType()), T.StructField("severe_count", T.LongType()),
                               T.StructField("ports_count", T.LongType()), T.StructField("recent_events", T.LongType())])

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        st = json.loads(state.get[0]) if state.exists else {"a": 0, "n": 0, "s": 0, "ports": [], "recent": []}
        ports, recent = set(st["ports"]), deque(st["recent"], maxlen=recent_cap)
        cols = _ordered(pdfs, "ts_us", id_col)
        rows = []
        for row_id, ts, lab, port in zip(*(cols[c].tolist() for c in (id_col, "ts_us", "label", "dst_port"))):
            if recent and ts - recent[-1] > stale_us:    # an idle profile starts anew, however the rows were batched
                st, ports = {"a": 0, "n": 0, "s": 0}, set()
                recent.clear()
            st["n" if lab == "Normal" else "a"] += 1
            st["s"] += int(lab in SEVERE)
            if port is not None and not pd.isna(port) and int(port) != 0:
                ports.add(int(port))
            recent.append(ts)
            rec = sum(1 for t in recent if t > ts - w_us)
            rows.append((row_id, key[0], ts, st["a"], st["n"], st["s"], len(ports), rec))
        st["ports"], st["recent"] = sorted(ports), list(recent)
        expiry = max(recent) // 1000 + stale_us // 1000 + 1
        if expiry <= state.getCurrentWatermarkMs():
            state.remove()                       # already stale behind the watermark
        else:
            state.update((json.dumps(st),))
            state.setTimeoutTimestamp(expiry)
        yield pd.DataFrame(rows, columns=[f.name for f in out_schema.fields])
    out = _with_time(ev, watermark).groupBy("src_ip").applyInPandasWithState(
        step, out_schema, ONE, "append", GroupStateTimeout.EventTimeTimeout)
    from ..operators.behavior import risk_level, threat_score
    s = threat_score(F.col("attack_count"), F.col("normal_count"), F.col("ports_count"), F.col("recent_events"),
                     F.col("severe_count"))
    return out.withColumn("threat_score", s).withColumn("risk_level", risk_level(F.col("threat_score")))


# ---------------------------------------------------------------- T3 / T7 / T8
def stream_rate_windows(queries: DataFrame, window: str = "60 seconds", slide: str = "10 seconds",
                        watermark: str = "2 minutes") -> DataFrame:
    """T3 dashboard form: queries per source in sliding event-time windows (append = final windows)."""
    q = _with_time(queries, watermark)
    w = q.groupBy(F.window("event_time", window, slide), "src_ip").agg(F.count(F.lit(1)).alias("queries"))
    return w.select(F.unix_micros(F.col("window.start")).alias("window_start_us"), "src_ip", "queries")


def stream_label_counts(alerts: DataFrame) -> DataFrame:
    """Running counts per label (complete mode)."""
    return alerts.groupBy("label").agg(F.count(F.lit(1)).alias("events"))


def stream_throughput(packets: DataFrame, local_prefixes: list[str], interval: str = "2 seconds",
                      watermark: str = "30 seconds") -> DataFrame:
    """KB/s per tumbling window and direction (append = closed windows)."""
    def is_local(c):
        cond = F.lit(False)
        for p in local_prefixes:
            cond = cond | F.col(c).startswith(p)
        return cond
    # non-local traffic is kept as direction "other" (callers drop it from the
    # result): any filter here would be pushed below the watermark node
    p = _with_time(packets, watermark).withColumn(
        "direction", F.when(is_local("src_ip"), F.lit("out")).when(is_local("dst_ip"), F.lit("in"))
        .otherwise(F.lit("other")))
    secs = float(interval.split()[0])
    w = p.groupBy(F.window("event_time", interval), "direction").agg(F.sum("length").alias("_bytes"))
    return w.select(F.unix_micros(F.col("window.start")).alias("window_start_us"), "direction",
                    round_bin(F.col("_bytes") / F.lit(1024.0) / F.lit(secs), 1).alias("kb_per_s"))
