"""Per-address behaviour profiles and threat scores.

Input: an event stream with ``src_ip dst_port label total_length_fwd_packets
ts_us`` and a unique ``event_id`` (verdicts: ``flow_id`` / ``last_seen_us``).

* Final profiles (A6) are one ``groupBy(src_ip)`` of algebraic aggregates.
* Running scores (W5) are a ``sliding_count`` over ``(src_ip, time bucket)``
  with extra running sums, so a flooding source is split over buckets.
* First-seen ports are found by ``groupBy(src_ip, dst_port)`` + ``min_by`` and
  joined back on the unique event id (no skewed join key).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import round_bin
from ..plans.scan import BUCKET_COL, keyed_scan, sliding_count
from ..plans.stage import materialize

DEFAULT_BUCKET_S = 60
SEVERE = ["Zero-Day", "DoS/DDoS"]
REJECT_IPS = ["", "?", "0.0.0.0"]


def valid_sources(events: DataFrame) -> DataFrame:
    """Drop events without a usable source address."""
    return events.filter(F.col("src_ip").isNotNull() & ~F.col("src_ip").isin(*REJECT_IPS))


def threat_score(attack: Column, normal: Column, ports: Column, recent: Column, severe: Column) -> Column:
    """100 * (0.45 attack ratio + 0.25 min(ports/50,1) + 0.20 min(recent/100,1)
    + 0.10 min(severe/5,1)), 1 dp; 0 when there are no events."""
    total = attack + normal
    ar = F.when(total > 0, attack / total).otherwise(F.lit(0.0))
    ps = F.least(ports / F.lit(50.0), F.lit(1.0))
    rs = F.least(recent / F.lit(100.0), F.lit(1.0))
    ss = F.least(severe / F.lit(5.0), F.lit(1.0))
    raw = ar * 0.45 + ps * 0.25 + rs * 0.20 + ss * 0.10
    return F.when(total > 0, round_bin(raw * 100, 1)).otherwise(F.lit(0.0))


def risk_level(score: Column) -> Column:
    """CRITICAL >= 70, HIGH >= 45, MEDIUM >= 20, else LOW."""
    out = None
    for lo, name in config.RISK_LEVELS:
        out = F.when(score >= lo, F.lit(name)) if out is None else out.when(score >= lo, F.lit(name))
    return out.otherwise(F.lit(config.RISK_LEVELS[-1][1]))


def life_start(events: DataFrame, stale_s: int = config.BEHAVIOR_STALE_S) -> DataFrame:
    """Adds ``life_us``: when the source's present profile began; a profile idle for more than ``stale_s`` is dropped and starts anew.

    In buckets as wide as ``stale_s`` only a bucket's first event can follow such a pause, so starts come from
    one summary row per source and bucket; rows take the start of their bucket.
    """
    stale_us = int(stale_s * 1_000_000)
    b = F.floor(F.col("ts_us") / stale_us).cast("long")
    held = events.groupBy(F.col("src_ip").alias("_ip"), b.alias("_b")).agg(F.min("ts_us").alias("_lo"), F.max("ts_us").alias("_hi"))
    w = Window.partitionBy("_ip").orderBy("_b")
    held = held.withColumn("_gap", F.col("_lo") - F.lag("_hi").over(w)).withColumn("_new", F.col("_gap").isNull() | (F.col("_gap") > stale_us))
    held = held.select("_ip", "_b", F.last(F.when(F.col("_new"), F.col("_lo")), True).over(w).alias("life_us"))
    return events.join(held, (F.col("src_ip") == F.col("_ip")) & (b == F.col("_b"))).drop("_ip", "_b")


def running_scores(events: DataFrame, id_col: str = "flow_id", window_s: int = config.BEHAVIOR_WINDOW_S,
                   recent_cap: int = config.BEHAVIOR_RECENT_CAP, bucket_s: float = DEFAULT_BUCKET_S,
                   stale_s: int = config.BEHAVIOR_STALE_S) -> DataFrame:
    """The profile score of the source after each of its events; adds ``life_us``, the start of that profile.

    Two bucketed scans within each life of a profile: per port (its first event) and
    over all events (running counts and the 300 s event count).  The
    lineage is cut in front of each scan.
    """
    bucket_us = int(bucket_s * 1_000_000)
    ev = materialize(valid_sources(events).withColumn(
        "dst_port", F.coalesce(F.col("dst_port"), F.lit(0))), "behavior-events")
    ev = materialize(life_start(ev, stale_s), "behavior-lives")
    ev = keyed_scan(ev, ["src_ip", "life_us", "dst_port"], "ts_us", id_col, bucket_us, lags=[("_prev_port_ts", F.col("ts_us"))])
    ev = ev.withColumn("_is_first_port",
                       F.when((F.col("dst_port") != 0) & F.col("_prev_port_ts").isNull(), 1).otherwise(0))
    ev = materialize(ev.drop("_prev_port_ts", BUCKET_COL), "behavior-ports")
    lab = F.col("label")
    r = sliding_count(
        ev, ["src_ip", "life_us"], "ts_us", id_col, int(window_s * 1_000_000) - 1, bucket_us, out="_recent",
        extra_sums=[("attack_count", F.when(lab != "Normal", 1).otherwise(0)),
                    ("normal_count", F.when(lab == "Normal", 1).otherwise(0)),
                    ("severe_count", F.when(lab.isin(*SEVERE), 1).otherwise(0)),
                    ("ports_count", F.col("_is_first_port"))])
    r = r.withColumn("recent_events", F.least(F.col("_recent"), F.lit(recent_cap))).drop("_recent", "_is_first_port")
    s = threat_score(F.col("attack_count"), F.col("normal_count"), F.col("ports_count"),
                     F.col("recent_events"), F.col("severe_count"))
    return r.withColumn("threat_score", s).withColumn("risk_level", risk_level(F.col("threat_score")))


def ip_profiles(events: DataFrame, as_of_us: int | None = None, id_col: str = "flow_id",
                window_s: int = config.BEHAVIOR_WINDOW_S, recent_cap: int = config.BEHAVIOR_RECENT_CAP,
                bucket_s: float = DEFAULT_BUCKET_S, stale_s: int = config.BEHAVIOR_STALE_S) -> DataFrame:
    """A6 + A7 + P21 + W10: one profile per source address, that of its latest life.

    Counts are plain sums over that life, so no running scan is needed: distinct ports by a pre-aggregation
    per (source, port), the score's event count from the 300 s before the source's last event.
    ``recent_events`` counts events in the ``window_s`` up to
    ``as_of_us`` (default: latest event time, null without events), capped at the 500-event buffer.
    """
    ev = valid_sources(events).withColumn("dst_port", F.coalesce(F.col("dst_port"), F.lit(0)))
    ev = materialize(life_start(materialize(ev, "behavior-events"), stale_s), "behavior-lives")
    span = ev.groupBy("src_ip").agg(F.max("life_us").alias("life_us"), F.max("ts_us").alias("last_seen_us"))
    as_of = span.agg(F.max("last_seen_us").alias("as_of_us")) if as_of_us is None else span.sparkSession.range(1).select(F.lit(int(as_of_us)).alias("as_of_us"))
    span = materialize(span.crossJoin(F.broadcast(as_of)), "behavior-span")       # one row
    own = ev.join(span, ["src_ip", "life_us"])
    w_us, lab, ts = int(window_s * 1_000_000), F.col("label"), F.col("ts_us")
    by_port = own.groupBy("src_ip", "dst_port").agg(
        F.count_if(lab != "Normal").alias("attack_count"), F.count_if(lab == "Normal").alias("normal_count"), F.count_if(lab.isin(*SEVERE)).alias("severe_count"),
        F.sum("total_length_fwd_packets").alias("bytes"), F.min("ts_us").alias("lo"), F.max("last_seen_us").alias("last_seen_us"), F.max("as_of_us").alias("as_of_us"),
        F.count_if(ts > F.col("last_seen_us") - w_us).alias("recent_last"), F.count_if((ts > F.col("as_of_us") - w_us) & (ts <= F.col("as_of_us"))).alias("recent"))
    p = by_port.groupBy("src_ip").agg(
        *[F.sum(c).alias(c) for c in ("attack_count", "normal_count", "severe_count")], F.count_if(F.col("dst_port") != 0).alias("ports_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes_total"), F.min("lo").alias("first_seen_us"), F.max("last_seen_us").alias("last_seen_us"),
        F.max("as_of_us").alias("as_of_us"), F.least(F.sum("recent"), F.lit(recent_cap)).alias("recent_events"), F.least(F.sum("recent_last"), F.lit(recent_cap)).alias("_last"))
    score = threat_score(F.col("attack_count"), F.col("normal_count"), F.col("ports_count"), F.col("_last"), F.col("severe_count"))
    p = p.withColumn("threat_score", score)
    return p.select("src_ip", "attack_count", "normal_count", "ports_count", "severe_count", "bytes_total", "first_seen_us", "last_seen_us", "as_of_us", "recent_events",
                    "threat_score", risk_level(F.col("threat_score")).alias("risk_level"))


def label_counts(events: DataFrame, stale_s: int = config.BEHAVIOR_STALE_S) -> DataFrame:
    """A6 ``labels``: events per (source, label) in the source's latest life."""
    ev = materialize(life_start(materialize(valid_sources(events), "behavior-events"), stale_s), "behavior-lives")
    by = ev.groupBy("src_ip", "life_us", "label").agg(F.count(F.lit(1)).alias("events"))
    last = ev.groupBy("src_ip").agg(F.max("life_us").alias("life_us"))
    return by.join(last, ["src_ip", "life_us"]).select("src_ip", "label", "events")


def top_threats(profiles: DataFrame, n: int = 15) -> DataFrame:
    """O2: the ``n`` highest scores (ties by address)."""
    return profiles.orderBy(F.col("threat_score").desc(), F.col("src_ip")).limit(n)


def profile_of(profiles: DataFrame, ip: str) -> DataFrame:
    """O3: point lookup of one profile."""
    return profiles.filter(F.col("src_ip") == F.lit(ip))


def risk_breakdown(profiles: DataFrame) -> DataFrame:
    """Profiles per risk level, zero-filled, with the number of tracked addresses."""
    levels = [name for _, name in config.RISK_LEVELS]
    dim = profiles.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in levels])).alias("risk_level"))
    c = profiles.groupBy("risk_level").agg(F.count(F.lit(1)).alias("ips"))
    total = profiles.agg(F.count(F.lit(1)).alias("total_ips_tracked"))
    return (dim.join(c, "risk_level", "left").select("risk_level", F.coalesce("ips", F.lit(0)).cast("long").alias("ips"))
            .crossJoin(F.broadcast(total)))


def active_profiles(profiles: DataFrame, now_us: int | Column, stale_s: int = config.BEHAVIOR_STALE_S,
                    max_ips: int = config.BEHAVIOR_MAX_IPS) -> DataFrame:
    """Profiles seen in the last ``stale_s`` before ``now_us``, the ``max_ips`` most recent."""
    now = now_us if isinstance(now_us, Column) else F.lit(int(now_us))
    return (profiles.filter(F.col("last_seen_us") >= now - F.lit(int(stale_s * 1_000_000)))
            .orderBy(F.col("last_seen_us").desc(), F.col("src_ip")).limit(max_ips))
