"""Dashboard-style rollups (A2, O1, and later A4/A5/A15/A17, O4-O6, P24).

All are aggregations or top-k: partial aggregation before the exchange, and
``orderBy().limit()`` plans as ``TakeOrderedAndProject`` (per-partition top-k,
then a k-row merge).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config


def _label_dim(df: DataFrame, labels: list[str]) -> DataFrame:
    """Known labels as a tiny DataFrame on the same session (fixed size)."""
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))


def label_stats(events: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """A2: events per label, zero-filled for the known labels, with the total."""
    known = _label_dim(events, labels or list(config.ATTACK_LABELS.values()))
    counts = events.groupBy("label").agg(F.count(F.lit(1)).alias("events"))
    total = counts.agg(F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("total"))
    j = known.join(counts, "label", "full_outer").select(
        "label", F.coalesce(F.col("events"), F.lit(0)).cast("long").alias("events"))
    return j.crossJoin(F.broadcast(total))        # one-row aggregate


def latest(df: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """Latest ``n`` rows, newest first."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def recent_events(events: DataFrame, n: int = 100) -> DataFrame:
    """O1: latest ``n`` log events."""
    return latest(events, n, "last_seen_us", "flow_id")


# ---------------------------------------------------------------- honeypot
def service_of(port: "Column") -> "Column":
    """Honeypot port -> service name, default ``Port-<n>``."""
    m = F.create_map(*[x for k, v in config.PORT_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[port], F.concat(F.lit("Port-"), port.cast("string")))


def with_service(hits: DataFrame) -> DataFrame:
    return hits.withColumn("service", service_of(F.col("port")))


def honeypot_by_service(hits: DataFrame) -> DataFrame:
    """A4: hits per service (a port without one under its bare number) with the total."""
    h = hits.withColumn("service", F.regexp_replace(service_of(F.col("port")), "^Port-", ""))
    c = h.groupBy("service").agg(F.count(F.lit(1)).alias("hits"))
    total = h.agg(F.count(F.lit(1)).alias("total_hits"))
    return c.crossJoin(F.broadcast(total))       # one-row aggregate


def honeypot_top_ips(hits: DataFrame, n: int = 10) -> DataFrame:
    """A5: the ``n`` most frequent source addresses (ties by address)."""
    return (hits.groupBy("src_ip").agg(F.count(F.lit(1)).alias("hits"))
            .orderBy(F.col("hits").desc(), F.col("src_ip")).limit(n))


def recent_hits(hits: DataFrame, n: int = 50) -> DataFrame:
    """Latest hits, buffer of 1000."""
    return latest(with_service(hits), n, "ts_us", "hit_id")


def latest_packets(packets: DataFrame, n: int = 5000) -> DataFrame:
    """The last ``n`` packets (the capture ring buffer)."""
    return latest(packets, n, "ts_us", "packet_id")


# ---------------------------------------------------------------- A17 / T8
def throughput(packets: DataFrame, local_prefixes: list[str], interval_s: int = 2) -> DataFrame:
    """KB/s per ``interval_s`` tumbling window and direction (1 dp).

    ``out`` = sent by a local address, ``in`` = received by one; traffic
    between two non-local addresses is not counted, as host counters would not see it.
    """
    def is_local(c):
        cond = F.lit(False)
        for p in local_prefixes:
            cond = cond | F.col(c).startswith(p)
        return cond
    iv = int(interval_s * 1_000_000)
    d = packets.select(
        (F.floor(F.col("ts_us") / iv) * iv).cast("long").alias("window_start_us"),
        F.when(is_local("src_ip"), F.lit("out")).when(is_local("dst_ip"), F.lit("in")).alias("direction"),
        "length").filter(F.col("direction").isNotNull())
    from ..functions.columns import round_bin
    return d.groupBy("window_start_us", "direction").agg(
        round_bin(F.sum("length") / F.lit(1024.0) / F.lit(float(interval_s)), 1).alias("kb_per_s"))


# ---------------------------------------------------------------- A15
def dashboard_stats(verdicts: DataFrame, block_rows: DataFrame, hits: DataFrame, dns_verdicts: DataFrame, profiles: DataFrame, packets: DataFrame,
                    now: DataFrame, model_accuracy: float = 0.0, buffer_size: int = 5000) -> DataFrame:
    """One record with the dashboard totals (one-row aggregates side by side).

    ``now`` is one row ``now_us``, null where nothing has happened.  ``by_type`` is the JSON of events per label,
    known labels with none included; the capture buffer holds the last ``buffer_size`` packets.
    """
    v = verdicts.agg(F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("is_attack")).alias("attacks"))
    types = label_stats(verdicts).agg(F.array_sort(F.collect_list(F.struct("label", "events"))).alias("t"))     # one row a label
    types = types.select(F.to_json(F.map_from_entries("t")).alias("by_type"))
    b = block_rows.crossJoin(F.broadcast(now)).agg(F.count_if((F.col("blocked_at_us") <= F.col("now_us")) & (F.col("now_us") < F.col("unblocked_at_us"))).alias("blocked_ips"))
    h = hits.agg(F.count(F.lit(1)).alias("honeypot_hits"), F.count_distinct("src_ip").alias("honeypot_sources"), F.count_distinct("port").alias("honeypot_ports"))
    d = dns_verdicts.agg(F.count(F.lit(1)).alias("dns_queries"), F.count_if(F.col("attack_type").isNotNull()).alias("dns_attacks"), F.count_distinct("src_ip").alias("dns_sources"))
    p = profiles.agg(F.count(F.lit(1)).alias("tracked_ips"), *[F.count_if(F.col("risk_level") == x).alias(f"{x.lower()}_ips") for _, x in config.RISK_LEVELS])
    k = packets.agg(F.count(F.lit(1)).alias("packets_captured")).withColumn("buffered_packets", F.least("packets_captured", F.lit(buffer_size)).cast("long"))
    out = v
    for x in (types, b, h, d, p, k):
        out = out.crossJoin(F.broadcast(x))      # each side is exactly one row
    return out.withColumn("model_accuracy", F.lit(float(model_accuracy)))


# ---------------------------------------------------------------- P24
POSTURE_RATINGS = [   # FIXED VALUES: (minimum score, rating), first match wins
    (100, "A+ (EXCELLENT PROTECTION)"), (80, "A (STRONG DEFENSE)"), (60, "B (MODERATE DEFENSE)"),
    (40, "C (WEAK PROTECTION)"), (20, "D (VULNERABLE)"), (0, "F (CRITICAL - SYSTEM VULNERABLE)"),
]
POSTURE_ADVICE = [    # (flag that must be true, advice when it is not), in order; FIXED VALUES but for the first line, which names this engine's training
    ("ml_ready", "- **Train Supervised Models**: Run the training job to activate the tree and isolation-forest detectors."),
    ("ae_ready", "- **Configure Autoencoder**: Run a complete model training process to activate the Zero-day detection engine."),
    ("auto_block", "- **Enable Intrusion Prevention (IPS)**: Turn on 'Auto IP Blocking' in Settings to automatically ban threats."),
    ("tg_enabled", "- **Setup Telegram Notifications**: Configure Telegram Alerts to get instant mobile alerts when threats occur."),
    ("email_enabled", "- **Setup Email Alerts**: Bind SMTP settings in the configuration manager for permanent logs."),
    ("intel_active", "- **Register AbuseIPDB**: Add your API key to compare attacking IPs against international threat indexes."),
]
POSTURE_ALL_CLEAR = ("- **System Configured Correctly**: All primary defense shields are active! "
                     "Keep monitoring system logs regularly.")


def posture(status: DataFrame) -> DataFrame:
    """5 checks x 20 points, rating ladder, advice for failed checks (or the all-clear line)."""
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    checks = [b("ml_ready"), b("ae_ready"), b("honeypot_active"), b("auto_block"), b("tg_enabled") | b("email_enabled")]
    score = sum((F.when(c, 20).otherwise(0) for c in checks), F.lit(0))
    rating = None
    for lo, name in POSTURE_RATINGS:
        rating = F.when(score >= lo, F.lit(name)) if rating is None else rating.when(score >= lo, F.lit(name))
    advice = F.filter(F.array(*[F.when(~b(c), F.lit(t)) for c, t in POSTURE_ADVICE]), lambda x: x.isNotNull())
    advice = F.when(F.size(advice) == 0, F.array(F.lit(POSTURE_ALL_CLEAR))).otherwise(advice)
    return status.select("sensor_id", score.cast("int").alias("score"), rating.alias("rating"),
                         advice.alias("recommendations"))
