"""DNS tunnelling / generated-domain / flood detection.

Everything per row is a native Column expression (higher-order array
functions for the entropy and label filter).  The per-source 60 s query rate
is a ``sliding_count`` over ``(src_ip, time bucket)``: a flooding source is
split across buckets instead of landing in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import round_bin
from ..plans.scan import sliding_count

DEFAULT_BUCKET_S = 10


# ---------------------------------------------------------------- F1
def shannon_entropy(s: Column) -> Column:
    """Shannon entropy (bits) of a string; 0 for empty.

    Sum over positions of log2(count(char)/n), divided by -n: the same value
    as the sum over distinct characters, in a fixed order.
    """
    n = F.length(s)

    def total(chars: Column) -> Column:
        terms = F.transform(chars, lambda c: F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    # the characters are bound to a variable, so that the text is split once
    return F.when(n > 0, -F.get(F.transform(F.array(F.split(s, "")), total), F.lit(0)) / n).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- P22 / F2
def clean_qname(q: Column) -> Column:
    """Query name without trailing dots."""
    return F.rtrim(q, F.lit("."))


def domain_label(q: Column, tlds: list[str] | None = None) -> Column:
    """lower-case, split on dots, drop common TLD words and parts of <= 2
    chars, keep the rightmost remaining part (null if none)."""
    t = F.array(*[F.lit(x) for x in (tlds or config.COMMON_TLDS)])
    parts = F.split(F.lower(F.rtrim(q, F.lit("."))), r"\.")
    kept = F.filter(parts, lambda p: ~F.array_contains(t, p) & (F.length(p) > 2))
    return F.when(F.size(kept) > 0, F.element_at(kept, -1))


# ---------------------------------------------------------------- F3
def dga_reason(label: Column, ent: Column | None = None) -> Column:
    """first failed check, in order, or null when the label looks normal.

    Pass a precomputed entropy column to evaluate it once per row.
    """
    ent = shannon_entropy(label) if ent is None else ent
    n = F.length(label)
    vowels = n - F.length(F.translate(label, "aeiou", ""))
    return (F.when(label.isNull(), F.lit(None).cast("string"))
            .when(label.rlike("^[0-9a-fA-F]{8,}$"), F.lit("hex-pattern label"))
            .when(ent > 3.8, F.format_string("high entropy (%.2f)", ent))
            .when(F.lower(label).rlike("[^aeiou]{5,}"), F.lit("consonant cluster"))
            .when(n >= 25, F.format_string("long label (%d chars)", n))
            .when((n > 6) & (vowels / n < 0.15), F.lit("low vowel ratio")))


# ---------------------------------------------------------------- W6
def dns_rate(queries: DataFrame, window_s: int = config.DNS_WINDOW_S, cap: int = config.DNS_RATE_CAP,
             bucket_s: float = DEFAULT_BUCKET_S) -> DataFrame:
    """Per query, queries from the same source in the last ``window_s``
    (inclusive) up to this arrival, capped at ``cap``; adds ``recent``."""
    r = sliding_count(queries, ["src_ip"], "ts_us", "packet_id", int(window_s * 1_000_000),
                      int(bucket_s * 1_000_000), out="_recent")
    return r.withColumn("recent", F.least(F.col("_recent"), F.lit(cap))).drop("_recent")


# ---------------------------------------------------------------- F4
def dns_verdicts(queries: DataFrame, window_s: int = config.DNS_WINDOW_S, limit: int = config.DNS_FLOOD_LIMIT,
                 tunnel_len: int = config.DNS_TUNNEL_LEN, cap: int = config.DNS_RATE_CAP,
                 bucket_s: float = DEFAULT_BUCKET_S) -> DataFrame:
    """every query with its verdict columns (``attack_type`` null = no alert).

    Tunnelling (first label >= ``tunnel_len``) else, for names longer than 4,
    the generated-domain checks; a flood (``recent >= limit``) overrides both.
    """
    q = queries.filter(F.col("qname").isNotNull()).withColumn("qname", clean_qname(F.col("qname")))
    return judge_queries(dns_rate(q, window_s, cap, bucket_s), window_s, limit, tunnel_len)


def judge_queries(q: DataFrame, window_s: int = config.DNS_WINDOW_S, limit: int = config.DNS_FLOOD_LIMIT,
                  tunnel_len: int = config.DNS_TUNNEL_LEN) -> DataFrame:
    """The verdict columns of queries with a clean ``qname`` and their ``recent`` rate; column functions only, for tables and streams."""
    qn = F.col("qname")
    sub_len = F.length(F.substring_index(qn, ".", 1))
    # one projection per stage: the higher-order entropy runs once per row
    q = q.withColumn("domain_label", domain_label(qn))
    q = q.withColumn("entropy", shannon_entropy(F.coalesce(F.col("domain_label"), F.lit(""))))
    q = q.withColumn("dga_reason", dga_reason(F.col("domain_label"), F.col("entropy")))
    reason = F.col("dga_reason")
    flood = F.col("recent") >= limit
    tunnel = sub_len >= tunnel_len
    dga = (~tunnel) & (F.length(qn) > 4) & reason.isNotNull()
    attack = (F.when(flood, F.lit("DNS Flood")).when(tunnel, F.lit("DNS Tunneling"))
              .when(dga, F.lit("DGA Domain")))
    why = (F.when(flood, F.format_string("%d queries/%ds", F.col("recent"), F.lit(window_s)))
           .when(tunnel, F.format_string("subdomain length %d", sub_len))
           .when(dga, reason))
    sev = F.when(flood | tunnel, F.lit("HIGH")).when(dga, F.lit("MEDIUM"))
    # exploded from an array of one: a filter on the type stays above it, instead of copying the checks and their entropy into itself
    return q.select("*", F.explode(F.array(attack)).alias("attack_type"), why.alias("reason"), sev.alias("severity"))


def dns_alerts(queries: DataFrame, **kw) -> DataFrame:
    """D9 alert rows: attack_type, label, src_ip, query, reason, severity, timestamp text."""
    return alert_rows(dns_verdicts(queries, **kw))


def alert_rows(verdicts: DataFrame) -> DataFrame:
    v = verdicts.filter(F.col("attack_type").isNotNull())
    return v.select("packet_id", "ts_us", "attack_type", F.lit("DNS Attack").alias("label"), "src_ip",
                    F.col("qname").alias("query"), "reason", "severity",
                    F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


def dns_stats(verdicts: DataFrame) -> DataFrame:
    """Total queries, attacks, distinct source addresses."""
    return verdicts.agg(F.count(F.lit(1)).alias("total_dns_queries"),
                        F.count_if(F.col("attack_type").isNotNull()).alias("dns_attacks"),
                        F.count_distinct("src_ip").alias("tracked_ips"))


def entropy_table(queries: DataFrame) -> DataFrame:
    """F1/F2 per query: domain label and its entropy (6 dp)."""
    lab = domain_label(F.col("qname"))
    return queries.select("packet_id", lab.alias("domain_label"),
                          round_bin(shannon_entropy(F.coalesce(lab, F.lit(""))), 6).alias("entropy"))
