"""Packets -> bidirectional flows -> the 77 flow features.

Plan shape (batch):

* P1/P2 filters run before any shuffle, on the scan.
* W1 canonical key = sorted ``(ip, port)`` endpoints + protocol; the sender of
  the flow's first packet is "forward".
* W2-W4, W9 run as two ``keyed_scan`` passes over the same
  ``(key, time bucket)`` partitioning: one hash exchange of the packets, the
  second pass reuses it.  A flooding 5-tuple is split over time buckets.
* A1 is one ``groupBy(key, flow_id)`` of algebraic aggregates (count, sum,
  min, max, exact DECIMAL moments) with fixed-width buffers, planned as a
  HashAggregate: partial aggregation runs before the exchange and a huge flow
  is merged from per-bucket partials.  The first sender and the first window
  per direction come from the scan pass as row flags, not ``min_by``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import round_bin
from ..plans.scan import keyed_scan
from ..plans.stage import materialize

FLOW_KEY = ["k_ip_a", "k_port_a", "k_ip_b", "k_port_b", "protocol"]
DEFAULT_BUCKET_S = 10
FLAG_NAMES = [n for n, _ in config.TCP_FLAG_BITS]
DEC = "decimal(38,0)"


# ---------------------------------------------------------------- P1-P3
def drop_loopback(packets: DataFrame) -> DataFrame:
    """Drop packets whose source or destination starts with ``127.``."""
    return packets.filter(~(F.col("src_ip").startswith("127.") | F.col("dst_ip").startswith("127.")))


def keep_ip(packets: DataFrame) -> DataFrame:
    """Keep IPv4 and IPv6 packets only (the ``ip or ip6`` capture filter)."""
    return packets.filter(F.col("ip_version").isin(4, 6))


def clean_packets(packets: DataFrame) -> DataFrame:
    """P1 + P2, applied on the scan side before any shuffle."""
    return drop_loopback(keep_ip(packets))


def decode_flags(packets: DataFrame, col: str = "tcp_flags") -> DataFrame:
    """TCP flag bit mask -> eight booleans ``fin syn rst psh ack urg ece cwr``."""
    return packets.select("*", *[(F.col(col).bitwiseAND(F.lit(mask)) != 0).alias(name)
                                 for name, mask in config.TCP_FLAG_BITS])


# ---------------------------------------------------------------- W1
def canonical_key(packets: DataFrame) -> DataFrame:
    """Add the direction-free flow key and ``s_lo`` (sender is the lower endpoint)."""
    # missing fields take the reference's defaults: address 0.0.0.0, port/protocol 0
    packets = packets.fillna({"src_ip": "0.0.0.0", "dst_ip": "0.0.0.0", "src_port": 0, "dst_port": 0,
                              "protocol": 0})
    s_lo = (F.col("src_ip") < F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port")))
    return packets.select(
        "*", s_lo.alias("s_lo"),
        F.when(s_lo, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("k_ip_a"),
        F.when(s_lo, F.col("src_port")).otherwise(F.col("dst_port")).alias("k_port_a"),
        F.when(s_lo, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("k_ip_b"),
        F.when(s_lo, F.col("dst_port")).otherwise(F.col("src_port")).alias("k_port_b"))


# ---------------------------------------------------------------- W2-W4, W9 inputs
def assign_flows(packets: DataFrame, timeout_s: float = config.FLOW_TIMEOUT_S,
                 active_timeout_s: float = config.ACTIVE_TIMEOUT_S,
                 bucket_s: float = DEFAULT_BUCKET_S) -> DataFrame:
    """Label every packet with its flow and the per-packet gaps the features need.

    Adds: ``flow_id`` (packet_id of the flow's first packet), ``fwd``,
    ``boundary``, ``flow_iat_us`` (gap to the previous packet of the flow),
    ``dir_iat_us`` (gap to the previous packet of the same direction in the
    flow), ``idle_us`` / ``active_us`` (W3: an idle gap > active timeout
    closes the running active period).

    A new flow starts on the first packet of a key, after a silence strictly
    longer than ``timeout_s``, or after a packet carrying FIN or RST (that
    packet stays in the closed flow).
    """
    timeout_us = int(round(timeout_s * 1_000_000))
    active_us = int(round(active_timeout_s * 1_000_000))
    bucket_us = int(round(bucket_s * 1_000_000))
    p = packets
    if "fin" not in p.columns:
        p = decode_flags(p)
    p = canonical_key(p)
    order = F.struct(F.col("ts_us"), F.col("packet_id"))

    # pass 1: previous packet of the key
    p = keyed_scan(p, FLOW_KEY, "ts_us", "packet_id", bucket_us,
                   lags=[("_prev_ts", F.col("ts_us")), ("_prev_fr", F.col("fin") | F.col("rst"))])
    gap = F.col("ts_us") - F.col("_prev_ts")
    boundary = F.col("_prev_ts").isNull() | (gap > timeout_us) | F.col("_prev_fr")
    p = p.withColumn("boundary", boundary)
    act_gap = (~F.col("boundary")) & (gap > active_us)
    p = p.withColumn("_act_gap", act_gap)
    p = materialize(p, "flows-pass1")

    # pass 2: flow start, first sender, previous packet per direction, segment start
    p = keyed_scan(
        p, FLOW_KEY, "ts_us", "packet_id", bucket_us,
        lasts=[("_start_x", F.when(F.col("boundary"), order)),
               ("_first_lo_x", F.when(F.col("boundary"), F.col("s_lo"))),
               ("_prev_lo", F.when(F.col("s_lo"), order)),
               ("_prev_hi", F.when(~F.col("s_lo"), order)),
               ("_seg_start_x", F.when(F.col("boundary") | F.col("_act_gap"), F.col("ts_us"))),
               ("_win_lo", F.when(F.col("s_lo") & (F.col("window_size") >= 0), order)),
               ("_win_hi", F.when(~F.col("s_lo") & (F.col("window_size") >= 0), order))])
    start = F.when(F.col("boundary"), order).otherwise(F.col("_start_x"))
    first_lo = F.when(F.col("boundary"), F.col("s_lo")).otherwise(F.col("_first_lo_x"))
    prev_same = F.when(F.col("s_lo"), F.col("_prev_lo")).otherwise(F.col("_prev_hi"))
    in_flow = prev_same.isNotNull() & (prev_same >= start)
    prev_win = F.when(F.col("s_lo"), F.col("_win_lo")).otherwise(F.col("_win_hi"))
    # W9 as a per-row flag: the first packet of its direction in the flow with a window >= 0
    first_win = (F.col("window_size") >= 0) & ~(prev_win.isNotNull() & (prev_win >= start))
    return p.select(
        *[c for c in packets.columns], *[c for c in FLAG_NAMES if c not in packets.columns],
        *FLOW_KEY[:4], "s_lo", "boundary",
        start.getField("packet_id").alias("flow_id"),
        (F.col("s_lo") == first_lo).alias("fwd"),
        F.when(~F.col("boundary"), gap).alias("flow_iat_us"),
        F.when(in_flow, F.col("ts_us") - prev_same.getField("ts_us")).alias("dir_iat_us"),
        F.when(F.col("_act_gap"), gap).alias("idle_us"),
        F.when(F.col("_act_gap"), F.col("_prev_ts") - F.col("_seg_start_x")).alias("active_us"),
        first_win.alias("first_win"),
        # the first sender's endpoints follow from the key and its direction (no per-flow min_by)
        F.when(first_lo, F.col("k_ip_a")).otherwise(F.col("k_ip_b")).alias("f_src_ip"),
        F.when(first_lo, F.col("k_ip_b")).otherwise(F.col("k_ip_a")).alias("f_dst_ip"),
        F.when(first_lo, F.col("k_port_a")).otherwise(F.col("k_port_b")).alias("f_src_port"),
        F.when(first_lo, F.col("k_port_b")).otherwise(F.col("k_port_a")).alias("f_dst_port"))


# ---------------------------------------------------------------- A1
def _moments(prefix: str, x: Column) -> list[Column]:
    """count, sum, sum of squares (exact, DECIMAL), max, min of a nullable column."""
    return [F.count(x).alias(f"{prefix}_n"), F.sum(x).alias(f"{prefix}_s"),
            F.sum(x.cast(DEC) * x.cast(DEC)).alias(f"{prefix}_sq"),
            F.max(x).alias(f"{prefix}_max"), F.min(x).alias(f"{prefix}_min")]


def _std(n: Column, s: Column, sq: Column) -> Column:
    """Population std from exact integer moments: sqrt(n*sum(x^2) - sum(x)^2) / n; 0 when n < 2."""
    d = (n.cast(DEC) * sq - s.cast(DEC) * s.cast(DEC)).cast("double")
    return F.when(n >= 2, F.sqrt(d) / n).otherwise(F.lit(0.0))


def _mean(n: Column, s: Column) -> Column:
    return F.when(n > 0, s.cast("double") / n).otherwise(F.lit(0.0))


def _list_stats(prefix: str) -> dict[str, Column]:
    """Stats of a list that is replaced by [0.0] when empty (IAT, active, idle lists)."""
    n0 = F.col(f"{prefix}_n")
    n = F.greatest(n0, F.lit(1))
    s = F.coalesce(F.col(f"{prefix}_s"), F.lit(0).cast("long"))
    sq = F.coalesce(F.col(f"{prefix}_sq"), F.lit(0).cast(DEC))
    return {"sum": s.cast("double"), "mean": s.cast("double") / n, "std": _std(n, s, sq),
            "max": F.coalesce(F.col(f"{prefix}_max"), F.lit(0)).cast("double"),
            "min": F.coalesce(F.col(f"{prefix}_min"), F.lit(0)).cast("double")}


def flow_features(assigned: DataFrame) -> DataFrame:
    """A1: one row per flow with the 77 features in model order plus metadata.

    Metadata: ``flow_id src_ip dst_ip src_port dst_port protocol
    first_seen_us last_seen_us``.  IAT features are seconds, active/idle are
    microseconds, ratios and moments are rounded to 4 dp, as the reference does.
    """
    fwd, bwd = F.col("fwd"), ~F.col("fwd")
    ln = F.col("length")

    def cnt(c: Column) -> Column:
        return F.count_if(c)

    # every buffer is fixed-width or a DECIMAL sum, so this plans as a HashAggregate
    aggs = [
        F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us"),
        *_moments("fl", F.when(fwd, ln)), *_moments("bl", F.when(bwd, ln)), *_moments("al", ln),
        *_moments("fi", F.col("flow_iat_us")),
        *_moments("ffi", F.when(fwd, F.col("dir_iat_us"))), *_moments("bfi", F.when(bwd, F.col("dir_iat_us"))),
        *_moments("act", F.col("active_us")), *_moments("idl", F.col("idle_us")),
        cnt(fwd & F.col("psh")).alias("fwd_psh"), cnt(bwd & F.col("psh")).alias("bwd_psh"),
        cnt(fwd & F.col("urg")).alias("fwd_urg"), cnt(bwd & F.col("urg")).alias("bwd_urg"),
        F.coalesce(F.sum(F.when(fwd, F.col("header_length"))), F.lit(0).cast("long")).alias("fwd_hdr"),
        F.coalesce(F.sum(F.when(bwd, F.col("header_length"))), F.lit(0).cast("long")).alias("bwd_hdr"),
        *[cnt(F.col(f)).alias(f"n_{f}") for f in ("fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece")],
        F.max(F.when(fwd & F.col("first_win"), F.col("window_size"))).alias("win_f"),
        F.max(F.when(bwd & F.col("first_win"), F.col("window_size"))).alias("win_b"),
        cnt(fwd & (ln > 0)).alias("act_data"),
    ]
    g = assigned.groupBy(*FLOW_KEY, "flow_id", "f_src_ip", "f_dst_ip", "f_src_port", "f_dst_port").agg(*aggs)

    nf, nb = F.col("fl_n"), F.col("bl_n")
    fb = F.coalesce(F.col("fl_s"), F.lit(0).cast("long"))
    bb = F.coalesce(F.col("bl_s"), F.lit(0).cast("long"))
    du = F.greatest(F.col("last_seen_us") - F.col("first_seen_us"), F.lit(1)).cast("double")
    ds = du / F.lit(1e6)

    def r4(c: Column) -> Column:
        return round_bin(c, 4)

    def per_s(num: Column) -> Column:
        return r4(num.cast("double") / ds)

    l_max = lambda p: F.coalesce(F.col(f"{p}_max"), F.lit(0)).cast("int")
    l_min = lambda p: F.coalesce(F.col(f"{p}_min"), F.lit(0)).cast("int")
    f_mean, b_mean, a_mean = (r4(_mean(F.col(f"{p}_n"), F.col(f"{p}_s"))) for p in ("fl", "bl", "al"))
    f_std, b_std = (r4(_std(F.col(f"{p}_n"), F.col(f"{p}_s"), F.col(f"{p}_sq"))) for p in ("fl", "bl"))
    a_std_raw = _std(F.col("al_n"), F.col("al_s"), F.col("al_sq"))
    fi, ffi, bfi = _list_stats("fi"), _list_stats("ffi"), _list_stats("bfi")
    act, idl = _list_stats("act"), _list_stats("idl")
    sec = F.lit(1e6)
    fwd_hdr, bwd_hdr = F.col("fwd_hdr"), F.col("bwd_hdr")

    feats = {
        "flow_duration": round_bin(du, 2),
        "total_fwd_packets": nf, "total_backward_packets": nb,
        "total_length_fwd_packets": fb, "total_length_bwd_packets": bb,
        "fwd_packet_length_max": l_max("fl"), "fwd_packet_length_min": l_min("fl"),
        "fwd_packet_length_mean": f_mean, "fwd_packet_length_std": f_std,
        "bwd_packet_length_max": l_max("bl"), "bwd_packet_length_min": l_min("bl"),
        "bwd_packet_length_mean": b_mean, "bwd_packet_length_std": b_std,
        "flow_bytes_s": per_s(fb + bb), "flow_packets_s": per_s(nf + nb),
        "flow_iat_mean": r4(fi["mean"] / sec), "flow_iat_std": r4(fi["std"] / sec),
        "flow_iat_max": fi["max"] / sec, "flow_iat_min": fi["min"] / sec,
        "fwd_iat_total": r4(ffi["sum"] / sec), "fwd_iat_mean": r4(ffi["mean"] / sec),
        "fwd_iat_std": r4(ffi["std"] / sec), "fwd_iat_max": ffi["max"] / sec, "fwd_iat_min": ffi["min"] / sec,
        "bwd_iat_total": r4(bfi["sum"] / sec), "bwd_iat_mean": r4(bfi["mean"] / sec),
        "bwd_iat_std": r4(bfi["std"] / sec), "bwd_iat_max": bfi["max"] / sec, "bwd_iat_min": bfi["min"] / sec,
        "fwd_psh_flags": F.col("fwd_psh"), "bwd_psh_flags": F.col("bwd_psh"),
        "fwd_urg_flags": F.col("fwd_urg"), "bwd_urg_flags": F.col("bwd_urg"),
        "fwd_header_length": fwd_hdr, "bwd_header_length": bwd_hdr,
        "fwd_packets_s": per_s(nf), "bwd_packets_s": per_s(nb),
        "min_packet_length": l_min("al"), "max_packet_length": l_max("al"),
        "packet_length_mean": a_mean, "packet_length_std": r4(a_std_raw),
        "packet_length_variance": r4(a_std_raw * a_std_raw),
        "fin_flag_count": F.col("n_fin"), "syn_flag_count": F.col("n_syn"), "rst_flag_count": F.col("n_rst"),
        "psh_flag_count": F.col("n_psh"), "ack_flag_count": F.col("n_ack"), "urg_flag_count": F.col("n_urg"),
        "cwe_flag_count": F.col("n_cwr"), "ece_flag_count": F.col("n_ece"),
        "down_up_ratio": r4(F.when(nf > 0, nb.cast("double") / nf).otherwise(F.lit(0.0))),
        "average_packet_size": a_mean, "avg_fwd_segment_size": f_mean, "avg_bwd_segment_size": b_mean,
        "fwd_header_length_1": fwd_hdr,
        "fwd_avg_bytes_bulk": r4(fb.cast("double") / F.greatest(nf, F.lit(1))),
        "fwd_avg_packets_bulk": nf, "fwd_avg_bulk_rate": per_s(fb),
        "bwd_avg_bytes_bulk": r4(bb.cast("double") / F.greatest(nb, F.lit(1))),
        "bwd_avg_packets_bulk": nb, "bwd_avg_bulk_rate": per_s(bb),
        "subflow_fwd_packets": nf, "subflow_fwd_bytes": fb,
        "subflow_bwd_packets": nb, "subflow_bwd_bytes": bb,
        "init_win_bytes_forward": F.greatest(F.coalesce(F.col("win_f"), F.lit(-1)), F.lit(0)),
        "init_win_bytes_backward": F.greatest(F.coalesce(F.col("win_b"), F.lit(-1)), F.lit(0)),
        "act_data_pkt_fwd": F.col("act_data"), "min_seg_size_forward": l_min("fl"),
        "active_mean": r4(act["mean"]), "active_std": r4(act["std"]),
        "active_max": r4(act["max"]), "active_min": r4(act["min"]),
        "idle_mean": r4(idl["mean"]), "idle_std": r4(idl["std"]),
        "idle_max": r4(idl["max"]), "idle_min": r4(idl["min"]),
    }
    assert list(feats) == config.FEATURE_NAMES
    return g.select(
        "flow_id", F.col("f_src_ip").alias("src_ip"), F.col("f_dst_ip").alias("dst_ip"),
        F.col("f_src_port").alias("src_port"), F.col("f_dst_port").alias("dst_port"),
        "protocol", "first_seen_us", "last_seen_us",
        *[c.alias(n) for n, c in feats.items()])


def flows_from_packets(packets: DataFrame, timeout_s: float = config.FLOW_TIMEOUT_S,
                       active_timeout_s: float = config.ACTIVE_TIMEOUT_S,
                       bucket_s: float = DEFAULT_BUCKET_S) -> DataFrame:
    """S2 -> P1/P2 -> W1-W4 -> A1 in one lineage."""
    return flow_features(assign_flows(clean_packets(packets), timeout_s, active_timeout_s, bucket_s))
