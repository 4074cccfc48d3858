"""Stateful flow assembly on a packet stream.

``applyInPandasWithState`` keyed by the canonical flow key.  The state is one
open flow's running totals (counts, sums, exact integer sums of squares, min,
max, last times) — never its packet list — so it is O(1) per key.  A flow is
emitted when a FIN/RST packet closes it, when a packet arrives after more than
``timeout_s`` of silence, or when the event-time timeout (watermark past
last packet + timeout) fires.  Packets later than the watermark are dropped
by Spark.  Emitted rows have the batch ``flow_features`` schema and values.
"""
from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import config
from ..operators.flows import FLOW_KEY, canonical_key, clean_packets, decode_flags

STATE_SCHEMA = T.StructType([T.StructField("acc", T.StringType())])
INT_FEATS = {"total_fwd_packets", "total_backward_packets", "total_length_fwd_packets", "total_length_bwd_packets",
             "fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags", "fwd_header_length",
             "bwd_header_length", "fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count",
             "ack_flag_count", "urg_flag_count", "cwe_flag_count", "ece_flag_count", "fwd_header_length_1",
             "fwd_avg_packets_bulk", "bwd_avg_packets_bulk", "subflow_fwd_packets", "subflow_fwd_bytes",
             "subflow_bwd_packets", "subflow_bwd_bytes", "act_data_pkt_fwd"}
INT32_FEATS = {"fwd_packet_length_max", "fwd_packet_length_min", "bwd_packet_length_max", "bwd_packet_length_min",
               "min_packet_length", "max_packet_length", "init_win_bytes_forward", "init_win_bytes_backward",
               "min_seg_size_forward"}
META = [("flow_id", T.LongType()), ("src_ip", T.StringType()), ("dst_ip", T.StringType()),
        ("src_port", T.IntegerType()), ("dst_port", T.IntegerType()), ("protocol", T.IntegerType()),
        ("first_seen_us", T.LongType()), ("last_seen_us", T.LongType())]


def output_schema() -> T.StructType:
    fields = [T.StructField(n, t) for n, t in META]
    for f in config.FEATURE_NAMES:
        t = T.LongType() if f in INT_FEATS else T.IntegerType() if f in INT32_FEATS else T.DoubleType()
        fields.append(T.StructField(f, t))
    return T.StructType(fields)


def _rb(x: float, d: int) -> float:
    """Same rounding as functions.columns.round_bin."""
    m = float(10 ** d)
    return math.copysign(1.0, x) * math.floor(abs(x) * m + 0.5) / m if x != 0 else 0.0


def _mom() -> dict:
    return {"n": 0, "s": 0, "q": 0, "mx": None, "mn": None}


def _add(m: dict, x: int) -> None:
    m["n"] += 1
    m["s"] += x
    m["q"] += x * x
    m["mx"] = x if m["mx"] is None else max(m["mx"], x)
    m["mn"] = x if m["mn"] is None else min(m["mn"], x)


def _std(n: int, s: int, q: int) -> float:
    return math.sqrt(float(n * q - s * s)) / n if n >= 2 else 0.0


def _list_stats(m: dict) -> tuple[float, float, float, float, float]:
    n = max(m["n"], 1)
    s, q = m["s"], m["q"]
    return float(s), float(s) / n, _std(n, s, q), float(m["mx"] or 0), float(m["mn"] or 0)


def _new(row) -> dict:
    return {"pid": int(row.packet_id), "first": int(row.ts_us), "last": int(row.ts_us), "seg": int(row.ts_us),
            "lo": bool(row.s_lo), "meta": [row.src_ip, row.dst_ip, int(row.src_port), int(row.dst_port),
                                           int(row.protocol)],
            "fl": _mom(), "bl": _mom(), "al": _mom(), "fi": _mom(), "ffi": _mom(), "bfi": _mom(),
            "act": _mom(), "idl": _mom(), "lastdir": [None, None], "win": [None, None],
            "cnt": {k: 0 for k in ("fwd_psh", "bwd_psh", "fwd_urg", "bwd_urg", "fwd_hdr", "bwd_hdr", "fin", "syn",
                                   "rst", "psh", "ack", "urg", "cwr", "ece", "act_data")}}


def _update(a: dict, row, active_us: int) -> None:
    ts = int(row.ts_us)
    if ts != a["first"] or int(row.packet_id) != a["pid"]:
        g = ts - a["last"]
        _add(a["fi"], g)
        if g > active_us:
            _add(a["idl"], g)
            _add(a["act"], a["last"] - a["seg"])
            a["seg"] = ts
    fwd = bool(row.s_lo) == a["lo"]
    d = 0 if fwd else 1
    if a["lastdir"][d] is not None:
        _add(a["ffi" if fwd else "bfi"], ts - a["lastdir"][d])
    a["lastdir"][d] = ts
    ln = int(row.length)
    _add(a["fl" if fwd else "bl"], ln)
    _add(a["al"], ln)
    c = a["cnt"]
    p = "fwd" if fwd else "bwd"
    c[f"{p}_psh"] += int(bool(row.psh))
    c[f"{p}_urg"] += int(bool(row.urg))
    c[f"{p}_hdr"] += int(row.header_length)
    for f in ("fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece"):
        c[f] += int(bool(getattr(row, f)))
    if fwd and ln > 0:
        c["act_data"] += 1
    if a["win"][d] is None and int(row.window_size) >= 0:
        a["win"][d] = int(row.window_size)
    a["last"] = ts


def features(a: dict) -> dict:
    """The 77 features of an accumulated flow (same formulas as operators.flows)."""
    fl, bl, al, c = a["fl"], a["bl"], a["al"], a["cnt"]
    nf, nb = fl["n"], bl["n"]
    fb, bb = fl["s"], bl["s"]
    du = float(max(a["last"] - a["first"], 1))
    ds = du / 1e6
    mean = lambda m: float(m["s"]) / m["n"] if m["n"] > 0 else 0.0
    fi, ffi, bfi, act, idl = (_list_stats(a[k]) for k in ("fi", "ffi", "bfi", "act", "idl"))
    a_std = _std(al["n"], al["s"], al["q"])
    fm, bm, am = _rb(mean(fl), 4), _rb(mean(bl), 4), _rb(mean(al), 4)
    win = [max(w if w is not None else -1, 0) for w in a["win"]]
    v = {
        "flow_duration": _rb(du, 2), "total_fwd_packets": nf, "total_backward_packets": nb,
        "total_length_fwd_packets": fb, "total_length_bwd_packets": bb,
        "fwd_packet_length_max": fl["mx"] or 0, "fwd_packet_length_min": fl["mn"] or 0,
        "fwd_packet_length_mean": fm, "fwd_packet_length_std": _rb(_std(nf, fb, fl["q"]), 4),
        "bwd_packet_length_max": bl["mx"] or 0, "bwd_packet_length_min": bl["mn"] or 0,
        "bwd_packet_length_mean": bm, "bwd_packet_length_std": _rb(_std(nb, bb, bl["q"]), 4),
        "flow_bytes_s": _rb(float(fb + bb) / ds, 4), "flow_packets_s": _rb(float(nf + nb) / ds, 4),
        "flow_iat_mean": _rb(fi[1] / 1e6, 4), "flow_iat_std": _rb(fi[2] / 1e6, 4),
        "flow_iat_max": fi[3] / 1e6, "flow_iat_min": fi[4] / 1e6,
        "fwd_iat_total": _rb(ffi[0] / 1e6, 4), "fwd_iat_mean": _rb(ffi[1] / 1e6, 4),
        "fwd_iat_std": _rb(ffi[2] / 1e6, 4), "fwd_iat_max": ffi[3] / 1e6, "fwd_iat_min": ffi[4] / 1e6,
        "bwd_iat_total": _rb(bfi[0] / 1e6, 4), "bwd_iat_mean": _rb(bfi[1] / 1e6, 4),
        "bwd_iat_std": _rb(bfi[2] / 1e6, 4), "bwd_iat_max": bfi[3] / 1e6, "bwd_iat_min": bfi[4] / 1e6,
        "fwd_psh_flags": c["fwd_psh"], "bwd_psh_flags": c["bwd_psh"], "fwd_urg_flags": c["fwd_urg"],
        "bwd_urg_flags": c["bwd_urg"], "fwd_header_length": c["fwd_hdr"], "bwd_header_length": c["bwd_hdr"],
        "fwd_packets_s": _rb(float(nf) / ds, 4), "bwd_packets_s": _rb(float(nb) / ds, 4),
        "min_packet_length": al["mn"] or 0, "max_packet_length": al["mx"] or 0,
        "packet_length_mean": am, "packet_length_std": _rb(a_std, 4), "packet_length_variance": _rb(a_std * a_std, 4),
        "fin_flag_count": c["fin"], "syn_flag_count": c["syn"], "rst_flag_count": c["rst"],
        "psh_flag_count": c["psh"], "ack_flag_count": c["ack"], "urg_flag_count": c["urg"],
        "cwe_flag_count": c["cwr"], "ece_flag_count": c["ece"],
        "down_up_ratio": _rb(float(nb) / nf if nf > 0 else 0.0, 4), "average_packet_size": am,
        "avg_fwd_segment_size": fm, "avg_bwd_segment_size": bm, "fwd_header_length_1": c["fwd_hdr"],
        "fwd_avg_bytes_bulk": _rb(float(fb) / max(nf, 1), 4), "fwd_avg_packets_bulk": nf,
        "fwd_avg_bulk_rate": _rb(float(fb) / ds, 4),
        "bwd_avg_bytes_bulk": _rb(float(bb) / max(nb, 1), 4), "bwd_avg_packets_bulk": nb,
        "bwd_avg_bulk_rate": _rb(float(bb) / ds, 4),
        "subflow_fwd_packets": nf, "subflow_fwd_bytes": fb, "subflow_bwd_packets": nb, "subflow_bwd_bytes": bb,
        "init_win_bytes_forward": win[0], "init_win_bytes_backward": win[1],
        "act_data_pkt_fwd": c["act_data"], "min_seg_size_forward": fl["mn"] or 0,
        "active_mean": _rb(act[1], 4), "active_std": _rb(act[2], 4), "active_max": _rb(act[3], 4),
        "active_min": _rb(act[4], 4), "idle_mean": _rb(idl[1], 4), "idle_std": _rb(idl[2], 4),
        "idle_max": _rb(idl[3], 4), "idle_min": _rb(idl[4], 4),
    }
    m = a["meta"]
    return {"flow_id": a["pid"], "src_ip": m[0], "dst_ip": m[1], "src_port": m[2], "dst_port": m[3],
            "protocol": m[4], "first_seen_us": a["first"], "last_seen_us": a["last"], **v}


def _assembler(timeout_us: int, active_us: int):
    cols = [f.name for f in output_schema().fields]

    def step(key, pdfs, state):
        if state.hasTimedOut:
            a = json.loads(state.get[0])
            state.remove()
            yield pd.DataFrame([features(a)], columns=cols)
            return
        a = json.loads(state.get[0]) if state.exists else None
        out = []
        pdf = pd.concat(list(pdfs)).sort_values(["ts_us", "packet_id"])
        for row in pdf.itertuples(index=False):
            if a is not None and int(row.ts_us) - a["last"] > timeout_us:
                out.append(features(a))
                a = None
            if a is None:
                a = _new(row)
            _update(a, row, active_us)
            if bool(row.fin) or bool(row.rst):
                out.append(features(a))
                a = None
        if a is not None and a["last"] // 1000 + timeout_us // 1000 + 1 <= state.getCurrentWatermarkMs():
            out.append(features(a))            # its timeout is already behind the watermark: expired now
            a = None
        if a is None:
            state.remove()
        else:
            state.update((json.dumps(a),))
            state.setTimeoutTimestamp(a["last"] // 1000 + timeout_us // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=cols)
    return step


def stream_flows(packets: DataFrame, timeout_s: float = config.FLOW_TIMEOUT_S,
                 active_timeout_s: float = config.ACTIVE_TIMEOUT_S, watermark: str = "60 seconds") -> DataFrame:
    """Streaming packets -> flow feature rows (append mode)."""
    timeout_us = int(round(timeout_s * 1e6))
    active_us = int(round(active_timeout_s * 1e6))
    p = canonical_key(decode_flags(clean_packets(packets)))
    p = p.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", watermark)
    return p.groupBy(*FLOW_KEY).applyInPandasWithState(
        _assembler(timeout_us, active_us), output_schema(), STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)
