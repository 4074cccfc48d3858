"""DuckDB SQL twins of the flow operators (independent formulation: plain
per-key windows, no time buckets).  Used as the correctness oracle."""
from __future__ import annotations

from .. import config
from ..fixtures import PACKETS_SQL

KEY = "k_ip_a, k_port_a, k_ip_b, k_port_b, protocol"


def assigned_cte(timeout_s: float = config.FLOW_TIMEOUT_S, active_s: float = config.ACTIVE_TIMEOUT_S,
                 packets_sql: str = PACKETS_SQL) -> str:
    t = int(round(timeout_s * 1e6))
    a = int(round(active_s * 1e6))
    return f"""
packets AS ({packets_sql}),
fp0 AS (
  SELECT *, (tcp_flags & 1) <> 0 AS fin, (tcp_flags & 2) <> 0 AS syn, (tcp_flags & 4) <> 0 AS rst,
    (tcp_flags & 8) <> 0 AS psh, (tcp_flags & 16) <> 0 AS ack, (tcp_flags & 32) <> 0 AS urg,
    (tcp_flags & 64) <> 0 AS ece, (tcp_flags & 128) <> 0 AS cwr,
    (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) AS s_lo
  FROM packets
  WHERE ip_version IN (4, 6) AND NOT (starts_with(src_ip, '127.') OR starts_with(dst_ip, '127.'))),
fp1 AS (
  SELECT *, CASE WHEN s_lo THEN src_ip ELSE dst_ip END AS k_ip_a,
    CASE WHEN s_lo THEN src_port ELSE dst_port END AS k_port_a,
    CASE WHEN s_lo THEN dst_ip ELSE src_ip END AS k_ip_b,
    CASE WHEN s_lo THEN dst_port ELSE src_port END AS k_port_b
  FROM fp0),
fp2 AS (
  SELECT *, lag(ts_us) OVER w AS prev_ts, lag(fin OR rst) OVER w AS prev_fr
  FROM fp1 WINDOW w AS (PARTITION BY {KEY} ORDER BY ts_us, packet_id)),
fp3 AS (
  SELECT *, (prev_ts IS NULL OR ts_us - prev_ts > {t} OR prev_fr) AS boundary FROM fp2),
fp4 AS (
  SELECT *, sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY ts_us, packet_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flow_seq FROM fp3),
fp5 AS (
  SELECT *, first_value(packet_id) OVER wf AS flow_id, first_value(s_lo) OVER wf AS first_lo,
    CASE WHEN NOT boundary THEN ts_us - prev_ts END AS flow_iat_us,
    (NOT boundary AND ts_us - prev_ts > {a}) AS act_gap
  FROM fp4 WINDOW wf AS (PARTITION BY {KEY}, flow_seq ORDER BY ts_us, packet_id)),
assigned AS (
  SELECT *, (s_lo = first_lo) AS fwd,
    ts_us - lag(ts_us) OVER (PARTITION BY flow_id, s_lo ORDER BY ts_us, packet_id) AS dir_iat_us,
    CASE WHEN act_gap THEN flow_iat_us END AS idle_us,
    sum(CASE WHEN act_gap THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY ts_us, packet_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg
  FROM fp5)"""


def _mom(p: str, x: str) -> str:
    return (f"count({x}) AS {p}_n, CAST(sum({x}) AS BIGINT) AS {p}_s, "
            f"sum(CAST({x} AS HUGEINT) * CAST({x} AS HUGEINT)) AS {p}_sq, max({x}) AS {p}_max, min({x}) AS {p}_min")


def _std(n: str, s: str, sq: str) -> str:
    return (f"CASE WHEN {n} >= 2 THEN sqrt(CAST(CAST({n} AS HUGEINT) * {sq} - CAST({s} AS HUGEINT) * CAST({s} AS HUGEINT) AS DOUBLE)) / {n} "
            f"ELSE 0.0 END")


def _mean(n: str, s: str) -> str:
    return f"CASE WHEN {n} > 0 THEN CAST({s} AS DOUBLE) / {n} ELSE 0.0 END"


def _list(p: str) -> dict[str, str]:
    n = f"greatest({p}_n, 1)"
    s = f"coalesce({p}_s, 0)"
    sq = f"coalesce({p}_sq, 0)"
    return {"sum": f"CAST({s} AS DOUBLE)", "mean": f"(CAST({s} AS DOUBLE) / {n})", "std": f"({_std(n, s, sq)})",
            "max": f"CAST(coalesce({p}_max, 0) AS DOUBLE)", "min": f"CAST(coalesce({p}_min, 0) AS DOUBLE)"}


def features_cte() -> str:
    """Requires ``assigned``; defines ``flows``."""
    act = """
act_seg AS (SELECT flow_id, seg, max(ts_us) - min(ts_us) AS dur FROM assigned GROUP BY flow_id, seg),
act_last AS (SELECT flow_id, max(seg) AS mx FROM act_seg GROUP BY flow_id),
act_vals AS (SELECT s.flow_id, s.dur FROM act_seg s JOIN act_last m ON s.flow_id = m.flow_id WHERE s.seg < m.mx),
act_agg AS (SELECT flow_id, """ + _mom("act", "dur") + """ FROM act_vals GROUP BY flow_id)"""
    agg = f"""
fagg AS (
  SELECT flow_id, any_value(protocol) AS protocol,
    max(CASE WHEN packet_id = flow_id THEN src_ip END) AS src_ip,
    max(CASE WHEN packet_id = flow_id THEN dst_ip END) AS dst_ip,
    max(CASE WHEN packet_id = flow_id THEN src_port END) AS src_port,
    max(CASE WHEN packet_id = flow_id THEN dst_port END) AS dst_port,
    min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us,
    {_mom('fl', 'CASE WHEN fwd THEN length END')}, {_mom('bl', 'CASE WHEN NOT fwd THEN length END')},
    {_mom('al', 'length')}, {_mom('fi', 'flow_iat_us')},
    {_mom('ffi', 'CASE WHEN fwd THEN dir_iat_us END')}, {_mom('bfi', 'CASE WHEN NOT fwd THEN dir_iat_us END')},
    {_mom('idl', 'idle_us')},
    count(*) FILTER (WHERE fwd AND psh) AS fwd_psh, count(*) FILTER (WHERE NOT fwd AND psh) AS bwd_psh,
    count(*) FILTER (WHERE fwd AND urg) AS fwd_urg, count(*) FILTER (WHERE NOT fwd AND urg) AS bwd_urg,
    CAST(coalesce(sum(header_length) FILTER (WHERE fwd), 0) AS BIGINT) AS fwd_hdr,
    CAST(coalesce(sum(header_length) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS bwd_hdr,
    count(*) FILTER (WHERE fin) AS n_fin, count(*) FILTER (WHERE syn) AS n_syn,
    count(*) FILTER (WHERE rst) AS n_rst, count(*) FILTER (WHERE psh) AS n_psh,
    count(*) FILTER (WHERE ack) AS n_ack, count(*) FILTER (WHERE urg) AS n_urg,
    count(*) FILTER (WHERE cwr) AS n_cwr, count(*) FILTER (WHERE ece) AS n_ece,
    count(*) FILTER (WHERE fwd AND length > 0) AS act_data
  FROM assigned GROUP BY flow_id),
win_first AS (
  SELECT flow_id, fwd, window_size, row_number() OVER (PARTITION BY flow_id, fwd ORDER BY ts_us, packet_id) AS rn
  FROM assigned WHERE window_size >= 0),
win AS (
  SELECT flow_id, max(CASE WHEN fwd THEN window_size END) AS win_f, max(CASE WHEN NOT fwd THEN window_size END) AS win_b
  FROM win_first WHERE rn = 1 GROUP BY flow_id),
fj AS (
  SELECT a.*, w.win_f, w.win_b, coalesce(x.act_n, 0) AS act_n, x.act_s, x.act_sq, x.act_max, x.act_min
  FROM fagg a LEFT JOIN win w ON a.flow_id = w.flow_id LEFT JOIN act_agg x ON a.flow_id = x.flow_id)"""
    fi, ffi, bfi, ac, idl = _list("fi"), _list("ffi"), _list("bfi"), _list("act"), _list("idl")
    fb, bb = "coalesce(fl_s, 0)", "coalesce(bl_s, 0)"
    ds = "(CAST(greatest(last_seen_us - first_seen_us, 1) AS DOUBLE) / 1e6)"
    a_std = _std("al_n", "al_s", "al_sq")

    def per_s(x: str) -> str:
        return f"round(CAST({x} AS DOUBLE) / {ds}, 4)"

    fm, bm, am = (f"round({_mean(p + '_n', p + '_s')}, 4)" for p in ("fl", "bl", "al"))
    feats = {
        "flow_duration": "round(CAST(greatest(last_seen_us - first_seen_us, 1) AS DOUBLE), 2)",
        "total_fwd_packets": "fl_n", "total_backward_packets": "bl_n",
        "total_length_fwd_packets": fb, "total_length_bwd_packets": bb,
        "fwd_packet_length_max": "CAST(coalesce(fl_max, 0) AS INTEGER)",
        "fwd_packet_length_min": "CAST(coalesce(fl_min, 0) AS INTEGER)",
        "fwd_packet_length_mean": fm, "fwd_packet_length_std": f"round({_std('fl_n', 'fl_s', 'fl_sq')}, 4)",
        "bwd_packet_length_max": "CAST(coalesce(bl_max, 0) AS INTEGER)",
        "bwd_packet_length_min": "CAST(coalesce(bl_min, 0) AS INTEGER)",
        "bwd_packet_length_mean": bm, "bwd_packet_length_std": f"round({_std('bl_n', 'bl_s', 'bl_sq')}, 4)",
        "flow_bytes_s": per_s(f"{fb} + {bb}"), "flow_packets_s": per_s("fl_n + bl_n"),
        "flow_iat_mean": f"round({fi['mean']} / 1e6, 4)", "flow_iat_std": f"round({fi['std']} / 1e6, 4)",
        "flow_iat_max": f"{fi['max']} / 1e6", "flow_iat_min": f"{fi['min']} / 1e6",
        "fwd_iat_total": f"round({ffi['sum']} / 1e6, 4)", "fwd_iat_mean": f"round({ffi['mean']} / 1e6, 4)",
        "fwd_iat_std": f"round({ffi['std']} / 1e6, 4)", "fwd_iat_max": f"{ffi['max']} / 1e6",
        "fwd_iat_min": f"{ffi['min']} / 1e6",
        "bwd_iat_total": f"round({bfi['sum']} / 1e6, 4)", "bwd_iat_mean": f"round({bfi['mean']} / 1e6, 4)",
        "bwd_iat_std": f"round({bfi['std']} / 1e6, 4)", "bwd_iat_max": f"{bfi['max']} / 1e6",
        "bwd_iat_min": f"{bfi['min']} / 1e6",
        "fwd_psh_flags": "fwd_psh", "bwd_psh_flags": "bwd_psh", "fwd_urg_flags": "fwd_urg", "bwd_urg_flags": "bwd_urg",
        "fwd_header_length": "fwd_hdr", "bwd_header_length": "bwd_hdr",
        "fwd_packets_s": per_s("fl_n"), "bwd_packets_s": per_s("bl_n"),
        "min_packet_length": "CAST(coalesce(al_min, 0) AS INTEGER)",
        "max_packet_length": "CAST(coalesce(al_max, 0) AS INTEGER)",
        "packet_length_mean": am, "packet_length_std": f"round({a_std}, 4)",
        "packet_length_variance": f"round(({a_std}) * ({a_std}), 4)",
        "fin_flag_count": "n_fin", "syn_flag_count": "n_syn", "rst_flag_count": "n_rst", "psh_flag_count": "n_psh",
        "ack_flag_count": "n_ack", "urg_flag_count": "n_urg", "cwe_flag_count": "n_cwr", "ece_flag_count": "n_ece",
        "down_up_ratio": "round(CASE WHEN fl_n > 0 THEN CAST(bl_n AS DOUBLE) / fl_n ELSE 0.0 END, 4)",
        "average_packet_size": am, "avg_fwd_segment_size": fm, "avg_bwd_segment_size": bm,
        "fwd_header_length_1": "fwd_hdr",
        "fwd_avg_bytes_bulk": f"round(CAST({fb} AS DOUBLE) / greatest(fl_n, 1), 4)",
        "fwd_avg_packets_bulk": "fl_n", "fwd_avg_bulk_rate": per_s(fb),
        "bwd_avg_bytes_bulk": f"round(CAST({bb} AS DOUBLE) / greatest(bl_n, 1), 4)",
        "bwd_avg_packets_bulk": "bl_n", "bwd_avg_bulk_rate": per_s(bb),
        "subflow_fwd_packets": "fl_n", "subflow_fwd_bytes": fb, "subflow_bwd_packets": "bl_n", "subflow_bwd_bytes": bb,
        "init_win_bytes_forward": "CAST(greatest(coalesce(win_f, -1), 0) AS INTEGER)",
        "init_win_bytes_backward": "CAST(greatest(coalesce(win_b, -1), 0) AS INTEGER)",
        "act_data_pkt_fwd": "act_data", "min_seg_size_forward": "CAST(coalesce(fl_min, 0) AS INTEGER)",
        "active_mean": f"round({ac['mean']}, 4)", "active_std": f"round({ac['std']}, 4)",
        "active_max": f"round({ac['max']}, 4)", "active_min": f"round({ac['min']}, 4)",
        "idle_mean": f"round({idl['mean']}, 4)", "idle_std": f"round({idl['std']}, 4)",
        "idle_max": f"round({idl['max']}, 4)", "idle_min": f"round({idl['min']}, 4)",
    }
    assert list(feats) == config.FEATURE_NAMES
    cols = ",\n    ".join(f"{v} AS {k}" for k, v in feats.items())
    return act + "," + agg + f""",
flows AS (
  SELECT flow_id, src_ip, dst_ip, src_port, dst_port, protocol, first_seen_us, last_seen_us,
    {cols}
  FROM fj)"""


def flows_ctes(timeout_s: float = config.FLOW_TIMEOUT_S, active_s: float = config.ACTIVE_TIMEOUT_S) -> str:
    """``WITH``-less CTE list ending in ``flows``."""
    return assigned_cte(timeout_s, active_s) + "," + features_cte()


FLOW_ASSIGNMENT_SQL = "WITH " + assigned_cte() + """
SELECT packet_id, flow_id, fwd, boundary FROM assigned"""

FLOW_IAT_SQL = "WITH " + assigned_cte() + """
SELECT packet_id, flow_id, CAST(flow_iat_us AS DOUBLE) AS flow_iat_us, CAST(dir_iat_us AS DOUBLE) AS dir_iat_us FROM assigned"""

FLOW_ACTIVE_IDLE_SQL = "WITH " + assigned_cte() + """,
act_seg AS (SELECT flow_id, seg, min(ts_us) AS seg_start, max(ts_us) - min(ts_us) AS dur FROM assigned GROUP BY flow_id, seg)
SELECT a.packet_id, a.flow_id, a.idle_us, s.dur AS active_us
FROM assigned a JOIN act_seg s ON a.flow_id = s.flow_id AND s.seg = a.seg - 1
WHERE a.idle_us IS NOT NULL"""

FLOW_FEATURES_SQL = "WITH " + flows_ctes() + "\nSELECT * FROM flows"
