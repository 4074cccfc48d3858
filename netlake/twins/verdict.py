"""DuckDB twins of the rule / ensemble / verdict operators."""
from __future__ import annotations

from .. import config
from ..fixtures import SCORED_COLS_SQL
from .flows import flows_ctes


def _case_map(expr: str, d: dict, default: str) -> str:
    parts = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in d.items())
    return f"coalesce(CASE {expr} {parts} END, {_q(default)})"


def _q(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


RULE_SQL = """CASE
  WHEN (syn_flag_count > 100 AND CAST(ack_flag_count AS DOUBLE) < CAST(syn_flag_count AS DOUBLE) * 0.1::DOUBLE
        AND flow_duration / 1e6 < 5) OR flow_packets_s > 50000 OR flow_bytes_s > 100000000
       OR (rst_flag_count > 200 AND flow_duration / 1e6 < 10) THEN 'DoS/DDoS'
  WHEN (total_fwd_packets > 20 AND total_backward_packets < 3 AND fwd_packet_length_mean < 100)
       OR (syn_flag_count > 30 AND total_backward_packets < 5) THEN 'PortScan'
  WHEN CAST(total_length_bwd_packets AS DOUBLE) > CAST(total_length_fwd_packets AS DOUBLE) * 15
       AND total_backward_packets > 10 THEN 'Infiltration'
END"""

SEV_SQL = lambda e: _case_map(e, {k: v[0] for k, v in config.SEVERITY.items()}, config.DEFAULT_SEVERITY[0])
ICON_SQL = lambda e: _case_map(e, {k: v[1] for k, v in config.SEVERITY.items()}, config.DEFAULT_SEVERITY[1])
REC_SQL = lambda e: _case_map(e, config.RECOMMENDATIONS, "")
NAME_SQL = lambda e: _case_map(e, config.ATTACK_LABELS, "Unknown")


def ensemble_cte(anomaly: bool, src: str = "flows") -> str:
    """Defines ``scored`` and ``ml`` from ``src``."""
    anom = "(cls = 0 AND iso_np < 0.30::DOUBLE)" if anomaly else "FALSE"
    return f"""
scored AS (SELECT *, {SCORED_COLS_SQL} FROM {src}),
ml0 AS (
  SELECT *, p_top AS xconf, cls AS xc,
    least(greatest((iso_score + 0.7::DOUBLE) / 0.8::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS iso_np
  FROM scored),
ml1 AS (
  SELECT *, 0.7::DOUBLE * xconf + 0.3::DOUBLE * (1.0::DOUBLE - iso_np) AS blended, {anom} AS anomalous FROM ml0),
ml2 AS (
  SELECT *, CASE WHEN anomalous THEN 4 ELSE xc END AS fc0,
    CASE WHEN anomalous THEN blended WHEN xc <> 0 THEN least(greatest(blended, 0.0::DOUBLE), 1.0::DOUBLE)
         ELSE xconf END AS fconf
  FROM ml1),
ml AS (
  SELECT *, CAST(CASE WHEN fconf < 0.55::DOUBLE AND fc0 <> 0 THEN 4 ELSE fc0 END AS INTEGER) AS ml_label_id
  FROM ml2)"""


def classified_cte(src: str, with_model: bool) -> str:
    """Defines ``verdicts`` from ``src`` (needs ml columns when ``with_model``)."""
    if with_model:
        ml = f"{NAME_SQL('ml_label_id')} AS ml_label, round(fconf, 3) AS ml_confidence, (ml_label_id <> 0) AS ml_is_attack"
    else:
        ml = f"'{config.NO_MODEL_LABEL}' AS ml_label, 0.0::DOUBLE AS ml_confidence, FALSE AS ml_is_attack"
    return f"""
vr0 AS (SELECT *, {ml}, {RULE_SQL} AS rule_label FROM {src}),
vr1 AS (
  SELECT *, CASE WHEN rule_label IS NOT NULL AND ml_is_attack THEN rule_label
                 WHEN rule_label IS NOT NULL AND NOT ml_is_attack AND ml_confidence < 0.70::DOUBLE THEN rule_label
                 ELSE ml_label END AS label
  FROM vr0),
verdicts AS (
  SELECT *, {SEV_SQL('label')} AS severity, {ICON_SQL('label')} AS severity_icon, ml_confidence AS confidence,
    (label <> 'Normal') AS is_attack, (rule_label IS NOT NULL) AS rule_triggered,
    {REC_SQL('label')} AS recommendation
  FROM vr1)"""


VERDICT_SELECT = """flow_id, src_ip, dst_ip, src_port, dst_port, protocol, last_seen_us, label, severity,
  severity_icon, confidence, is_attack, rule_triggered, recommendation, ml_label"""

RULE_HITS_SQL = "WITH " + flows_ctes() + f"\nSELECT flow_id, {RULE_SQL} AS rule_label FROM flows"

VERDICTS_NO_MODEL_SQL = ("WITH " + flows_ctes() + "," + classified_cte("flows", False)
                         + f"\nSELECT {VERDICT_SELECT} FROM verdicts")

VERDICTS_SQL = ("WITH " + flows_ctes() + "," + ensemble_cte(False) + "," + classified_cte("ml", True)
                + f"\nSELECT {VERDICT_SELECT} FROM verdicts")

ENSEMBLE_SQL = ("WITH " + flows_ctes() + "," + ensemble_cte(True)
                + f"\nSELECT flow_id, {NAME_SQL('ml_label_id')} AS ml_label, ml_label_id, "
                  "round(fconf, 3) AS ml_confidence, (ml_label_id <> 0) AS ml_is_attack FROM ml")

_names = [config.ATTACK_LABELS[i] for i in range(5)]
ENSEMBLE_SCORES_SQL = ("WITH " + flows_ctes() + "," + ensemble_cte(True) + "\n" + "\nUNION ALL\n".join(
    [f"SELECT flow_id, '{nm}' AS score_name, round(CASE WHEN cls = {i} THEN p_top ELSE p_oth END, 4) AS score FROM ml"
     for i, nm in enumerate(_names)]
    + ["SELECT flow_id, 'Anomaly(IF)' AS score_name, round(1.0::DOUBLE - iso_np, 4) AS score FROM ml"]))

ZERO_DAY_SQL = ("WITH " + flows_ctes() + "," + ensemble_cte(False) + "," + classified_cte("ml", True) + """,
thr AS (SELECT quantile_cont(ae_error, 0.95) AS t FROM scored),
zd AS (SELECT v.*, round(least(ae_error / greatest(thr.t * 2.0::DOUBLE, 1e-9), 1.0::DOUBLE), 4) AS ae_score,
         (ae_error > thr.t) AS is_zero_day FROM verdicts v CROSS JOIN thr)
SELECT flow_id, ae_score, is_zero_day,
  CASE WHEN is_zero_day AND NOT is_attack THEN 'Zero-Day' ELSE label END AS label,
  CASE WHEN is_zero_day AND NOT is_attack THEN 'CRITICAL' ELSE severity END AS severity,
  (is_attack OR is_zero_day) AS is_attack
FROM zd""")

LABEL_STATS_SQL = ("WITH " + flows_ctes() + "," + classified_cte("flows", False) + """,
c AS (SELECT label, count(*) AS events FROM verdicts GROUP BY label),
k AS (SELECT unnest([""" + ", ".join(_q(v) for v in config.ATTACK_LABELS.values()) + """]) AS label)
SELECT coalesce(k.label, c.label) AS label, coalesce(c.events, 0) AS events,
  (SELECT count(*) FROM verdicts) AS total
FROM k FULL OUTER JOIN c ON k.label = c.label""")

RECENT_EVENTS_SQL = ("WITH " + flows_ctes() + "," + classified_cte("flows", False)
                     + f"\nSELECT {VERDICT_SELECT} FROM verdicts ORDER BY last_seen_us DESC, flow_id DESC LIMIT 100")
