"""DuckDB twins of the behaviour-profile operators."""
from __future__ import annotations

from .. import config
from ..fixtures import IDLE_EVENTS_SQL
from .flows import flows_ctes
from .verdict import classified_cte, ensemble_cte


STALE = config.BEHAVIOR_STALE_S * 1_000_000


def ev_cte(src: str = "SELECT flow_id, src_ip, dst_port, label, total_length_fwd_packets, last_seen_us AS ts_us FROM verdicts") -> str:
    """``ev``: behaviour events (P11 applied) with ``life``, how many idle resets came before; ``evl``: those of each source's last life."""
    return f"""
ev0 AS (SELECT * FROM ({src}) t WHERE src_ip IS NOT NULL AND src_ip NOT IN ('', '?', '0.0.0.0')),
ev1 AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, flow_id) > {STALE} THEN 1 ELSE 0 END AS reset FROM ev0),
ev AS (SELECT *, sum(reset) OVER (PARTITION BY src_ip ORDER BY ts_us, flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS life FROM ev1),
evl AS (SELECT * FROM ev QUALIFY life = max(life) OVER (PARTITION BY src_ip))"""


EV_CTE = ev_cte()


def events_cte() -> str:
    """``ev``: scored verdicts as behaviour events (P11 applied)."""
    return "WITH " + flows_ctes() + "," + ensemble_cte(False) + "," + classified_cte("ml", True) + "," + EV_CTE


def score_sql(a: str, n: str, p: str, r: str, s: str) -> str:
    return (f"CASE WHEN {a} + {n} > 0 THEN round((CAST({a} AS DOUBLE) / ({a} + {n})) * 0.45 "
            f"+ least({p} / 50.0::DOUBLE, 1.0::DOUBLE) * 0.25 + least({r} / 100.0::DOUBLE, 1.0::DOUBLE) * 0.20 "
            f"+ least({s} / 5.0::DOUBLE, 1.0::DOUBLE) * 0.10, 17) * 100 ELSE 0.0 END")


def risk_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} >= {lo} THEN '{nm}'" for lo, nm in config.RISK_LEVELS[:-1])
    return f"CASE {parts} ELSE '{config.RISK_LEVELS[-1][1]}' END"


def _score(a, n, p, r, s) -> str:
    total = f"({a} + {n})"
    raw = (f"(CAST({a} AS DOUBLE) / {total}) * 0.45::DOUBLE + least(CAST({p} AS DOUBLE) / 50.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE"
           f" + least(CAST({r} AS DOUBLE) / 100.0::DOUBLE, 1.0::DOUBLE) * 0.20::DOUBLE"
           f" + least(CAST({s} AS DOUBLE) / 5.0::DOUBLE, 1.0::DOUBLE) * 0.10::DOUBLE")
    return f"CASE WHEN {total} > 0 THEN round(({raw}) * 100, 1) ELSE 0.0 END"


W = config.BEHAVIOR_WINDOW_S * 1_000_000
CAP = config.BEHAVIOR_RECENT_CAP

def running_cte() -> str:
    """Needs ``ev``; defines ``running``."""
    sc = _score('attack_count', 'normal_count', 'ports_count', 'recent_events', 'severe_count')
    return f"""
fp AS (SELECT *, CASE WHEN dst_port IS NOT NULL AND dst_port <> 0 AND row_number() OVER (PARTITION BY src_ip, life, dst_port
          ORDER BY ts_us, flow_id) = 1 THEN 1 ELSE 0 END AS first_port FROM ev),
r AS (
  SELECT *,
    sum(CASE WHEN label <> 'Normal' THEN 1 ELSE 0 END) OVER w AS attack_count,
    sum(CASE WHEN label = 'Normal' THEN 1 ELSE 0 END) OVER w AS normal_count,
    sum(CASE WHEN label IN ('Zero-Day', 'DoS/DDoS') THEN 1 ELSE 0 END) OVER w AS severe_count,
    sum(first_port) OVER w AS ports_count,
    least(row_number() OVER (PARTITION BY src_ip, life ORDER BY ts_us, flow_id)
      - count(*) OVER (PARTITION BY src_ip, life ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND {W} PRECEDING), {CAP}) AS recent_events
  FROM fp WINDOW w AS (PARTITION BY src_ip, life ORDER BY ts_us, flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
running AS (
  SELECT flow_id, src_ip, ts_us, CAST(attack_count AS BIGINT) AS attack_count, CAST(normal_count AS BIGINT) AS normal_count,
    CAST(severe_count AS BIGINT) AS severe_count, CAST(ports_count AS BIGINT) AS ports_count, recent_events,
    {sc} AS threat_score, {risk_sql(sc)} AS risk_level
  FROM r)"""


RUNNING_SQL = events_cte() + "," + running_cte() + "\nSELECT * FROM running"

PROFILE_PARTS = f""",
as_of_t AS (SELECT max(ts_us) AS as_of_us FROM ev),
base AS (
  SELECT src_ip, count(*) FILTER (WHERE label <> 'Normal') AS attack_count,
    count(*) FILTER (WHERE label = 'Normal') AS normal_count,
    CAST(coalesce(sum(total_length_fwd_packets), 0) AS BIGINT) AS bytes_total,
    count(DISTINCT CASE WHEN dst_port <> 0 THEN dst_port END) AS ports_count,
    count(*) FILTER (WHERE label IN ('Zero-Day', 'DoS/DDoS')) AS severe_count,
    min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us, (SELECT as_of_us FROM as_of_t) AS as_of_us
  FROM evl GROUP BY src_ip),
rec AS (
  SELECT e.src_ip, least(count(*) FILTER (WHERE e.ts_us > b.last_seen_us - {W}), {CAP}) AS recent_last,
    least(count(*) FILTER (WHERE e.ts_us > b.as_of_us - {W} AND e.ts_us <= b.as_of_us), {CAP}) AS recent_events
  FROM evl e JOIN base b ON e.src_ip = b.src_ip GROUP BY e.src_ip),
profiles AS (
  SELECT b.*, r.recent_events,
    {_score('attack_count', 'normal_count', 'ports_count', 'recent_last', 'severe_count')} AS threat_score,
    {risk_sql(_score('attack_count', 'normal_count', 'ports_count', 'recent_last', 'severe_count'))} AS risk_level
  FROM base b JOIN rec r ON b.src_ip = r.src_ip)"""
PROFILES_CTE = events_cte() + PROFILE_PARTS

PROFILES_SQL = PROFILES_CTE + "\nSELECT * FROM profiles"
TOP_THREATS_SQL = PROFILES_CTE + "\nSELECT * FROM profiles ORDER BY threat_score DESC, src_ip LIMIT 15"
RISK_SQL = PROFILES_CTE + """,
lv AS (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS risk_level),
c AS (SELECT risk_level, count(*) AS ips FROM profiles GROUP BY risk_level)
SELECT lv.risk_level, coalesce(c.ips, 0) AS ips, (SELECT count(*) FROM profiles) AS total_ips_tracked
FROM lv LEFT JOIN c ON lv.risk_level = c.risk_level"""
ACTIVE_SQL = PROFILES_CTE + f"""
SELECT * FROM profiles WHERE last_seen_us >= as_of_us - {config.BEHAVIOR_STALE_S * 1_000_000}
ORDER BY last_seen_us DESC, src_ip LIMIT {config.BEHAVIOR_MAX_IPS}"""
LABEL_COUNTS_SQL = events_cte() + "\nSELECT src_ip, label, count(*) AS events FROM evl GROUP BY src_ip, label"
IDLE_CTE = "WITH " + ev_cte(IDLE_EVENTS_SQL)
RUNNING_IDLE_SQL = IDLE_CTE + "," + running_cte() + "\nSELECT * FROM running"
PROFILES_IDLE_SQL = IDLE_CTE + PROFILE_PARTS + "\nSELECT * FROM profiles"
PROFILE_LOOKUP_SQL = PROFILES_CTE + "\nSELECT * FROM profiles WHERE src_ip = '203.0.113.5'"
