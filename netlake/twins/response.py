"""DuckDB twins of the response and report operators (recursive CTEs for the folds)."""
from __future__ import annotations

from .. import config
from ..fixtures import HONEYPOT_HITS_SQL, PACKETS_SQL, SENSOR_STATUS_SQL, STRIKE_EVENTS_SQL, alert_events_sql
from ..operators.reports import POSTURE_ADVICE, POSTURE_ALL_CLEAR, POSTURE_RATINGS
from .behavior import EV_CTE, PROFILE_PARTS, running_cte
from .dns import dns_cte
from .enrich import THREAT_JSON, geo_cte, geo_json, rep_cte
from .flows import flows_ctes
from .verdict import classified_cte, ensemble_cte

GAP = config.ALERT_COOLDOWN_S * 1_000_000
WL = ", ".join(f"'{x}'" for x in config.DEFAULT_WHITELIST)


def throttle_ctes(src: str) -> str:
    """``src`` has alert_id, label, ts_us (+ source); defines ``emitted`` (needs WITH RECURSIVE)."""
    return f"""
tev AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ts_us, source_rank, alert_id) AS rn FROM {src}),
tnx AS (SELECT a.label, a.rn, (SELECT min(b.rn) FROM tev b WHERE b.label = a.label AND b.ts_us >= a.ts_us + {GAP}) AS nrn
        FROM tev a),
tem(label, rn) AS (
  SELECT label, rn FROM tev WHERE rn = 1
  UNION ALL
  SELECT n.label, n.nrn FROM tem e JOIN tnx n ON n.label = e.label AND n.rn = e.rn WHERE n.nrn IS NOT NULL),
emitted AS (SELECT tev.* FROM tev JOIN tem ON tev.label = tem.label AND tev.rn = tem.rn)"""


THROTTLE_GAPPY_SQL = ("WITH RECURSIVE al AS (SELECT *, 0 AS source_rank FROM (" + alert_events_sql("gappy") + ") t),"
                      + throttle_ctes("al") + "\nSELECT alert_id, label, ts_us FROM emitted")
THROTTLE_DENSE_SQL = ("WITH RECURSIVE al AS (SELECT *, 0 AS source_rank FROM (" + alert_events_sql("dense") + ") t),"
                      + throttle_ctes("al") + "\nSELECT alert_id, label, ts_us FROM emitted")


def strikes_ctes(duration_s: int, threshold: int = config.BLOCK_THRESHOLD, src: str = STRIKE_EVENTS_SQL) -> str:
    """``src`` has event_id, src_ip, ts_us, label; defines ``strikes`` (per event status) and ``blk`` (block intervals); needs WITH RECURSIVE."""
    d = duration_s * 1_000_000
    k = threshold - 1
    return f"""
se AS (SELECT * FROM ({src}) t WHERE src_ip IS NOT NULL AND src_ip NOT IN ({WL})),
sev AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, event_id) AS rn FROM se),
snb AS (
  SELECT a.src_ip, a.rn, b.rn AS brn, b.ts_us AS bts,
    (SELECT min(c.rn) FROM sev c WHERE c.src_ip = a.src_ip AND c.ts_us >= b.ts_us + {d}) AS nrn
  FROM sev a JOIN sev b ON b.src_ip = a.src_ip AND b.rn = a.rn + {k}),
sch(src_ip, rn, brn, bts, nrn) AS (
  SELECT src_ip, rn, brn, bts, nrn FROM snb WHERE rn = 1
  UNION ALL
  SELECT n.src_ip, n.rn, n.brn, n.bts, n.nrn FROM sch JOIN snb n ON n.src_ip = sch.src_ip AND n.rn = sch.nrn),
sst AS (SELECT src_ip, 1 AS s FROM sev GROUP BY src_ip UNION SELECT src_ip, nrn AS s FROM sch WHERE nrn IS NOT NULL),
ses AS (SELECT e.*, (SELECT max(t.s) FROM sst t WHERE t.src_ip = e.src_ip AND t.s <= e.rn) AS st FROM sev e),
sres AS (SELECT ses.*, sch.brn FROM ses LEFT JOIN sch ON sch.src_ip = ses.src_ip AND sch.rn = ses.st),
strikes AS (
  SELECT event_id, src_ip, ts_us, label,
    CASE WHEN brn IS NULL OR rn < brn THEN 'strike' WHEN rn = brn THEN 'blocked' ELSE 'ignored' END AS status,
    CAST(CASE WHEN brn IS NULL OR rn <= brn THEN rn - st + 1 ELSE 0 END AS BIGINT) AS strike_no
  FROM sres),
blk AS (SELECT src_ip AS ip, bts AS blocked_at_us, bts + {d} AS unblocked_at_us FROM sch)"""


STRIKES_SQL = "WITH RECURSIVE " + strikes_ctes(60) + "\nSELECT * FROM strikes"
BLOCKS_SQL = "WITH RECURSIVE " + strikes_ctes(60) + "\nSELECT * FROM blk"
BLOCKED_NOW_SQL = ("WITH RECURSIVE " + strikes_ctes(60) + """,
nw AS (SELECT max(ts_us) AS now_us FROM se)
SELECT ip, blocked_at_us, CAST(greatest(0, trunc((60000000 - (nw.now_us - blocked_at_us)) / 1000000)) AS BIGINT) AS remaining_sec
FROM blk, nw WHERE blocked_at_us <= nw.now_us AND nw.now_us < unblocked_at_us""")


VERDICT_STRIKES = strikes_ctes(60, src="SELECT flow_id AS event_id, src_ip, last_seen_us AS ts_us, label FROM verdicts WHERE is_attack")
_VERDICTS = "WITH RECURSIVE " + flows_ctes() + "," + ensemble_cte(False) + "," + classified_cte("ml", True)
EVENT_BLOCK_STATE_SQL = _VERDICTS + "," + VERDICT_STRIKES + """
SELECT v.flow_id, v.src_ip, v.last_seen_us AS ts_us, v.is_attack, coalesce(s.status, 'none') AS block_status, coalesce(s.strike_no, 0) AS strike_no,
  coalesce(s.status = 'blocked', FALSE) AS auto_blocked,
  EXISTS (SELECT 1 FROM blk WHERE blk.ip = v.src_ip AND blk.blocked_at_us <= v.last_seen_us AND v.last_seen_us < blk.unblocked_at_us) AS source_blocked
FROM verdicts v LEFT JOIN strikes s ON s.event_id = v.flow_id"""

DETECTION_PAYLOAD_SQL = (_VERDICTS + "," + EV_CTE + "," + running_cte() + "," + geo_cte("SELECT DISTINCT src_ip AS ip FROM verdicts") + ","
                         + rep_cte("SELECT flow_id AS event_id, src_ip, last_seen_us AS ts_us FROM verdicts", config.REPUTATION_TTL_S) + "," + VERDICT_STRIKES + f"""
SELECT v.flow_id, strftime(make_timestamp(v.last_seen_us), '%H:%M:%S') AS timestamp, v.src_ip, v.dst_ip, v.dst_port, v.label, v.severity, v.severity_icon, v.confidence,
  v.is_attack, coalesce(s.status = 'blocked', FALSE) AS auto_blocked, v.recommendation, 0.0::DOUBLE AS ae_score,
  {geo_json(["country", "country_code", "city", "lat", "lon", "flag", "is_proxy"])} AS geo, {THREAT_JSON} AS threat,
  CAST(to_json(struct_pack(threat_score := coalesce(r.threat_score, 0.0), risk_level := coalesce(r.risk_level, 'LOW'))) AS VARCHAR) AS behavior
FROM verdicts v LEFT JOIN strikes s ON s.event_id = v.flow_id LEFT JOIN running r ON v.flow_id = r.flow_id
LEFT JOIN geo g ON v.src_ip = g.ip LEFT JOIN rep p ON v.flow_id = p.event_id""")


def service_sql(port: str) -> str:
    parts = " ".join(f"WHEN {k} THEN '{v}'" for k, v in config.PORT_NAMES.items())
    return f"coalesce(CASE {port} {parts} END, 'Port-' || CAST({port} AS VARCHAR))"


HITS = f"hits AS (SELECT *, {service_sql('port')} AS service FROM ({HONEYPOT_HITS_SQL}) t)"
_NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in config.PORT_NAMES.items())
HONEYPOT_BY_SERVICE_SQL = (f"WITH {HITS}\nSELECT CASE port {_NAMES} ELSE CAST(port AS VARCHAR) END AS service, count(*) AS hits, "
                           "(SELECT count(*) FROM hits) AS total_hits FROM hits GROUP BY 1")
HONEYPOT_TOP_SQL = (f"WITH {HITS}\nSELECT src_ip, count(*) AS hits FROM hits GROUP BY src_ip "
                    "ORDER BY hits DESC, src_ip LIMIT 10")
HONEYPOT_RECENT_SQL = f"WITH {HITS}\nSELECT * FROM hits ORDER BY ts_us DESC, hit_id DESC LIMIT 50"
LATEST_PACKETS_SQL = f"SELECT * FROM ({PACKETS_SQL}) t ORDER BY ts_us DESC, packet_id DESC LIMIT 5000"

THROUGHPUT_SQL = f"""WITH pk AS ({PACKETS_SQL}),
d AS (SELECT CAST(floor(ts_us / 2000000) * 2000000 AS BIGINT) AS window_start_us,
        CASE WHEN starts_with(src_ip, '10.') THEN 'out' WHEN starts_with(dst_ip, '10.') THEN 'in' END AS direction, length
      FROM pk)
SELECT window_start_us, direction, round(CAST(sum(length) AS DOUBLE) / 1024.0 / 2.0, 1) AS kb_per_s
FROM d WHERE direction IS NOT NULL GROUP BY window_start_us, direction"""


def union_ctes() -> str:
    """Defines ``alerts`` (U3) on scored verdicts, DNS alerts and honeypot hits."""
    return (flows_ctes() + "," + ensemble_cte(False) + "," + classified_cte("ml", True) + "," + dns_cte() + ","
            + HITS + """,
alerts AS (
  SELECT 'flow' AS source, 0 AS source_rank, flow_id AS alert_id, label, severity, CAST(confidence AS DOUBLE) AS confidence,
    recommendation, src_ip, dst_ip, CAST(dst_port AS VARCHAR) AS dst_port, last_seen_us AS ts_us
  FROM verdicts WHERE is_attack
  UNION ALL
  SELECT 'dns', 1, packet_id, 'DNS Attack (' || attack_type || ')', severity, 1.0::DOUBLE,
    'Inspect DNS query: ' || query || '. Reason: ' || reason, src_ip, query, 'DNS', ts_us
  FROM dns_alerts
  UNION ALL
  SELECT 'honeypot', 2, hit_id, 'Honeypot Probe (' || service || ')', 'CRITICAL', 1.0::DOUBLE,
    printf('Unauthorized access to fake port %d (%s). Block IP immediately.', port, service), src_ip, 'Honeypot',
    CAST(port AS VARCHAR), ts_us
  FROM hits)""")


ALERTS_UNION_SQL = "WITH " + union_ctes() + """
SELECT source, alert_id, label, severity, confidence, recommendation, src_ip, dst_ip, dst_port, ts_us FROM alerts"""
ALERTS_UNION_THROTTLED_SQL = ("WITH RECURSIVE " + union_ctes() + "," + throttle_ctes("alerts")
                              + "\nSELECT source, alert_id, label, ts_us FROM emitted")

ALERT_TEXT_SQL = ("WITH RECURSIVE " + union_ctes() + "," + throttle_ctes("alerts") + "," + VERDICT_STRIKES + ","
                  + geo_cte("SELECT DISTINCT src_ip AS ip FROM emitted") + ","
                  + rep_cte("SELECT source || ':' || alert_id AS event_id, src_ip, ts_us FROM emitted", config.REPUTATION_TTL_S) + """,
x AS (SELECT e.*, CASE e.severity WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡' ELSE '🟢' END AS severity_mark,
    CASE WHEN p.exp_ports = '' THEN 'none known' ELSE replace(p.exp_ports, ',', ', ') END AS open_ports,
    CASE WHEN e.source = 'flow' AND s.status = 'blocked' THEN 'source is blocked' ELSE 'strike counted' END AS mitigation,
    g.country, g.city, g.isp, p.exp_os, p.exp_org, p.rep_abuse_score, p.rep_total_reports
  FROM emitted e JOIN geo g ON g.ip IS NOT DISTINCT FROM e.src_ip JOIN rep p ON p.event_id = e.source || ':' || e.alert_id
  LEFT JOIN strikes s ON e.source = 'flow' AND s.event_id = e.alert_id)
SELECT source, alert_id, label, severity_mark, open_ports, mitigation,
  severity_mark || ' ' || severity || ' ' || label || chr(10) || 'Confidence: ' || round(confidence * 100, 1)::DOUBLE || ' %' || chr(10)
  || 'Source: ' || coalesce(src_ip, '?') || ' in ' || country || ' / ' || city || ' via ' || isp || chr(10) || 'Target: ' || dst_ip || ' port ' || dst_port || chr(10)
  || 'Host: ' || exp_os || ', ' || exp_org || ', open ports ' || open_ports || chr(10) || 'Reputation: ' || rep_abuse_score || ' % from ' || rep_total_reports || ' reports' || chr(10)
  || 'Action: ' || mitigation || chr(10) || 'Advice: ' || recommendation || chr(10) || 'Time: ' || strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S UTC') AS message
FROM x""")

_ratings = " ".join(f"WHEN score >= {lo} THEN '{nm}'" for lo, nm in POSTURE_RATINGS)
_advice = ", ".join(f"CASE WHEN NOT coalesce({c}, FALSE) THEN '{t.replace(chr(39), chr(39) * 2)}' END"
                    for c, t in POSTURE_ADVICE)
POSTURE_SQL = f"""WITH ss AS ({SENSOR_STATUS_SQL}),
sc AS (SELECT *, CAST((CASE WHEN coalesce(ml_ready, FALSE) THEN 20 ELSE 0 END) + (CASE WHEN coalesce(ae_ready, FALSE) THEN 20 ELSE 0 END)
  + (CASE WHEN coalesce(honeypot_active, FALSE) THEN 20 ELSE 0 END) + (CASE WHEN coalesce(auto_block, FALSE) THEN 20 ELSE 0 END)
  + (CASE WHEN coalesce(tg_enabled, FALSE) OR coalesce(email_enabled, FALSE) THEN 20 ELSE 0 END) AS INTEGER) AS score,
  list_filter([{_advice}], lambda x: x IS NOT NULL) AS adv FROM ss)
SELECT sensor_id, score, CASE {_ratings} END AS rating,
  array_to_string(CASE WHEN len(adv) = 0 THEN ['{POSTURE_ALL_CLEAR}'] ELSE adv END, '|') AS recommendations
FROM sc"""

DASHBOARD_SQL = ("WITH RECURSIVE " + flows_ctes() + "," + ensemble_cte(False) + "," + classified_cte("ml", True) + ","
                 + dns_cte() + "," + HITS + "," + strikes_ctes(60) + ","
                 + EV_CTE + PROFILE_PARTS + """
SELECT (SELECT count(*) FROM verdicts) AS total_events, (SELECT count(*) FILTER (WHERE is_attack) FROM verdicts) AS attacks,
  (SELECT count(*) FILTER (WHERE blocked_at_us <= (SELECT max(ts_us) FROM se) AND (SELECT max(ts_us) FROM se) < unblocked_at_us)
   FROM blk) AS blocked_ips,
  (SELECT count(*) FROM hits) AS honeypot_hits, (SELECT count(DISTINCT src_ip) FROM hits) AS honeypot_sources, (SELECT count(DISTINCT port) FROM hits) AS honeypot_ports,
  (SELECT count(*) FROM dns) AS dns_queries, (SELECT count(DISTINCT src_ip) FROM dns) AS dns_sources,
  (SELECT count(attack_type) FROM dns) AS dns_attacks, (SELECT count(*) FROM profiles) AS tracked_ips,
  (SELECT count(*) FILTER (WHERE risk_level = 'CRITICAL') FROM profiles) AS critical_ips, (SELECT count(*) FILTER (WHERE risk_level = 'HIGH') FROM profiles) AS high_ips,
  (SELECT count(*) FILTER (WHERE risk_level = 'MEDIUM') FROM profiles) AS medium_ips, (SELECT count(*) FILTER (WHERE risk_level = 'LOW') FROM profiles) AS low_ips,
  (SELECT '{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}' FROM (
     SELECT label, sum(n)::BIGINT AS n FROM (SELECT label, 1 AS n FROM verdicts UNION ALL SELECT unnest([""" + ", ".join(f"'{x}'" for x in config.ATTACK_LABELS.values()) + """]), 0) u GROUP BY label) t) AS by_type,
  (SELECT count(*) FROM (""" + PACKETS_SQL + """) pk) AS packets_captured, (SELECT least(count(*), 5000) FROM (""" + PACKETS_SQL + """) pk) AS buffered_packets,
  0.0::DOUBLE AS model_accuracy""")
