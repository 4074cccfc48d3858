"""DuckDB twins of the enrichment operators (plain joins, no buckets)."""
from __future__ import annotations

from .. import config
from ..fixtures import ADDRESS_BOOK_SQL, GEO_DIM_SQL, NETWORK_DIM_SQL, PACKETS_SQL, REPUTATION_DIM_SQL
from .behavior import events_cte, running_cte


def scope_sql(ip: str) -> str:
    parts = " ".join(f"WHEN starts_with({ip}, '{p}') THEN '{lab}'" for p, lab in config.PRIVATE_PREFIXES)
    return f"CASE {parts} END"


def rep_private_sql(ip: str) -> str:
    return "(" + " OR ".join(f"starts_with({ip}, '{p}')" for p in config.REPUTATION_PRIVATE) + ")"


def ipn_sql(ip: str) -> str:
    p = [f"CAST(split_part({ip}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    return (f"CASE WHEN regexp_matches({ip}, '^[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}$') "
            f"THEN ((({p[0]}) * 256 + {p[1]}) * 256 + {p[2]}) * 256 + {p[3]} END")


def geo_cte(ips_sql: str) -> str:
    """``ips_sql`` selects one column ``ip``; defines ``geo`` (ip + fields)."""
    return f"""
gdim AS ({GEO_DIM_SQL}),
g0 AS (SELECT ip, {scope_sql('ip')} AS scope, {ipn_sql('ip')} AS ipn FROM ({ips_sql}) t),
gm AS (
  SELECT g0.ip, d.*, row_number() OVER (PARTITION BY g0.ip ORDER BY d.end_ip - d.start_ip, d.start_ip) AS rn
  FROM g0 JOIN gdim d ON g0.ipn BETWEEN d.start_ip AND d.end_ip
  WHERE g0.scope IS NULL AND g0.ip IS NOT NULL AND g0.ip NOT IN ('', '?')),
geo AS (
  SELECT g0.ip,
    CASE WHEN g0.ip IS NULL OR g0.ip IN ('', '?') THEN 'Unknown' WHEN g0.scope IS NOT NULL THEN g0.scope
         WHEN gm.ip IS NOT NULL THEN gm.country ELSE 'Unknown' END AS country,
    CASE WHEN gm.ip IS NOT NULL AND g0.scope IS NULL THEN gm.country_code ELSE 'XX' END AS country_code,
    CASE WHEN gm.ip IS NOT NULL AND g0.scope IS NULL THEN gm.region ELSE '' END AS region,
    CASE WHEN gm.ip IS NOT NULL AND g0.scope IS NULL THEN gm.city ELSE '' END AS city,
    CASE WHEN gm.ip IS NOT NULL AND g0.scope IS NULL THEN gm.lat ELSE 0.0 END AS lat,
    CASE WHEN gm.ip IS NOT NULL AND g0.scope IS NULL THEN gm.lon ELSE 0.0 END AS lon,
    CASE WHEN g0.scope IS NOT NULL THEN 'Local Network' WHEN gm.ip IS NOT NULL THEN gm.isp ELSE '' END AS isp,
    CASE WHEN gm.ip IS NOT NULL AND g0.scope IS NULL THEN gm.org ELSE '' END AS org,
    CASE WHEN gm.ip IS NOT NULL AND g0.scope IS NULL THEN gm.asn ELSE '' END AS asn,
    CASE WHEN gm.ip IS NOT NULL AND g0.scope IS NULL THEN gm.is_proxy ELSE FALSE END AS is_proxy,
    CASE WHEN gm.ip IS NOT NULL AND g0.scope IS NULL THEN gm.is_hosting ELSE FALSE END AS is_hosting,
    (g0.scope IS NOT NULL) AS is_private,
    CASE WHEN gm.ip IS NOT NULL AND g0.scope IS NULL THEN 'https://flagcdn.com/16x12/' || lower(gm.country_code) || '.png'
         ELSE '' END AS flag
  FROM g0 LEFT JOIN gm ON g0.ip = gm.ip AND gm.rn = 1)"""


def rep_cte(events_sql: str, ttl_s: int) -> str:
    """``events_sql``: event_id, src_ip, ts_us; defines ``rep``."""
    ttl = ttl_s * 1_000_000
    return f"""
rdim AS ({REPUTATION_DIM_SQL}),
rev AS ({events_sql}),
rm AS (
  SELECT rev.event_id, r.*, row_number() OVER (PARTITION BY rev.event_id ORDER BY r.fetched_at_us DESC, r.rep_id DESC) AS rn
  FROM rev JOIN rdim r ON r.ip = rev.src_ip AND r.fetched_at_us <= rev.ts_us AND rev.ts_us - r.fetched_at_us < {ttl}
  WHERE rev.src_ip IS NOT NULL AND rev.src_ip NOT IN ('', '?') AND NOT {rep_private_sql('rev.src_ip')}),
rep AS (
  SELECT rev.event_id, rev.src_ip, (rm.event_id IS NOT NULL) AS hit,
    {rep_private_sql('rev.src_ip')} AS priv,
    CAST(CASE WHEN rm.event_id IS NOT NULL THEN rm.abuse_score ELSE 0 END AS INTEGER) AS rep_abuse_score,
    CASE WHEN rm.event_id IS NOT NULL THEN rm.abuse_score > {config.KNOWN_BAD_SCORE} ELSE FALSE END AS rep_is_known_bad,
    CAST(CASE WHEN rm.event_id IS NOT NULL THEN rm.total_reports ELSE 0 END AS INTEGER) AS rep_total_reports,
    CASE WHEN rm.event_id IS NOT NULL THEN rm.country ELSE 'XX' END AS rep_country,
    CASE WHEN rm.event_id IS NOT NULL THEN rm.isp ELSE '' END AS rep_isp,
    CASE WHEN rm.event_id IS NOT NULL THEN rm.domain ELSE '' END AS rep_domain,
    CASE WHEN rev.src_ip IS NULL OR rev.src_ip IN ('', '?') THEN 'unknown' WHEN {rep_private_sql('rev.src_ip')} THEN 'private'
         WHEN rm.event_id IS NOT NULL THEN 'abuseipdb' ELSE 'default' END AS rep_source,
    CASE WHEN rm.event_id IS NOT NULL THEN array_to_string(rm.exp_ports, ',') ELSE '' END AS exp_ports,
    CASE WHEN rm.event_id IS NOT NULL THEN rm.exp_os ELSE 'Unknown OS' END AS exp_os,
    CASE WHEN rm.event_id IS NOT NULL THEN rm.exp_org ELSE 'Unknown Org' END AS exp_org,
    '' AS exp_hostnames,
    CASE WHEN rm.event_id IS NOT NULL THEN rm.exp_ports ELSE [] END AS exp_port_list,
    CASE WHEN rm.event_id IS NOT NULL THEN rm.exp_source WHEN rev.src_ip IS NULL OR rev.src_ip IN ('', '?') THEN 'empty'
         WHEN {rep_private_sql('rev.src_ip')} THEN 'private' ELSE 'not_scanned' END AS exp_source
  FROM rev LEFT JOIN rm ON rev.event_id = rm.event_id AND rm.rn = 1)"""


PK = f"pk AS ({PACKETS_SQL})"

IP_SCOPE_SQL = f"""WITH {PK},
ips AS (SELECT src_ip AS ip FROM pk UNION SELECT dst_ip AS ip FROM pk)
SELECT ip, {scope_sql('ip')} AS scope FROM ips"""

GEO_ENRICHED_SQL = f"WITH {PK}," + geo_cte("SELECT DISTINCT src_ip AS ip FROM pk") + """
SELECT pk.packet_id, pk.src_ip, geo.country AS geo_country, geo.country_code AS geo_country_code,
  geo.region AS geo_region, geo.city AS geo_city, geo.lat AS geo_lat, geo.lon AS geo_lon, geo.isp AS geo_isp,
  geo.org AS geo_org, geo.asn AS geo_asn, geo.is_proxy AS geo_is_proxy, geo.is_hosting AS geo_is_hosting,
  geo.is_private AS geo_is_private, geo.flag AS geo_flag
FROM pk LEFT JOIN geo ON pk.src_ip IS NOT DISTINCT FROM geo.ip"""

GEO_PREFIX_SQL = f"""WITH a AS ({ADDRESS_BOOK_SQL}), d AS ({NETWORK_DIM_SQL}),
m AS (SELECT a.c_custkey, arg_min(d.country, (d.last - d.first, d.first)) AS country FROM a JOIN d ON a.num BETWEEN d.first AND d.last GROUP BY a.c_custkey)
SELECT a.c_custkey, CASE WHEN a.local THEN 'Link-Local' ELSE coalesce(m.country, 'Unknown') END AS country, a.local AS is_private FROM a LEFT JOIN m USING (c_custkey)"""

REPUTATION_SQL = f"WITH {PK}," + rep_cte("SELECT packet_id AS event_id, src_ip, ts_us FROM pk", 300) + """
SELECT event_id AS packet_id, src_ip, rep_abuse_score, rep_is_known_bad, rep_total_reports, rep_country, rep_isp,
  rep_domain, rep_source FROM rep"""

EXPOSURE_SQL = f"WITH {PK}," + rep_cte("SELECT packet_id AS event_id, src_ip, ts_us FROM pk", 300) + """
SELECT event_id AS packet_id, exp_ports, exp_os, exp_org, exp_hostnames, exp_source FROM rep"""

DETECTION_SQL = (events_cte() + "," + running_cte() + ","
                 + geo_cte("SELECT DISTINCT src_ip AS ip FROM verdicts") + ","
                 + rep_cte("SELECT flow_id AS event_id, src_ip, last_seen_us AS ts_us FROM verdicts",
                           config.REPUTATION_TTL_S) + """
SELECT v.flow_id, v.src_ip, v.dst_ip, v.dst_port, v.label, v.severity, v.confidence, v.is_attack,
  coalesce(r.threat_score, 0.0) AS threat_score, coalesce(r.risk_level, 'LOW') AS risk_level,
  g.country AS geo_country, g.is_private AS geo_is_private, p.rep_abuse_score, p.rep_is_known_bad, p.rep_source
FROM verdicts v LEFT JOIN running r ON v.flow_id = r.flow_id
LEFT JOIN geo g ON v.src_ip = g.ip LEFT JOIN rep p ON v.flow_id = p.event_id""")

_GEO_FIELDS = ["country", "country_code", "region", "city", "lat", "lon", "isp", "org", "asn", "is_proxy", "is_hosting", "is_private", "flag"]


def geo_json(fields: list[str]) -> str:
    return "CAST(to_json(struct_pack(" + ", ".join(f"{c} := g.{c}" for c in fields) + ")) AS VARCHAR)"


THREAT_JSON = """CAST(to_json(struct_pack(abuse_score := p.rep_abuse_score, is_known_bad := p.rep_is_known_bad, total_reports := p.rep_total_reports,
    shodan := struct_pack(ports := p.exp_port_list, os := p.exp_os, org := p.exp_org, hostnames := CAST([] AS VARCHAR[]), source := p.exp_source))) AS VARCHAR)"""

EXPORT_SQL = DETECTION_SQL.split("\nSELECT v.flow_id", 1)[0] + f"""
SELECT strftime(make_timestamp(v.last_seen_us), '%Y-%m-%d %H:%M:%S') AS timestamp,
  round(v.last_seen_us / 1e6, 3) AS ts_epoch, v.src_ip, v.dst_ip, v.dst_port, v.label, v.severity, v.confidence,
  v.rule_triggered, v.recommendation, {geo_json(_GEO_FIELDS)} AS geo, {THREAT_JSON} AS threat
FROM verdicts v LEFT JOIN geo g ON v.src_ip = g.ip LEFT JOIN rep p ON v.flow_id = p.event_id"""

EVENT_LOG_SQL = f"SELECT x.*, m.medium FROM ({EXPORT_SQL}) x, (SELECT unnest(['jsonl', 'csv']) AS medium) m"
