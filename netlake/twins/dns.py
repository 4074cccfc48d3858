"""DuckDB twins of the DNS operators (plain per-source windows)."""
from __future__ import annotations

from .. import config
from ..fixtures import DNS_QUERIES_SQL

TLDS = "[" + ", ".join(f"'{t}'" for t in config.COMMON_TLDS) + "]"


def entropy_sql(s: str) -> str:
    chars = f"string_split({s}, '')"
    return (f"CASE WHEN length({s}) > 0 THEN -list_reduce(list_transform({chars}, lambda c: "
            f"log2(len(list_filter({chars}, lambda x: x = c)) / length({s}))), lambda a, t: a + t) / length({s}) "
            f"ELSE 0.0 END")


def dns_cte(window_s: int = config.DNS_WINDOW_S, limit: int = config.DNS_FLOOD_LIMIT,
            tunnel: int = config.DNS_TUNNEL_LEN, cap: int = config.DNS_RATE_CAP) -> str:
    reach = window_s * 1_000_000 + 1
    return f"""
dq0 AS (SELECT packet_id, ts_us, src_ip, rtrim(qname, '.') AS qname FROM ({DNS_QUERIES_SQL}) t WHERE qname IS NOT NULL),
dq1 AS (
  SELECT *, least(row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, packet_id)
           - count(*) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND {reach} PRECEDING),
           {cap}) AS recent,
    list_filter(string_split(lower(rtrim(qname, '.')), '.'), lambda p: NOT list_contains({TLDS}, p) AND length(p) > 2) AS parts,
    length(split_part(qname, '.', 1)) AS sub_len
  FROM dq0),
dq2 AS (SELECT *, CASE WHEN len(parts) > 0 THEN parts[-1] END AS domain_label FROM dq1),
dq3 AS (SELECT *, {entropy_sql('domain_label')} AS ent, length(domain_label) AS ln,
          length(domain_label) - length(translate(domain_label, 'aeiou', '')) AS vowels FROM dq2),
dq4 AS (
  SELECT *, CASE WHEN domain_label IS NULL THEN NULL
    WHEN regexp_matches(domain_label, '^[0-9a-fA-F]{{8,}}$') THEN 'hex-pattern label'
    WHEN ent > 3.8 THEN printf('high entropy (%.2f)', ent)
    WHEN regexp_matches(lower(domain_label), '[^aeiou]{{5,}}') THEN 'consonant cluster'
    WHEN ln >= 25 THEN printf('long label (%d chars)', ln)
    WHEN ln > 6 AND CAST(vowels AS DOUBLE) / ln < 0.15 THEN 'low vowel ratio' END AS dga_reason
  FROM dq3),
dq5 AS (
  SELECT *, recent >= {limit} AS flood, sub_len >= {tunnel} AS tunnel,
    (sub_len < {tunnel} AND length(qname) > 4 AND dga_reason IS NOT NULL) AS dga FROM dq4),
dns AS (
  SELECT *, CASE WHEN flood THEN 'DNS Flood' WHEN tunnel THEN 'DNS Tunneling' WHEN dga THEN 'DGA Domain' END AS attack_type,
    CASE WHEN flood THEN printf('%d queries/%ds', recent, {window_s}) WHEN tunnel THEN printf('subdomain length %d', sub_len)
         WHEN dga THEN dga_reason END AS reason,
    CASE WHEN flood OR tunnel THEN 'HIGH' WHEN dga THEN 'MEDIUM' END AS severity
  FROM dq5),
dns_alerts AS (
  SELECT packet_id, ts_us, attack_type, 'DNS Attack' AS label, src_ip, qname AS query, reason, severity,
    strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') AS timestamp
  FROM dns WHERE attack_type IS NOT NULL)"""


DNS_ENTROPY_SQL = "WITH " + dns_cte() + "\nSELECT packet_id, domain_label, round(" + entropy_sql(
    "coalesce(domain_label, '')") + ", 6) AS entropy FROM dns"
DNS_DGA_SQL = "WITH " + dns_cte() + "\nSELECT packet_id, dga_reason FROM dns"
DNS_RATE_SQL = "WITH " + dns_cte() + "\nSELECT packet_id, src_ip, recent FROM dns"
DNS_ALERTS_SQL = "WITH " + dns_cte() + "\nSELECT * FROM dns_alerts"
DNS_STATS_SQL = ("WITH " + dns_cte() + "\nSELECT count(*) AS total_dns_queries, count(attack_type) AS dns_attacks, "
                 "count(DISTINCT src_ip) AS tracked_ips FROM dns")
DNS_RECENT_SQL = "WITH " + dns_cte() + "\nSELECT * FROM dns_alerts ORDER BY ts_us DESC, packet_id DESC LIMIT 50"
