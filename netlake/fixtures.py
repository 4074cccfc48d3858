"""Network-shaped inputs derived deterministically from the driver's tables.

Each derivation exists twice: as a Spark DataFrame (what the engine runs on)
and as DuckDB SQL text (what the oracle runs on), built from the same
expressions so both sides see the same rows.  See FIXTURES.md.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config

GEO_BASE_IP = 203 * 16777216 + 113 * 256          # 203.0.113.0 as a number


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _raw_us() -> Column:
    return F.expr("unix_micros(cast(ts as timestamp))")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _flags_int(tcp, fin, syn, rst, psh, ack, urg, ece, cwr) -> Column:
    bits = [fin, syn, rst, psh, ack, urg, ece, cwr]
    total = F.lit(0)
    for (_, mask), b in zip(config.TCP_FLAG_BITS, bits):
        total = total + F.when(tcp & b, F.lit(mask)).otherwise(F.lit(0))
    return total.cast("int")


# ---------------------------------------------------------------- packets
def packets(spark: SparkSession, sf_dir: str, with_loopback: bool = False) -> DataFrame:
    """FIXTURES table 1: one packet per event (PACKET_SCHEMA)."""
    e = _events(spark, sf_dir).select(
        "event_id", "user_id", "event_type", "value",
        F.expr("unix_micros(cast(ts as timestamp)) div 4000").alias("ts_us"),
        _k().alias("k"))
    uid, eid, et = F.col("user_id"), F.col("event_id"), F.col("event_type")
    is_rev = ((uid % 7) != 0) & ((eid % 3) == 0)
    c_ip = F.concat(F.when(uid % 5 == 0, F.lit("203.0.113.")).otherwise(F.lit("10.0.0.")),
                    (uid % 250).cast("string"))
    s_ip = F.concat(F.lit("198.51.100."), (uid % 20).cast("string"))
    c_port = (F.lit(40000) + uid % 1000).cast("int")
    s_port = (F.when(uid % 6 == 0, 80).when(uid % 6 == 1, 443).when(uid % 6 == 2, 22)
              .when(uid % 6 == 3, 53).when(uid % 6 == 4, 3389).otherwise(8080)).cast("int")
    proto = F.when(uid % 6 == 3, 17).otherwise(6).cast("int")
    tcp = proto == 6
    k = F.col("k")
    length = (F.when(uid % 7 == 0, F.lit(40) + eid % 50)
              .when(uid % 11 == 0, F.when(eid % 3 == 0, 1400).otherwise(60))
              .otherwise(F.lit(40) + F.floor(F.col("value") * 2))).cast("int")
    window = F.when(tcp, F.when(eid % 10 == 0, F.lit(-1)).otherwise((eid * 37) % 65536)).otherwise(F.lit(-1)).cast("int")
    fin = (et == "purchase") & (k < 20) & ((uid % 7) != 0)
    syn = et == "signup"
    rst = (et == "error") & (k < 10) & ((uid % 7) != 0)
    ack = et != "signup"
    psh = et.isin("click", "purchase")
    flags = _flags_int(tcp, fin, syn, rst, psh, ack, k == 1, k == 2, k == 3)
    p = e.select(
        eid.alias("packet_id"), F.col("ts_us"),
        F.when(is_rev, s_ip).otherwise(c_ip).alias("src_ip"),
        F.when(is_rev, c_ip).otherwise(s_ip).alias("dst_ip"),
        F.when(is_rev, s_port).otherwise(c_port).alias("src_port"),
        F.when(is_rev, c_port).otherwise(s_port).alias("dst_port"),
        proto.alias("protocol"), length.alias("length"),
        F.when(tcp, 40).otherwise(28).cast("int").alias("header_length"),
        window.alias("window_size"), flags.alias("tcp_flags"),
        F.lit(4).cast("int").alias("ip_version"))
    if with_loopback:
        extra = (p.filter(F.col("packet_id") % 1000 == 999)
                 .withColumn("packet_id", F.col("packet_id") + F.lit(1_000_000_000_000))
                 .withColumn("src_ip", F.lit("127.0.0.1")))
        p = p.unionByName(extra)
    return p


PACKETS_SQL = """
SELECT event_id AS packet_id, ts_us,
  CASE WHEN is_rev THEN s_ip ELSE c_ip END AS src_ip,
  CASE WHEN is_rev THEN c_ip ELSE s_ip END AS dst_ip,
  CASE WHEN is_rev THEN s_port ELSE c_port END AS src_port,
  CASE WHEN is_rev THEN c_port ELSE s_port END AS dst_port,
  protocol,
  CAST(CASE WHEN user_id % 7 = 0 THEN 40 + event_id % 50
            WHEN user_id % 11 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 1400 ELSE 60 END
            ELSE 40 + floor(value * 2) END AS INTEGER) AS length,
  CAST(CASE WHEN protocol = 6 THEN 40 ELSE 28 END AS INTEGER) AS header_length,
  CAST(CASE WHEN protocol = 6 THEN CASE WHEN event_id % 10 = 0 THEN -1 ELSE (event_id * 37) % 65536 END
            ELSE -1 END AS INTEGER) AS window_size,
  CAST(CASE WHEN protocol = 6 AND event_type = 'purchase' AND k < 20 AND user_id % 7 <> 0 THEN 1 ELSE 0 END
     + CASE WHEN protocol = 6 AND event_type = 'signup' THEN 2 ELSE 0 END
     + CASE WHEN protocol = 6 AND event_type = 'error' AND k < 10 AND user_id % 7 <> 0 THEN 4 ELSE 0 END
     + CASE WHEN protocol = 6 AND event_type IN ('click', 'purchase') THEN 8 ELSE 0 END
     + CASE WHEN protocol = 6 AND event_type <> 'signup' THEN 16 ELSE 0 END
     + CASE WHEN protocol = 6 AND k = 1 THEN 32 ELSE 0 END
     + CASE WHEN protocol = 6 AND k = 2 THEN 64 ELSE 0 END
     + CASE WHEN protocol = 6 AND k = 3 THEN 128 ELSE 0 END AS INTEGER) AS tcp_flags,
  CAST(4 AS INTEGER) AS ip_version
FROM (
  SELECT event_id, user_id, event_type, value,
    epoch_us(ts) // 4000 AS ts_us,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    (user_id % 7 <> 0 AND event_id % 3 = 0) AS is_rev,
    CASE WHEN user_id % 5 = 0 THEN '203.0.113.' ELSE '10.0.0.' END || CAST(user_id % 250 AS VARCHAR) AS c_ip,
    '198.51.100.' || CAST(user_id % 20 AS VARCHAR) AS s_ip,
    CAST(40000 + user_id % 1000 AS INTEGER) AS c_port,
    CAST(CASE user_id % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 53
                          WHEN 4 THEN 3389 ELSE 8080 END AS INTEGER) AS s_port,
    CAST(CASE WHEN user_id % 6 = 3 THEN 17 ELSE 6 END AS INTEGER) AS protocol
  FROM events) e
"""

PACKETS_LOOPBACK_SQL = f"""
SELECT * FROM ({PACKETS_SQL}) p0
UNION ALL
SELECT packet_id + 1000000000000 AS packet_id, ts_us, '127.0.0.1' AS src_ip, dst_ip, src_port, dst_port,
       protocol, length, header_length, window_size, tcp_flags, ip_version
FROM ({PACKETS_SQL}) p1 WHERE packet_id % 1000 = 999
"""


# ---------------------------------------------------------------- DNS queries
_ALPHA2 = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz"


def dns_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES table 3: one DNS question per event."""
    e = _events(spark, sf_dir)
    eid = F.col("event_id")
    m = F.md5(eid.cast("string"))
    sel = eid % 8
    qname = (F.when(sel == 0, F.concat(F.substring(m, 1, 12), F.lit(".com")))
             .when(sel == 1, F.concat(m, F.substring(F.md5(F.concat(F.lit("x"), eid.cast("string"))), 1, 20),
                                      F.lit(".example.net")))
             .when(sel == 2, F.concat(F.translate(F.substring(m, 1, 12), "0123456789abcdef", "bcdfghjklmnpqrst"),
                                      F.lit(".net")))
             .when(sel == 3, F.lit("www.example.com"))
             .when(sel == 4, F.lit("bananabananabananabananabanana.org"))
             .when(sel == 5, F.concat(F.expr(f"substring('{_ALPHA2}', cast(1 + event_id % 26 as int), 20)"),
                                      F.lit(".io")))
             .when(sel == 6, F.lit("mnprampnr.org"))
             .otherwise(F.lit("a.io")))
    return e.select(eid.alias("packet_id"),
                    F.expr("unix_micros(cast(ts as timestamp)) div 4000").alias("ts_us"),
                    F.concat(F.lit("10.0.0."), (F.col("user_id") % 5).cast("string")).alias("src_ip"),
                    qname.alias("qname"))


DNS_QUERIES_SQL = f"""
SELECT event_id AS packet_id, epoch_us(ts) // 4000 AS ts_us,
  '10.0.0.' || CAST(user_id % 5 AS VARCHAR) AS src_ip,
  CASE event_id % 8
    WHEN 0 THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 12) || '.com'
    WHEN 1 THEN md5(CAST(event_id AS VARCHAR)) || substr(md5('x' || CAST(event_id AS VARCHAR)), 1, 20) || '.example.net'
    WHEN 2 THEN translate(substr(md5(CAST(event_id AS VARCHAR)), 1, 12), '0123456789abcdef', 'bcdfghjklmnpqrst') || '.net'
    WHEN 3 THEN 'www.example.com'
    WHEN 4 THEN 'bananabananabananabananabanana.org'
    WHEN 5 THEN substr('{_ALPHA2}', CAST(1 + event_id % 26 AS INTEGER), 20) || '.io'
    WHEN 6 THEN 'mnprampnr.org'
    ELSE 'a.io' END AS qname
FROM events
"""


# ---------------------------------------------------------------- honeypot hits
HIT_PORTS = [21, 22, 23, 3389, 8080, 1433, 3306, 9999]


def honeypot_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES table 5: one hit per signup event."""
    e = _events(spark, sf_dir).filter(F.col("event_type") == "signup")
    eid, uid = F.col("event_id"), F.col("user_id")
    port = F.element_at(F.array(*[F.lit(p) for p in HIT_PORTS]), (eid % 8 + 1).cast("int"))
    return e.select(eid.alias("hit_id"),
                    F.concat(F.lit("203.0.113."), (uid % 250).cast("string")).alias("src_ip"),
                    (F.lit(40000) + uid % 1000).cast("int").alias("src_port"),
                    port.cast("int").alias("port"),
                    F.substring(F.col("props"), 1, 300).alias("data"),
                    F.expr("unix_micros(cast(ts as timestamp)) div 4000").alias("ts_us"))


HONEYPOT_HITS_SQL = f"""
SELECT event_id AS hit_id, '203.0.113.' || CAST(user_id % 250 AS VARCHAR) AS src_ip,
  CAST(40000 + user_id % 1000 AS INTEGER) AS src_port,
  CAST(({[*HIT_PORTS]})[CAST(event_id % 8 + 1 AS INTEGER)] AS INTEGER) AS port,
  substr(props, 1, 300) AS data, epoch_us(ts) // 4000 AS ts_us
FROM events WHERE event_type = 'signup'
"""


# ---------------------------------------------------------------- geo dimension
def geo_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES table 6: one /28-ish range per nation inside 203.0.113.0/24."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nk = F.col("n_nationkey")
    start = F.lit(GEO_BASE_IP).cast("long") + nk.cast("long") * 10
    return n.select(start.alias("start_ip"), (start + 9).alias("end_ip"),
                    F.col("n_name").alias("country"),
                    F.upper(F.substring("n_name", 1, 2)).alias("country_code"),
                    F.lit("").alias("region"), F.lit("").alias("city"),
                    (nk.cast("double") * 1.5).alias("lat"), (nk.cast("double") * -2.5).alias("lon"),
                    F.concat(F.lit("ISP "), F.col("n_name")).alias("isp"),
                    F.concat(F.lit("Org "), F.col("n_name")).alias("org"),
                    F.concat(F.lit("AS"), (F.lit(64500) + nk).cast("string")).alias("asn"),
                    (nk % 7 == 0).alias("is_proxy"), (nk % 5 == 0).alias("is_hosting"))


GEO_DIM_SQL = f"""
SELECT CAST({GEO_BASE_IP} AS BIGINT) + CAST(n_nationkey AS BIGINT) * 10 AS start_ip,
  CAST({GEO_BASE_IP} AS BIGINT) + CAST(n_nationkey AS BIGINT) * 10 + 9 AS end_ip,
  n_name AS country, upper(substr(n_name, 1, 2)) AS country_code, '' AS region, '' AS city,
  CAST(n_nationkey AS DOUBLE) * 1.5 AS lat, CAST(n_nationkey AS DOUBLE) * -2.5 AS lon,
  'ISP ' || n_name AS isp, 'Org ' || n_name AS org, 'AS' || CAST(64500 + n_nationkey AS VARCHAR) AS asn,
  (n_nationkey % 7 = 0) AS is_proxy, (n_nationkey % 5 = 0) AS is_hosting
FROM nation
"""


# ---------------------------------------------------------------- addresses of both families and their networks
def address_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES table 13: an address per customer, IPv6 in several spellings, IPv4, mapped IPv4 and junk."""
    n = F.col("c_custkey").cast("long")
    net, sub, host = (n % 25).cast("int"), F.element_at(F.array(F.lit(0), F.lit(1), F.lit(32768)), (n % 3 + 1).cast("int")), (n * 7919 % 65536).cast("int")
    v4 = F.concat(F.lit("203.0.113."), (n % 256).cast("string"))
    junk = F.element_at(F.array(F.lit(""), F.lit("?"), F.lit(None).cast("string"), F.format_string("fe80::%x", host), F.format_string("host-%d", n)), (n % 5 + 1).cast("int"))
    ip = (F.when(n % 6 == 0, F.format_string("2001:0DB8:%04X:%04X:0000:0000:0000:%04X", net, sub, host))
          .when(n % 6 == 1, F.format_string("2001:db8:%x:%x:0:0:0:%x", net, sub, host))
          .when(n % 6 == 2, F.format_string("2001:db8:%x:%x::%x", net, sub, host))
          .when(n % 6 == 3, v4).when(n % 6 == 4, F.concat(F.lit("::ffff:"), v4)).otherwise(junk))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", ip.alias("ip"))


#: The numbers come from the keys, not from the texts that the operator parses.
ADDRESS_BOOK_SQL = f"""
SELECT c_custkey, CASE WHEN n % 6 < 3 THEN base + net::HUGEINT * 1208925819614629174706176 + sub::HUGEINT * 18446744073709551616 + host
    WHEN n % 6 < 5 THEN 281470681743360::HUGEINT + {GEO_BASE_IP} + n % 256 END AS num,
  n % 6 = 5 AND n % 5 = 3 AS local
FROM (SELECT c_custkey, c_custkey::BIGINT AS n, c_custkey % 25 AS net, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 32768 END AS sub, c_custkey::BIGINT * 7919 % 65536 AS host,
        42540766411282592856903984951653826560::HUGEINT AS base FROM customer) t
"""


def network_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES table 14: nested IPv6 networks (/32, /48, /49, /64) and IPv4 ranges that do not start at powers of two."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nk, name = F.col("n_nationkey").cast("int"), F.col("n_name")
    nets = F.array(F.when(nk == 0, F.struct(F.lit("2001:db8::/32").alias("network"), F.lit("Registry").alias("country"))),
                   F.when(nk < 20, F.struct(F.format_string("2001:DB8:%x::/48", nk).alias("network"), name.alias("country"))),
                   F.when(nk % 3 == 0, F.struct(F.format_string("2001:db8:%x:8000::/49", nk).alias("network"), F.concat(name, F.lit(" upper")).alias("country"))),
                   F.when(nk % 2 == 0, F.struct(F.format_string("2001:0db8:%04x:0001::/64", nk).alias("network"), F.concat(name, F.lit(" lan")).alias("country"))))
    v6 = n.select(F.explode(F.filter(nets, lambda x: x.isNotNull())).alias("x")).select("x.network", F.lit(None).cast("long").alias("start_ip"), F.lit(None).cast("long").alias("end_ip"), "x.country")
    v4 = n.select(F.lit(None).cast("string").alias("network"), (F.lit(GEO_BASE_IP).cast("long") + nk * 10 + 3).alias("start_ip"), (F.lit(GEO_BASE_IP).cast("long") + nk * 10 + 17).alias("end_ip"), name.alias("country"))
    zero = {"country_code": "XX", "region": "", "city": "", "isp": "", "org": "", "asn": ""}
    both = v6.unionByName(v4).select("*", *[F.lit(v).alias(k) for k, v in zero.items()], F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    return both.withColumn("is_proxy", F.lit(False)).withColumn("is_hosting", F.lit(False))


NETWORK_DIM_SQL = f"""
SELECT base AS first, base + 79228162514264337593543950335 AS last, 'Registry' AS country FROM (SELECT 42540766411282592856903984951653826560::HUGEINT AS base) t
UNION ALL
SELECT lo, lo + 1208925819614629174706175, n_name FROM (SELECT 42540766411282592856903984951653826560::HUGEINT + n_nationkey::HUGEINT * 1208925819614629174706176 AS lo, * FROM nation) t WHERE n_nationkey < 20
UNION ALL
SELECT lo + 604462909807314587353088, lo + 1208925819614629174706175, n_name || ' upper' FROM (SELECT 42540766411282592856903984951653826560::HUGEINT + n_nationkey::HUGEINT * 1208925819614629174706176 AS lo, * FROM nation) t WHERE n_nationkey % 3 = 0
UNION ALL
SELECT lo + 18446744073709551616, lo + 36893488147419103231, n_name || ' lan' FROM (SELECT 42540766411282592856903984951653826560::HUGEINT + n_nationkey::HUGEINT * 1208925819614629174706176 AS lo, * FROM nation) t WHERE n_nationkey % 2 = 0
UNION ALL
SELECT 281470681743360::HUGEINT + {GEO_BASE_IP} + n_nationkey * 10 + 3, 281470681743360::HUGEINT + {GEO_BASE_IP} + n_nationkey * 10 + 17, n_name FROM nation
"""


# ---------------------------------------------------------------- reputation dimension
def reputation_dim(spark: SparkSession, sf_dir: str, base_ts_us: int | None = None) -> DataFrame:
    """FIXTURES table 7: reputation records with a fetch time (as-of join input)."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    if base_ts_us is None:
        base = (_events(spark, sf_dir)
                .agg(F.min(F.expr("unix_micros(cast(ts as timestamp)) div 4000")).alias("base_us")))
        s = s.crossJoin(F.broadcast(base))     # one-row aggregate: size is fixed at 1
        base_col = F.col("base_us")
    else:
        base_col = F.lit(base_ts_us)
    sk = F.col("s_suppkey")
    return s.select(
        sk.alias("rep_id"),
        F.concat(F.lit("203.0.113."), (sk % 150).cast("string")).alias("ip"),
        (base_col + ((sk * 7) % 600) * F.lit(1_000_000)).cast("long").alias("fetched_at_us"),
        (sk % 101).cast("int").alias("abuse_score"),
        (sk % 13).cast("int").alias("total_reports"),
        F.lit("XX").alias("country"), F.col("s_name").alias("isp"), F.lit("").alias("domain"),
        F.struct(F.array(F.lit(22), (sk % 1000).cast("int")).alias("ports"),
                 F.lit("Linux").alias("os"), F.col("s_name").alias("org"),
                 F.array().cast("array<string>").alias("hostnames"),
                 F.when(sk % 4 == 0, F.lit("not_scanned")).otherwise(F.lit("shodan")).alias("source")
                 ).alias("exposure"))


REPUTATION_DIM_SQL = """
SELECT s_suppkey AS rep_id, '203.0.113.' || CAST(s_suppkey % 150 AS VARCHAR) AS ip,
  CAST((SELECT min(epoch_us(ts) // 4000) FROM events) + ((s_suppkey * 7) % 600) * 1000000 AS BIGINT) AS fetched_at_us,
  CAST(s_suppkey % 101 AS INTEGER) AS abuse_score, CAST(s_suppkey % 13 AS INTEGER) AS total_reports,
  'XX' AS country, s_name AS isp, '' AS domain,
  [22, CAST(s_suppkey % 1000 AS INTEGER)] AS exp_ports, 'Linux' AS exp_os, s_name AS exp_org,
  CASE WHEN s_suppkey % 4 = 0 THEN 'not_scanned' ELSE 'shodan' END AS exp_source
FROM supplier
"""


# ---------------------------------------------------------------- sensor status
SENSOR_FLAGS = ["ml_ready", "ae_ready", "honeypot_active", "auto_block",
                "tg_enabled", "email_enabled", "intel_active"]


def sensor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES table 10: bit i of s_suppkey is the i-th posture flag."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    sk = F.col("s_suppkey")
    return s.select(sk.alias("sensor_id"),
                    *[(F.shiftright(sk, i) % 2 == 1).alias(n) for i, n in enumerate(SENSOR_FLAGS)])


SENSOR_STATUS_SQL = "SELECT s_suppkey AS sensor_id, " + ", ".join(
    f"((s_suppkey >> {i}) % 2 = 1) AS {n}" for i, n in enumerate(SENSOR_FLAGS)) + " FROM supplier"


# ---------------------------------------------------------------- alert / strike inputs
def alert_events(spark: SparkSession, sf_dir: str, variant: str = "gappy") -> DataFrame:
    """FIXTURES table 11: events typed by event_type, as throttle input."""
    e = _events(spark, sf_dir)
    # gappy: every minute of event time is followed by 45 s of silence
    div = 1200 if variant == "gappy" else 4000
    gap = " + (unix_micros(cast(ts as timestamp)) div 1200 div 60000000) * 45000000" if variant == "gappy" else ""
    return e.select(F.col("event_id").alias("alert_id"), F.col("event_type").alias("label"),
                    F.expr(f"unix_micros(cast(ts as timestamp)) div {div}{gap}").alias("ts_us"),
                    F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("src_ip"))


def alert_events_sql(variant: str = "gappy") -> str:
    if variant == "gappy":
        return ("SELECT event_id AS alert_id, event_type AS label, epoch_us(ts) // 1200 + (epoch_us(ts) // 1200 // 60000000) * 45000000 AS ts_us, "
                "'10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS src_ip FROM events")
    return ("SELECT event_id AS alert_id, event_type AS label, epoch_us(ts) // 4000 AS ts_us, "
            "'10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS src_ip FROM events")


def _uid_ip(uid: Column) -> Column:
    return F.concat_ws(".", F.lit("10"), (F.floor(uid / 65536) % 256).cast("string"),
                       (F.floor(uid / 256) % 256).cast("string"), (uid % 256).cast("string"))


def strike_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES table 11: one attack strike per `error` event, keyed by user."""
    e = _events(spark, sf_dir).filter(F.col("event_type") == "error")
    return e.select(F.col("event_id").alias("event_id"), _uid_ip(F.col("user_id")).alias("src_ip"),
                    F.expr("unix_micros(cast(ts as timestamp)) div 4000").alias("ts_us"),
                    F.lit("DoS/DDoS").alias("label"))


STRIKE_EVENTS_SQL = """
SELECT event_id, '10.' || CAST((user_id // 65536) % 256 AS VARCHAR) || '.' || CAST((user_id // 256) % 256 AS VARCHAR)
  || '.' || CAST(user_id % 256 AS VARCHAR) AS src_ip, epoch_us(ts) // 4000 AS ts_us, 'DoS/DDoS' AS label
FROM events WHERE event_type = 'error'
"""


# ---------------------------------------------------------------- scored flows
N_CLASSES = 5


def scored_flows(flows: DataFrame) -> DataFrame:
    """FIXTURES table 8: fixture model outputs keyed on the flow's first packet id."""
    h = F.col("flow_id")
    cls = (h % N_CLASSES).cast("int")
    p_top = F.lit(0.4) + (h % 60).cast("double") / F.lit(100.0)
    p_oth = (F.lit(1.0) - p_top) / F.lit(4.0)
    prob = F.array(*[F.when(cls == i, p_top).otherwise(p_oth) for i in range(N_CLASSES)])
    return flows.select("*", prob.alias("probability"),
                        (F.lit(-0.7) + (h % 81).cast("double") / F.lit(100.0)).alias("iso_score"),
                        ((h % 1000).cast("double") / F.lit(1000.0)).alias("ae_error"))


SCORED_COLS_SQL = """CAST(flow_id % 5 AS INTEGER) AS cls,
  0.4::DOUBLE + CAST(flow_id % 60 AS DOUBLE) / 100.0::DOUBLE AS p_top,
  (1.0::DOUBLE - (0.4::DOUBLE + CAST(flow_id % 60 AS DOUBLE) / 100.0::DOUBLE)) / 4.0::DOUBLE AS p_oth,
  -0.7::DOUBLE + CAST(flow_id % 81 AS DOUBLE) / 100.0::DOUBLE AS iso_score,
  CAST(flow_id % 1000 AS DOUBLE) / 1000.0::DOUBLE AS ae_error"""


# ---------------------------------------------------------------- labelled flow CSV
CSV_LABELS = ["BENIGN", "DoS Hulk", "DDoS", "PortScan", "FTP-Patator", "Bot",
              "Web Attack – XSS", " BENIGN ", "Web Attack � XSS"]


def flow_csv_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES table 4: raw labelled-flow rows (text cells, dataset header quirks)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    sel = (ok + ln) % 50
    return li.select(
        (ok % 2).alias("_file"),
        (F.col("l_quantity") * 1000).cast("string").alias(" Flow Duration"),
        ln.cast("string").alias(" Total Fwd Packets"),
        F.when(ok % 4 == 0, F.lit("-1")).otherwise((F.col("l_partkey") % 65536).cast("string"))
        .alias(" Init_Win_bytes_backward"),
        F.when(ok % 5 == 0, F.lit("-1")).otherwise(F.col("l_quantity").cast("string")).alias(" Fwd IAT Min"),
        F.when(sel == 0, F.lit("Infinity")).when(sel == 1, F.lit(""))
        .otherwise(F.col("l_extendedprice").cast("string")).alias("Flow Bytes/s"),
        F.col("l_discount").cast("string").alias("flow iat mean"),
        F.element_at(F.array(*[F.lit(x) for x in CSV_LABELS]), ((ok + ln) % 9 + 1).cast("int")).alias(" Label"))


def flow_csv_paths(spark: SparkSession, sf_dir: str) -> list[str]:
    """Write table 4 as two CSV tables (by order key parity) under the checkpoint folder, a file a task."""
    import uuid

    from .session import checkpoint_dir
    base = f"{checkpoint_dir(spark).rstrip('/')}/netlake/flowcsv-{uuid.uuid4().hex}"
    df = flow_csv_frame(spark, sf_dir)
    paths = []
    for part in (0, 1):
        p = f"{base}/part{part}"
        (df.filter(F.col("_file") == part).drop("_file").write
         .option("header", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).mode("overwrite").csv(p))
        paths.append(p)
    return paths


def _csv_label_case() -> str:
    parts = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(CSV_LABELS))
    return f"CASE CAST((l_orderkey + l_linenumber) % 9 AS INTEGER) {parts} END"


FLOW_CSV_RAW_SQL = f"""
SELECT l_quantity * 1000 AS flow_duration, CAST(l_linenumber AS DOUBLE) AS total_fwd_packets,
  CASE WHEN l_orderkey % 4 = 0 THEN -1.0 ELSE CAST(l_partkey % 65536 AS DOUBLE) END AS init_win_bytes_backward,
  CASE WHEN l_orderkey % 5 = 0 THEN -1.0 ELSE l_quantity END AS fwd_iat_min,
  CASE WHEN (l_orderkey + l_linenumber) % 50 = 0 THEN 'inf'::DOUBLE
       WHEN (l_orderkey + l_linenumber) % 50 = 1 THEN NULL ELSE l_extendedprice END AS flow_bytes_s,
  l_discount AS flow_iat_mean,
  {_csv_label_case()} AS label_raw
FROM lineitem
"""


# ---------------------------------------------------------------- behaviour events with idle hours
def idle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES table 15: all events on their own time scale (sources idle for hours), as behaviour events."""
    e = _events(spark, sf_dir)
    kind = F.col("event_type")
    return e.select(F.col("event_id").alias("flow_id"), _uid_ip(F.col("user_id")).alias("src_ip"), (F.col("event_id") % 40).cast("int").alias("dst_port"),
                    F.when(kind == "error", "DoS/DDoS").when(kind == "signup", "PortScan").otherwise("Normal").alias("label"),
                    (F.col("event_id") % 1000).cast("long").alias("total_length_fwd_packets"), F.expr("unix_micros(cast(ts as timestamp))").alias("ts_us"))


IDLE_EVENTS_SQL = """
SELECT event_id AS flow_id, '10.' || CAST((user_id // 65536) % 256 AS VARCHAR) || '.' || CAST((user_id // 256) % 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS src_ip,
  CAST(event_id % 40 AS INTEGER) AS dst_port, CASE event_type WHEN 'error' THEN 'DoS/DDoS' WHEN 'signup' THEN 'PortScan' ELSE 'Normal' END AS label,
  CAST(event_id % 1000 AS BIGINT) AS total_length_fwd_packets, epoch_us(ts) AS ts_us FROM events
"""
