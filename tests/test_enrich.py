"""Longest-prefix geo match and as-of reputation against ipaddress and plain loops."""
import ipaddress
import random

import pytest

from netlake import config
from netlake.operators import enrich as en

S = 1_000_000
DIM = "network string, start_ip long, end_ip long, country string, country_code string, region string, city string, lat double, lon double, isp string, org string, asn string, is_proxy boolean, is_hosting boolean"


def record(network, start, end, name):
    return (network, start, end, name, "AB", "", "", 0.0, 0.0, name, "", "", False, False)


def test_numbers_of_addresses(spark):
    texts = ["1.2.3.4", "::", "::1", "2001:DB8::ff", "2001:db8:0:0:0:0:0:ff", "fe80::1%eth0", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1::8", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "64:ff9b::192.0.2.33"]
    junk = ["", "?", None, "x", "1.2.3", "1:2:3", ":::", "1::2::3", "12345::", "g::1", "1:2:3:4:5:6:7:8:9", "host:80"]
    df = spark.createDataFrame([(t,) for t in texts + junk], "ip string")
    got = {r.ip: None if r.n is None else (r.n.hi % 2 ** 64) << 64 | r.n.lo % 2 ** 64 for r in df.select("ip", en.ip_number(df.ip).alias("n")).collect()}
    for t in texts:
        a = ipaddress.ip_address(t.split("%")[0])
        assert got[t] == (int(a) if a.version == 6 else 0xFFFF << 32 | int(a)), t
    assert all(got[t] is None for t in junk)


def test_geo_equals_scan_of_all_networks(spark):
    rng = random.Random(2)
    nets = ["2001:db8::/32", "2001:db8:5::/48", "2001:db8:5:8000::/49", "2001:db8:5:1::/64", "2001:db8:5:1::7/128", "::/3", "198.51.100.0/24", "198.51.100.64/27", "0.0.0.0/1", "bad/8", "1.2.3.4/x"]
    rows = [record(n, None, None, f"n{i}") for i, n in enumerate(nets)]
    base = int(ipaddress.ip_address("203.0.113.0"))
    for k in range(12):
        a = base + rng.randint(0, 255)
        rows.append(record(None, a, a + rng.choice([0, 1, 9, 57, 300]), f"r{k}"))
    rows += [record(None, base + 9, base + 3, "reversed"), record(None, 0, 2 ** 32 - 1, "all v4"), record(None, None, None, "none")]
    ips = [f"203.0.113.{k}" for k in range(0, 256, 3)] + [f"198.51.100.{k}" for k in range(0, 256, 16)] + ["9.9.9.9", "2001:db8::1", "2001:db8:5::1", "2001:db8:5:8000::1", "2001:DB8:5:1::7", "2001:db8:5:1::8", "2400::1", "3fff:ffff::1", "4000::", "", "?", None, "junk", "10.1.2.3"]
    ips += [f"2001:db8:{rng.randint(0, 9):x}:{rng.choice([0, 1, 0x8000, 0xffff]):x}::{rng.randint(0, 9):x}" for _ in range(60)]
    ips = list(dict.fromkeys(ips))

    def block(r):
        try:
            if r[0]:
                n = ipaddress.ip_network(r[0], strict=False)
                lift = 0xFFFF << 32 if n.version == 4 else 0
                return int(n[0]) + lift, int(n[-1]) + lift
        except ValueError:
            return None
        return (r[1] + (0xFFFF << 32), r[2] + (0xFFFF << 32)) if r[1] is not None and r[1] <= r[2] else None

    blocks = [(b, r[3]) for r in rows if (b := block(r))]

    def want(ip):
        if ip in ("", "?", None):
            return "Unknown"
        for p, label in config.PRIVATE_PREFIXES:
            if ip.startswith(p):
                return label
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return "Unknown"
        n = int(a) + (0xFFFF << 32 if a.version == 4 else 0)
        return min(((e - s, s, name) for (s, e), name in blocks if s <= n <= e), default=(0, 0, "Unknown"))[2]

    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r.ip: r.country for r in en.geo_lookup(df, spark.createDataFrame(rows, DIM)).collect()}
    assert got == {i: want(i) for i in ips}
    assert {r.country for r in en.geo_lookup(df.where("ip = '9.9.9.9'"), spark.createDataFrame([], DIM)).collect()} == {"Unknown"}
    five = spark.createDataFrame([(None, 1), ("203.0.113.0", 2), ("203.0.113.0", 3)], "src_ip string, n int")
    assert sorted(r.n for r in en.enrich_geo(five, spark.createDataFrame(rows, DIM)).collect()) == [1, 2, 3]


@pytest.mark.parametrize("bucket_s", [1, 300, 100_000])
def test_reputation_equals_loop(spark, bucket_s):
    """A hot address, records at the event's time, ties, records just inside and at the TTL, empty, private and unknown addresses."""
    rng = random.Random(5)
    ttl = 40
    dim = [(i, rng.choice(["8.8.8.8", "8.8.8.8", "9.9.9.9", "10.0.0.1", None]), rng.randint(0, 30) * 20 * S, rng.randint(0, 100), i, "US", f"isp{i}", "", ([22], "Linux", "o", [], "shodan")) for i in range(60)]
    events = [(i, rng.choice(["8.8.8.8"] * 6 + ["9.9.9.9", "10.0.0.1", "7.7.7.7", "", "?", None]), rng.randint(0, 700) * S) for i in range(600)]
    ev = spark.createDataFrame(events, "event_id long, src_ip string, ts_us long").repartition(3)
    rd = spark.createDataFrame(dim, "rep_id long, ip string, fetched_at_us long, abuse_score int, total_reports int, country string, isp string, domain string, exposure struct<ports: array<int>, os: string, org: string, hostnames: array<string>, source: string>")
    got = {r.event_id: (r.rep_source, r.rep_abuse_score, r.rep_total_reports, r.rep_exposure.source) for r in en.enrich_reputation(ev, rd, ttl_s=ttl, bucket_s=bucket_s).collect()}
    assert len(got) == len(events)
    for i, ip, t in events:
        if ip in ("", "?", None):
            want = ("unknown", 0, 0, "empty")
        elif any(ip.startswith(p) for p in config.REPUTATION_PRIVATE):
            want = ("private", 0, 0, "private")
        else:
            best = max(((f, k, a, n) for k, d, f, a, n, *_ in dim if d == ip and f <= t and t - f < ttl * S), default=None)
            want = ("abuseipdb", best[2], best[3], "shodan") if best else ("default", 0, 0, "not_scanned")
        assert got[i] == want, (i, ip, t)
