"""DNS detection boundaries and the golden scenario name."""
from netlake.operators import dns as dn


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, "packet_id long, ts_us long, src_ip string, qname string")
    return {r["packet_id"]: r for r in dn.dns_verdicts(df).collect()}


def test_golden_scenario_name(spark):
    q = "a1b2c3d4e5f6g7h8i9j0k1l2m3n4o5p6q7r8s9t0.malicious-c2-channel.com"
    v = verdicts(spark, [(1, 0, "10.0.0.1", q + ".")])[1]
    assert v["attack_type"] == "DGA Domain" and v["severity"] == "MEDIUM" and v["reason"] == "consonant cluster"


def test_tunnel_length_boundary(spark):
    v = verdicts(spark, [(1, 0, "10.0.0.1", "a" * 49 + ".example.com"), (2, 1, "10.0.0.2", "a" * 50 + ".example.com")])
    assert v[1]["attack_type"] != "DNS Tunneling"
    assert v[2]["attack_type"] == "DNS Tunneling" and v[2]["reason"] == "subdomain length 50"


def test_flood_boundary(spark):
    rows = [(i, i * 1000, "10.0.0.9", "www.example.com") for i in range(200)]
    v = verdicts(spark, rows)
    assert v[198]["attack_type"] is None and v[198]["recent"] == 199
    assert v[199]["attack_type"] == "DNS Flood" and v[199]["reason"] == "200 queries/60s"


def test_window_is_inclusive_60s(spark):
    rows = [(1, 0, "s", "www.example.com"), (2, 60_000_000, "s", "www.example.com"),
            (3, 60_000_001, "s", "www.example.com")]
    v = verdicts(spark, rows)
    assert v[2]["recent"] == 2 and v[3]["recent"] == 2


def test_dga_checks(spark):
    df = spark.createDataFrame([("deadbeef01",), ("abcdefghijklmnopqrst",), ("xkcdqwrt",), ("mnprampnr",),
                                ("bananabananabananabananabanana",), ("google",)], "label string")
    got = [r[0] for r in df.select(dn.dga_reason(df["label"])).collect()]
    assert got == ["hex-pattern label", "high entropy (4.32)", "consonant cluster", "low vowel ratio",
                   "long label (30 chars)", None]


def test_filter_on_alerts_copies_no_checks(spark):
    # the entropy and the label stood in the filter many times, evaluated for each
    rows = [(1, 0, "s", "deadbeef01.com"), (2, 1, "s", "www.example.com"), (3, 2, "s", None)]
    df = spark.createDataFrame(rows, "packet_id long, ts_us long, src_ip string, qname string")
    a = dn.dns_alerts(df)
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert not any("transform(" in line for line in plan.splitlines() if "Filter" in line)
    assert [(r["packet_id"], r["attack_type"], r["reason"]) for r in a.collect()] == [(1, "DGA Domain", "hex-pattern label")]
