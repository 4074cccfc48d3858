"""Golden verdict rows (FIXTURES section 9) and rule boundaries."""
from pyspark.sql import functions as F

from netlake import config
from netlake.config import Thresholds
from netlake.operators import verdict as vd

BASE = {f: 0.0 for f in config.FEATURE_NAMES}


def row(**kw):
    r = dict(BASE)
    r.update({k: float(v) for k, v in kw.items()})
    return r


CASES = [
    ("ddos", row(syn_flag_count=150, ack_flag_count=5, flow_duration=2e6, flow_packets_s=60000), "DoS/DDoS"),
    ("portscan", row(syn_flag_count=45, total_backward_packets=2), "PortScan"),
    ("infiltration", row(total_length_bwd_packets=50000, total_length_fwd_packets=1000, total_backward_packets=15),
     "Infiltration"),
    ("nothing", row(), "Model Not Loaded"),
    ("syn boundary", row(syn_flag_count=100, ack_flag_count=0, flow_duration=1e6, total_backward_packets=10),
     "Model Not Loaded"),
    ("rst", row(rst_flag_count=201, flow_duration=9.9e6), "DoS/DDoS"),
    ("scan boundary", row(total_fwd_packets=21, total_backward_packets=2, fwd_packet_length_mean=99.9), "PortScan"),
    ("ratio boundary", row(total_length_bwd_packets=15000, total_length_fwd_packets=1000, total_backward_packets=11),
     "Model Not Loaded"),
]


def test_golden_no_model(spark):
    df = spark.createDataFrame([{"case": c, **r} for c, r, _ in CASES])
    got = {x["case"]: x for x in vd.classify(vd.no_model(df)).collect()}
    for c, _, want in CASES:
        assert got[c]["label"] == want, c
    assert got["nothing"]["is_attack"] and got["nothing"]["severity"] == "LOW"
    assert got["ddos"]["severity"] == "CRITICAL" and got["ddos"]["rule_triggered"]


def test_rule_vs_ml_confidence(spark):
    scan = row(syn_flag_count=45, total_backward_packets=2)
    df = spark.createDataFrame([{"case": "ml wins", "c": 0.70, **scan}, {"case": "rule wins", "c": 0.69, **scan}])
    ml = df.select("*", F.lit("Normal").alias("ml_label"), F.lit(0).alias("ml_label_id"),
                   F.col("c").alias("ml_confidence"), F.lit(False).alias("ml_is_attack"),
                   F.create_map().cast("map<string,double>").alias("scores"))
    got = {x["case"]: x for x in vd.classify(ml).collect()}
    assert got["ml wins"]["label"] == "Normal" and got["ml wins"]["rule_triggered"]
    assert got["rule wins"]["label"] == "PortScan"


def test_ensemble_decision(spark):
    df = spark.createDataFrame([
        ("benign", [0.9, 0.025, 0.025, 0.025, 0.025], 0.2),
        ("iso anomaly", [0.9, 0.025, 0.025, 0.025, 0.025], -0.7),
        ("weak attack", [0.1, 0.5, 0.2, 0.1, 0.1], 0.1),
        ("tie first max", [0.4, 0.4, 0.1, 0.05, 0.05], 0.1),
    ], "case string, probability array<double>, iso_score double")
    off = {x["case"]: x for x in vd.ensemble_decision(df).collect()}
    on = {x["case"]: x for x in vd.ensemble_decision(df, th=Thresholds(anomaly_enabled=True)).collect()}
    assert off["benign"]["ml_label"] == "Normal" and off["iso anomaly"]["ml_label"] == "Normal"
    assert on["iso anomaly"]["ml_label"] == "Anomaly"
    # 0.7 * 0.5 + 0.3 * (1 - 1.0) = 0.35 < 0.55 -> Anomaly
    assert off["weak attack"]["ml_label"] == "Anomaly" and off["weak attack"]["ml_confidence"] == 0.35
    assert off["tie first max"]["ml_label_id"] == 0
    assert set(off["benign"]["scores"]) == {"Normal", "DoS/DDoS", "PortScan", "Infiltration", "Anomaly",
                                            "Anomaly(IF)"}


def test_zero_day_override(spark):
    df = spark.createDataFrame([("a", "Normal", False, 0.9), ("b", "PortScan", True, 0.9), ("c", "Normal", False, 0.1)],
                               "id string, label string, is_attack boolean, ae_error double")
    df = df.select("*", F.lit("LOW").alias("severity"), F.lit("").alias("severity_icon"),
                   F.lit("").alias("recommendation"))
    got = {r["id"]: r for r in vd.zero_day_override(df, "ae_error", 0.5).collect()}
    assert got["a"]["label"] == "Zero-Day" and got["a"]["severity"] == "CRITICAL" and got["a"]["is_attack"]
    assert got["b"]["label"] == "PortScan" and got["c"]["label"] == "Normal"
    assert got["a"]["ae_score"] == 0.9 and got["c"]["ae_score"] == 0.1


def test_filter_on_verdicts_copies_no_checks(spark, tmp_path):
    # the label with all that it is made from stood in the filter many times: the method was too large to be compiled
    rows = [("weak attack", [0.1, 0.5, 0.2, 0.1, 0.1], 0.1, row()), ("benign", [0.9, 0.025, 0.025, 0.025, 0.025], 0.2, row()),
            ("scan", [0.6, 0.1, 0.1, 0.1, 0.1], 0.2, row(syn_flag_count=45, total_backward_packets=2))]
    spark.createDataFrame([{"case": c, "probability": p, "iso_score": i, **r} for c, p, i, r in rows]).write.parquet(str(tmp_path / "t"))
    v = vd.classify(vd.ensemble_decision(spark.read.parquet(str(tmp_path / "t")))).filter("is_attack").select("case", "label")
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert not any("array_max" in line for line in plan.splitlines() if "Filter" in line)
    assert {x["case"]: x["label"] for x in v.collect()} == {"weak attack": "Anomaly", "scan": "PortScan"}
