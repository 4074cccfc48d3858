"""Streaming == batch on the fixture, capture round trip, SQL functions == Column functions."""
from pyspark.sql import functions as F

import __spark_entry__ as ent
from netlake import fixtures as fx
from netlake.functions.sql import register_sql_functions
from netlake.operators import dns as dn
from netlake.operators import flows as fl

from conftest import SF001


def _key(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_flows_equal_batch(spark):
    cols = ["flow_id", "total_fwd_packets", "total_backward_packets", "flow_bytes_s", "flow_iat_std",
            "active_mean", "idle_max", "init_win_bytes_backward"]
    s = ent.queries()["stream_flows"](spark, SF001)
    b = fl.flows_from_packets(fx.packets(spark, SF001))
    assert _key(s, cols) == _key(b, cols)


def test_stream_strikes_equal_batch(spark):
    q = ent.queries()
    cols = ["event_id", "status", "strike_no"]
    assert _key(q["stream_strikes"](spark, SF001), cols) == _key(q["strikes"](spark, SF001), cols)


def test_capture_roundtrip(spark):
    got = ent.queries()["capture_roundtrip"](spark, SF001)
    src = fx.packets(spark, SF001)
    cols = ["ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "header_length", "tcp_flags"]
    assert _key(got, cols) == _key(src, cols)


def test_sql_functions_match_columns(spark):
    register_sql_functions(spark)
    df = spark.createDataFrame([("x7k2q9z1.evil.net",), ("www.example.com",), ("a.io",),
                                ("bananabananabananabananabanana.org",)], "q string")
    a = df.select(dn.dga_reason(dn.domain_label(F.col("q"))).alias("r")).collect()
    b = df.selectExpr("dga_reason(domain_label(q)) AS r").collect()
    assert a == b
    e = spark.sql("SELECT shannon_entropy('aabb') AS e, ip_scope('192.168.1.1') AS s, risk_level(45.0) AS r").first()
    assert e["e"] == 1.0 and e["s"] == "Private Network" and e["r"] == "HIGH"


def test_late_packets_do_not_break_the_stream(spark):
    import tempfile

    from netlake.streaming import runner as srun
    from netlake.streaming.flows import stream_flows
    from netlake.operators.flows import clean_packets
    p = fx.packets(spark, SF001)
    hi = p.agg(F.max("ts_us")).first()[0]
    base = tempfile.mkdtemp(prefix="netlake-late-")
    late = p.filter(F.col("packet_id") < 50)                          # the oldest packets, delivered last
    p.filter(F.col("packet_id") >= 50).coalesce(1).write.mode("append").parquet(base)
    late.coalesce(1).write.mode("append").parquet(base)
    s = srun.read_stream(spark, base, p.schema)
    out = srun.run_to_table(stream_flows(s, watermark="10 seconds"), "late")
    # groups whose timeout is already behind the watermark are expired instead of failing the query
    assert srun.LAST_RUN["input_rows"] == clean_packets(p).count() or srun.LAST_RUN["input_rows"] == p.count()
    assert out.count() > 0 and hi > 0 and srun.LAST_RUN["batches"] >= 2
