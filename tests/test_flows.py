"""Flow assembly and features on hand-made packets plus the fixture counts."""
from pyspark.sql import functions as F

from netlake import fixtures as fx
from netlake.operators import flows as fl

from conftest import SF001

COLS = "packet_id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, " \
       "length int, header_length int, window_size int, tcp_flags int, ip_version int"
A, B = "10.0.0.1", "10.0.0.2"


def pk(pid, ts, fwd=True, length=100, flags=0x10, win=1000):
    s, d, sp, dp = (A, B, 5000, 80) if fwd else (B, A, 80, 5000)
    return (pid, ts, s, d, sp, dp, 6, length, 40, win, flags, 4)


def features(spark, rows, **kw):
    df = spark.createDataFrame(rows, COLS)
    return {r["flow_id"]: r for r in fl.flows_from_packets(df, **kw).collect()}


def test_fixture_flow_count(spark):
    f = fl.flows_from_packets(fx.packets(spark, SF001))
    assert f.count() == 87


def test_timeout_boundary(spark):
    # gap of exactly 30 s stays in the flow; 30.000001 s opens a new one
    same = features(spark, [pk(1, 0), pk(2, 30_000_000)])
    assert list(same) == [1] and same[1]["total_fwd_packets"] == 2
    split = features(spark, [pk(1, 0), pk(2, 30_000_001)])
    assert sorted(split) == [1, 2]


def test_fin_closes_and_next_packet_opens(spark):
    f = features(spark, [pk(1, 0), pk(2, 10, fwd=False), pk(3, 20, flags=0x11), pk(4, 30, fwd=False)])
    assert sorted(f) == [1, 4]
    assert f[1]["total_fwd_packets"] == 2 and f[1]["total_backward_packets"] == 1
    assert f[4]["src_ip"] == B and f[4]["total_fwd_packets"] == 1 and f[4]["flow_duration"] == 1.0


def test_active_idle_drop_last_segment(spark):
    # segments: [0, 100000] -> gap 2 s -> [2100000, 2200000] -> gap 1 s -> [3200000]
    rows = [pk(1, 0), pk(2, 100_000), pk(3, 2_100_000), pk(4, 2_200_000), pk(5, 3_200_000)]
    f = features(spark, rows)[1]
    assert f["idle_mean"] == 1_500_000.0 and f["idle_max"] == 2_000_000.0 and f["idle_min"] == 1_000_000.0
    # active periods: 100000 and 100000; the last one is never recorded
    assert f["active_mean"] == 100_000.0 and f["active_std"] == 0.0


def test_iat_and_window_features(spark):
    rows = [pk(1, 0, win=-1), pk(2, 1_000_000, fwd=False, win=7), pk(3, 3_000_000, win=5), pk(4, 6_000_000)]
    f = features(spark, rows)[1]
    assert f["flow_iat_mean"] == 2.0 and f["flow_iat_max"] == 3.0 and f["flow_iat_min"] == 1.0
    assert f["fwd_iat_total"] == 6.0 and f["fwd_iat_mean"] == 3.0 and f["bwd_iat_mean"] == 0.0
    assert f["init_win_bytes_forward"] == 5 and f["init_win_bytes_backward"] == 7
    assert f["down_up_ratio"] == round(1 / 3, 4)


def test_bucket_width_does_not_change_flows(spark):
    p = fx.packets(spark, SF001)
    a = sorted(tuple(r) for r in fl.flows_from_packets(p, bucket_s=0.5).select("flow_id", "flow_bytes_s").collect())
    b = sorted(tuple(r) for r in fl.flows_from_packets(p, bucket_s=10_000).select("flow_id", "flow_bytes_s").collect())
    assert a == b


def test_loopback_and_non_ip_dropped(spark):
    rows = [pk(1, 0), (2, 5, "127.0.0.1", B, 1, 2, 6, 10, 40, 0, 16, 4), (3, 6, A, B, 1, 2, 6, 10, 40, 0, 16, 0)]
    df = spark.createDataFrame(rows, COLS)
    assert [r["packet_id"] for r in fl.clean_packets(df).collect()] == [1]
    d = fl.decode_flags(spark.createDataFrame([pk(1, 0, flags=0x12)], COLS)).first()
    assert d["syn"] and d["ack"] and not d["fin"]
    _ = F
