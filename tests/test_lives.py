"""Profiles that start anew after an idle hour, against a plain loop; hot sources, pauses of exactly the limit."""
import random

from pyspark.sql import functions as F

from netlake.operators import behavior as bh

S = 1_000_000


def test_lives_equal_loop(spark):
    rng = random.Random(6)
    rows, t = [], 0
    for i in range(900):
        t += rng.choice([1, 7, 400, 3600, 3601, 9000]) * S if rng.random() < 0.2 else rng.randint(0, 20) * S
        rows.append((i, rng.choice(["hot"] * 5 + ["a", "b"]), rng.choice([0, 22, 80, 443, None]), rng.choice(["Normal", "DoS/DDoS", "PortScan"]), 10, t))
    rows += [(2000, "", 1, "Normal", 1, 5), (2001, None, 1, "Normal", 1, 5)]
    df = spark.createDataFrame(rows, "flow_id long, src_ip string, dst_port int, label string, total_length_fwd_packets long, ts_us long").repartition(4)
    state, want = {}, {}
    for i, ip, port, label, _, ts in sorted(rows, key=lambda r: (r[5], r[0])):
        if not ip:
            continue
        st = state.get(ip)
        if st is None or ts - st["times"][-1] > 3600 * S:
            st = state[ip] = {"a": 0, "n": 0, "s": 0, "ports": set(), "times": [], "start": ts, "bytes": 0, "labels": {}}
        st["n" if label == "Normal" else "a"] += 1
        st["s"] += label == "DoS/DDoS"
        st["ports"] |= {port} - {0, None}
        st["times"].append(ts)
        st["bytes"] += 10
        st["labels"][label] = st["labels"].get(label, 0) + 1
        want[i] = (st["a"], st["n"], st["s"], len(st["ports"]), min(500, sum(x > ts - 300 * S for x in st["times"])), st["start"])
    for bucket_s in (5, 100_000):
        got = {r.flow_id: (r.attack_count, r.normal_count, r.severe_count, r.ports_count, r.recent_events, r.life_us) for r in bh.running_scores(df, bucket_s=bucket_s).collect()}
        assert got == want
    assert len({w[5] for w in want.values()}) > 20
    p = {r.src_ip: r for r in bh.ip_profiles(df).collect()}
    assert {k: (r.attack_count, r.normal_count, r.ports_count, r.bytes_total, r.first_seen_us, r.last_seen_us) for k, r in p.items()} == {
        k: (s["a"], s["n"], len(s["ports"]), s["bytes"], s["start"], s["times"][-1]) for k, s in state.items()}
    assert {(r.src_ip, r.label): r.events for r in bh.label_counts(df).collect()} == {(k, lab): n for k, s in state.items() for lab, n in s["labels"].items()}
    none = df.where(F.lit(False))
    assert bh.running_scores(none).count() == bh.ip_profiles(none).count() == 0


def test_a_group_of_rows_is_ordered_without_frames():
    import pandas as pd

    from netlake.streaming.state_ops import _ordered
    parts = [pd.DataFrame({"ts_us": [5, 3], "event_id": [1, 9], "label": ["a", None]}), pd.DataFrame({"ts_us": [3], "event_id": [2], "label": ["c"]})]
    got = _ordered(iter(parts), "ts_us", "event_id")
    assert {c: v.tolist() for c, v in got.items()} == {"ts_us": [3, 3, 5], "event_id": [2, 9, 1], "label": ["c", None, "a"]}
    assert _ordered(iter(parts[1:]), "ts_us", "event_id")["event_id"].tolist() == [2]
