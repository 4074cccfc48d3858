"""Property test: Spark flow features == an imperative per-packet flow model on random packets.

The model keeps per-flow *lists* (as the reference does) and is written
independently of the engine's formulas.
"""
import math
import random

import pytest

from netlake.operators import flows as fl

COLS = "packet_id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, " \
       "length int, header_length int, window_size int, tcp_flags int, ip_version int"


def model(packets, timeout_us=30_000_000, active_us=500_000):
    flows, done = {}, []
    for p in sorted(packets, key=lambda r: (r[1], r[0])):
        pid, ts, si, di, sp, dp, pr, ln, hl, ws, fl_, _ = p
        fk, bk = (si, di, sp, dp, pr), (di, si, dp, sp, pr)
        key = fk if fk in flows else bk if bk in flows else None
        if key is not None and ts - flows[key]["last"] > timeout_us:
            done.append(flows.pop(key))
            key = None
        if key is None:
            key = fk
            flows[key] = {"id": pid, "first": ts, "last": ts, "astart": ts, "fwd": [], "bwd": [], "ftimes": [],
                          "btimes": [], "all": [], "act": [], "idle": [], "src": si}
        f = flows[key]
        gap = ts - f["last"]
        if gap > active_us:
            f["idle"].append(gap)
            f["act"].append(f["last"] - f["astart"])
            f["astart"] = ts
        f["last"] = ts
        d = "fwd" if si == f["src"] and key == fk else "bwd"
        f[d].append(ln)
        f["ftimes" if d == "fwd" else "btimes"].append(ts)
        f["all"].append(ts)
        if fl_ & 0x05:
            done.append(flows.pop(key))
    return {f["id"]: f for f in done + list(flows.values())}


def _iat(ts):
    s = sorted(ts)
    return [b - a for a, b in zip(s, s[1:])] or [0]


def _std(xs):
    if len(xs) < 2:
        return 0.0
    m = sum(xs) / len(xs)
    return math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs))


def random_packets(seed, n=120):
    rnd = random.Random(seed)
    hosts = [("10.0.0.1", 1000), ("10.0.0.2", 80), ("10.0.0.3", 443), ("10.0.0.2", 1000)]
    out, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 10, 200_000, 600_000, 5_000_000, 31_000_000])
        a, b = rnd.sample(hosts, 2)
        flags = rnd.choice([0x10, 0x10, 0x10, 0x18, 0x02, 0x11, 0x04])
        out.append((i, t, a[0], b[0], a[1], b[1], 6, rnd.randint(40, 1500), 40, rnd.choice([-1, 0, 512, 65535]),
                    flags, 4))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_features_match_model(spark, seed):
    pk = random_packets(seed)
    got = {r["flow_id"]: r for r in fl.flows_from_packets(spark.createDataFrame(pk, COLS), bucket_s=1).collect()}
    want = model(pk)
    assert set(got) == set(want)
    for fid, m in want.items():
        g = got[fid]
        assert g["total_fwd_packets"] == len(m["fwd"]) and g["total_backward_packets"] == len(m["bwd"])
        assert g["total_length_fwd_packets"] == sum(m["fwd"])
        assert g["flow_duration"] == max(m["last"] - m["first"], 1)
        assert g["packet_length_std"] == pytest.approx(_std(m["fwd"] + m["bwd"]), abs=1e-4)
        assert g["flow_iat_std"] == pytest.approx(_std(_iat(m["all"])) / 1e6, abs=1e-4)
        assert g["fwd_iat_max"] == pytest.approx(max(_iat(m["ftimes"])) / 1e6)
        assert g["bwd_iat_mean"] == pytest.approx(sum(_iat(m["btimes"])) / len(_iat(m["btimes"])) / 1e6, abs=1e-4)
        act, idle = m["act"] or [0], m["idle"] or [0]
        assert g["active_mean"] == pytest.approx(sum(act) / len(act), abs=1e-3)
        assert g["idle_max"] == pytest.approx(max(idle))
