"""Pointer doubling, the throttle and the strike states against plain loops, hot keys included."""
import random

import pytest

from netlake.operators import response as rs
from netlake.plans.ranking import reached

S = 1_000_000


def test_reached_equals_walking(spark):
    rng = random.Random(4)
    links, starts, want = [], [], set()
    for k in "abc":
        to = {i: min(i + rng.choice([1, 2, 5, 40]), 10_000) for i in range(400) if rng.random() < 0.97}
        links += [(k, i, j) for i, j in to.items()] + [(k, 900, None)]
        for s in rng.sample(range(400), 2) + [777]:
            starts.append((k, s))
            while s is not None:
                want.add((k, s))
                s = to.get(s)
    got = reached(spark.createDataFrame(starts + starts[:2], "k string, at long"), spark.createDataFrame(links, "k string, at long, to long"), "k")
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want)
    assert reached(spark.createDataFrame([], "k string, at long"), spark.createDataFrame(links, "k string, at long, to long"), "k").count() == 0


def plain_throttle(rows, gap):
    last, sent = {}, set()
    for i, k, t in sorted(rows, key=lambda x: (x[2], x[0])):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            sent.add(i)
    return sent


@pytest.mark.parametrize("bucket_s", [0.5, 10_000])
def test_throttle_equals_loop(spark, bucket_s):
    """A label that never goes quiet and holds most rows, bursts of equal times, silences of exactly the gap, a null label."""
    rng = random.Random(8)
    rows, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 1, 100_000, 3 * S])
        rows.append((i, "hot", t))
    for i in range(1500, 1900):
        rows.append((i, rng.choice(["a", "b", None]), rng.randint(0, 80) * 15 * S))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "alert_id long, label string, ts_us long").repartition(5)
    got = {r.alert_id for r in rs.throttle(df, bucket_s=bucket_s).where("emitted").collect()}
    assert got == plain_throttle(rows, 30 * S)
    assert rs.throttle(df, bucket_s=bucket_s).count() == len(rows)


def plain_states(rows, threshold, dur, white=("127.0.0.1",)):
    """rows (id, ip, ts, action) -> id -> (status, strike number, end of the block that starts here)."""
    out, state = {}, {}
    rows = sorted((r for r in rows if r[1] is not None and r[1] not in white), key=lambda x: (x[2], x[0]))
    began = {}
    for i, k, t, act in rows:
        n, until = state.get(k, (0, None))
        if until is not None and t >= until:
            n, until = 0, None
        if act == "block":
            status = "noop" if until is not None else "manual_block"
            until, no = (until, 0) if until is not None else (t + dur, 0)
        elif act == "unblock":
            status, no = ("noop", 0) if until is None else ("manual_unblock", 0)
            if until is not None:
                out[began[k]] = (*out[began[k]][:2], t)
                n, until = 0, None
        elif until is not None:
            status, no = "ignored", 0
        else:
            n += 1
            status, no = ("blocked", n) if n >= threshold else ("strike", n)
            until = t + dur if n >= threshold else None
        if status in ("blocked", "manual_block"):
            began[k] = i
        out[i] = (status, no, until if status in ("blocked", "manual_block") else None)
        state[k] = (n, until)
    return out


@pytest.mark.parametrize("threshold,bucket_s", [(3, 60), (1, 2)])
def test_states_equal_loop(spark, threshold, bucket_s):
    """One source with most rows that never goes quiet, equal times, rows exactly at a block's end, manual actions, white-listed and null sources."""
    rng = random.Random(threshold)
    rows = []
    for i in range(1200):
        ip = "6.6.6.6" if rng.random() < 0.8 else rng.choice(["1.1.1.1", "2.2.2.2", "127.0.0.1", None])
        rows.append((i, ip, rng.randint(0, 900) * S, rng.choice(["attack"] * 12 + [None, "block", "unblock", "unblock", "other"])))
    df = spark.createDataFrame(rows, "event_id long, src_ip string, ts_us long, action string").repartition(4)
    got = {r.event_id: (r.status, r.strike_no, r.until_us) for r in rs.strikes_and_blocks(df, threshold, 60, bucket_s=bucket_s).collect()}
    assert got == plain_states(rows, threshold, 60 * S)
    plain = df.drop("action")
    got = {r.event_id: (r.status, r.strike_no, r.until_us) for r in rs.strikes_and_blocks(plain, threshold, 60, bucket_s=bucket_s).collect()}
    assert got == plain_states([(*r[:3], "attack") for r in rows], threshold, 60 * S)


def test_empty_tables(spark):
    assert rs.throttle(spark.createDataFrame([], "alert_id long, label string, ts_us long")).count() == 0
    assert rs.strikes_and_blocks(spark.createDataFrame([], "event_id long, src_ip string, ts_us long")).count() == 0
