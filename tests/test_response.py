"""Greedy throttle and strike/block folds against hand-computed answers."""
from pyspark.sql import functions as F

from netlake.operators import response as rs

S = 1_000_000


def test_throttle_is_greedy_not_lag(spark):
    # 0, 20, 40 s: emits 0 and 40 (a lag rule would emit only 0)
    df = spark.createDataFrame([(1, "x", 0), (2, "x", 20 * S), (3, "x", 40 * S), (4, "y", 5 * S)],
                               "alert_id long, label string, ts_us long")
    got = {r["alert_id"]: r["emitted"] for r in rs.throttle(df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_throttle_dense_chain(spark):
    df = spark.createDataFrame([(i, "x", i * S) for i in range(100)], "alert_id long, label string, ts_us long")
    emitted = sorted(r["alert_id"] for r in rs.throttle(df).filter("emitted").collect())
    assert emitted == [0, 30, 60, 90]


def test_strikes_and_blocks(spark):
    ts = [0, 1, 2, 3, 59, 62, 63, 64, 65]
    df = spark.createDataFrame([(i, "1.2.3.4", t * S) for i, t in enumerate(ts)] + [(99, "127.0.0.1", 0)],
                               "event_id long, src_ip string, ts_us long")
    got = {r["event_id"]: (r["status"], r["strike_no"]) for r in rs.strikes_and_blocks(df, duration_s=60).collect()}
    assert 99 not in got                                   # whitelisted
    assert [got[i][0] for i in range(9)] == ["strike", "strike", "blocked", "ignored", "ignored",
                                             "strike", "strike", "blocked", "ignored"]
    b = rs.blocks(rs.strikes_and_blocks(df, duration_s=60)).orderBy("blocked_at_us").collect()
    assert [(r["blocked_at_us"], r["unblocked_at_us"]) for r in b] == [(2 * S, 62 * S), (64 * S, 124 * S)]
    now = rs.blocked_at(rs.blocks(rs.strikes_and_blocks(df, duration_s=60)), 70 * S, 60).collect()
    assert [(r["ip"], r["remaining_sec"]) for r in now] == [("1.2.3.4", 54)]
    _ = F


def test_manual_block_and_unblock(spark):
    rows = [(1, "9.9.9.9", 0, "attack"), (2, "9.9.9.9", 1 * S, "attack"), (3, "9.9.9.9", 2 * S, "block"),
            (4, "9.9.9.9", 3 * S, "attack"), (5, "9.9.9.9", 4 * S, "unblock"), (6, "9.9.9.9", 5 * S, "attack"),
            (7, "9.9.9.9", 6 * S, "unblock"), (8, "9.9.9.9", 7 * S, "block"), (9, "9.9.9.9", 70 * S, "attack")]
    df = spark.createDataFrame(rows, "event_id long, src_ip string, ts_us long, action string")
    got = {r["event_id"]: (r["status"], r["strike_no"]) for r in rs.strikes_and_blocks(df, duration_s=60).collect()}
    assert [got[i][0] for i in range(1, 10)] == ["strike", "strike", "manual_block", "ignored", "manual_unblock",
                                                 "strike", "noop", "manual_block", "strike"]
    assert got[6][1] == 1 and got[9][1] == 1          # unblock and expiry clear the strikes
