"""The exact query rate of every DNS query, and its verdict, on a stream.

``transformWithState`` keeps, per source, the times of the queries that a later query's window
can still reach (at most ``cap`` of them) in list state.  A timer at the end of the last
window clears the list, so a source that has gone quiet leaves nothing behind.
Needs the RocksDB state store (``STATE_STORE``), which keeps state outside the heap.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import config
from ..operators import dns
from .state_ops import _with_time

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class RecentQueries(StatefulProcessor):
    """Adds ``recent`` to each query: queries of its source in the ``window_us`` up to and with it, in time order, at most ``cap``."""

    def __init__(self, window_us: int, cap: int, tie: str):
        self.window_us, self.cap, self.tie = window_us, cap, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", T.StructType([T.StructField("ts", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts_us", self.tie])
        held = np.array([t[0] for t in self.times.get()], np.int64)
        ts = new["ts_us"].to_numpy(np.int64)
        # each earlier time, then the batch's: a stable sort keeps arrival order at equal times
        every = np.concatenate((held, ts))
        order = np.argsort(every, kind="stable")
        place = np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        every = every[order]
        recent = place[len(held) :] + 1 - np.searchsorted(every, ts - self.window_us, "left")
        kept = every[np.searchsorted(every, every[-1] - self.window_us, "left") :][-self.cap :]
        self.times.put([(int(t),) for t in kept])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ends = int(every[-1] + self.window_us) // 1000 + 1
        if ends > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(ends)
        else:
            self.times.clear()                   # out of reach of anything the watermark still lets in
        yield new.assign(recent=np.minimum(recent, self.cap))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_dns_verdicts(queries: DataFrame, window_s: int = config.DNS_WINDOW_S, limit: int = config.DNS_FLOOD_LIMIT, tunnel_len: int = config.DNS_TUNNEL_LEN,
                        cap: int = config.DNS_RATE_CAP, tie: str = "packet_id", watermark: str = "2 minutes") -> DataFrame:
    """Every query with its verdict columns, as ``dns.dns_verdicts`` gives them on a table.

    Rows of one source may come in any order within the watermark's delay of one micro-batch; a row
    that comes after a later one of an earlier batch counts what is still held.
    """
    q = queries.filter(F.col("qname").isNotNull()).withColumn("qname", dns.clean_qname(F.col("qname")))
    schema = T.StructType([*q.schema.fields, T.StructField("recent", T.LongType())])
    rated = _with_time(q, watermark).groupBy("src_ip").transformWithStateInPandas(
        RecentQueries(int(window_s * 1_000_000), cap, tie), T.StructType([*schema.fields]), "append", "EventTime")
    return dns.judge_queries(rated, window_s, limit, tunnel_len)
