"""Alert union, greedy throttle, strikes and blocks.

W7 and W8 look sequential: whether an alert is sent depends on the last alert
*sent*, whether a strike counts depends on the last *block*.  Where each would lead
next does not: if an alert is sent at t, the next one is the first at or
after t + gap; if a source starts afresh at a row, its next block and the row after
that block are fixed.  Both are therefore successor links found by ordered
scans (``plans.scan``) whose visited places are marked by pointer doubling
(``plans.ranking``), and a last scan gives every row its state.  No key, however
hot, is folded in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import round_bin
from ..plans.ranking import reached
from ..plans.scan import BUCKET_COL, keyed_scan
from ..plans.stage import materialize

ALERT_COLS = ["source", "alert_id", "label", "severity", "confidence", "recommendation", "src_ip", "dst_ip",
              "dst_port", "ts_us"]
SOURCE_RANK = {"flow": 0, "dns": 1, "honeypot": 2}


# ---------------------------------------------------------------- U3
def union_alerts(flows: DataFrame | None = None, dns: DataFrame | None = None,
                 hits: DataFrame | None = None) -> DataFrame:
    """One alert stream from flow verdicts (attacks only), DNS alerts and honeypot hits.

    Each source keeps its own label format: the verdict label,
    ``DNS Attack (<type>)``, ``Honeypot Probe (<service>)``.
    """
    parts = []
    if flows is not None:
        parts.append(flows.filter(F.col("is_attack")).select(
            F.lit("flow").alias("source"), F.col("flow_id").alias("alert_id"), "label", "severity",
            F.col("confidence").cast("double").alias("confidence"), "recommendation", "src_ip", "dst_ip",
            F.col("dst_port").cast("string").alias("dst_port"), F.col("last_seen_us").alias("ts_us")))
    if dns is not None:
        parts.append(dns.select(
            F.lit("dns").alias("source"), F.col("packet_id").alias("alert_id"),
            F.concat(F.lit("DNS Attack ("), F.col("attack_type"), F.lit(")")).alias("label"), "severity",
            F.lit(1.0).alias("confidence"),
            F.concat(F.lit("Inspect DNS query: "), F.col("query"), F.lit(". Reason: "), F.col("reason"),
                     ).alias("recommendation"),
            "src_ip", F.col("query").alias("dst_ip"), F.lit("DNS").alias("dst_port"), "ts_us"))
    if hits is not None:
        parts.append(hits.select(
            F.lit("honeypot").alias("source"), F.col("hit_id").alias("alert_id"),
            F.concat(F.lit("Honeypot Probe ("), F.col("service"), F.lit(")")).alias("label"),
            F.lit("CRITICAL").alias("severity"), F.lit(1.0).alias("confidence"),
            F.format_string("Unauthorized access to fake port %d (%s). Block IP immediately.",
                            F.col("port"), F.col("service")).alias("recommendation"),
            "src_ip", F.lit("Honeypot").alias("dst_ip"), F.col("port").cast("string").alias("dst_port"), "ts_us"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- W7
def _named(col: str) -> Column:
    """A non-null key for any value of ``col``."""
    return F.when(F.col(col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(col).cast("string")))


def throttle(alerts: DataFrame, by: str = "label", gap_s: float = config.ALERT_COOLDOWN_S, ts: str = "ts_us",
             tie: str = "alert_id", bucket_s: float = 60) -> DataFrame:
    """Greedy per-``by`` cooldown; adds ``emitted`` (sent unless within
    ``gap_s`` of the last *sent* alert of the same key).

    Of alerts at the same time only the first by ``tie`` (unique within a key
    and time) can be sent.  An alert after ``gap_s`` of silence is always sent and
    starts a chain; each distinct time leads to the first at least ``gap_s`` later.
    A null key is a key of its own; without a gap everything is sent.
    """
    gap_us = int(round(gap_s * 1_000_000))
    if gap_us <= 0:
        return alerts.withColumn("emitted", F.lit(True))
    a = materialize(alerts, "throttle-in")
    times = materialize(a.groupBy(_named(by).alias("_k"), F.col(ts).alias("_t")).agg(F.min(tie).alias("_tie")), "throttle-times")
    # latest first: every time, and where its gap ends, meets the earliest time at or after it
    marks = times.select("_k", F.explode(F.array(F.struct((-F.col("_t")).alias("neg"), F.lit(0).alias("end")),
                                                 F.struct((-F.col("_t") - gap_us).alias("neg"), F.lit(1).alias("end")))).alias("m"))
    marks = keyed_scan(marks.select("_k", "m.neg", "m.end"), ["_k"], "neg", "end", int(bucket_s * 1_000_000),
                       lasts=[("to", F.when(F.col("end") == 0, -F.col("neg")))])
    marks = materialize(marks.drop(BUCKET_COL), "throttle-next")
    quiet = marks.where((F.col("end") == 0) & (F.col("to") + F.col("neg") >= gap_us)).select("_k", F.col("to").alias("at"))
    starts = quiet.union(times.groupBy("_k").agg(F.min("_t").alias("at")))
    links = marks.where("end = 1").select("_k", (-F.col("neg") - gap_us).alias("at"), "to")
    sent = reached(starts, links, "_k").select("_k", F.col("at").alias("_t"))
    sent = times.join(sent, ["_k", "_t"]).withColumn("_sent", F.lit(True))
    rows = a.withColumn("_k", _named(by)).withColumn("_t", F.col(ts)).withColumn("_tie", F.col(tie))
    return rows.join(sent, ["_k", "_t", "_tie"], "left").select(*a.columns, F.coalesce("_sent", F.lit(False)).alias("emitted"))


# ---------------------------------------------------------------- W8 / J9 / J10
def strikes_and_blocks(attacks: DataFrame, threshold: int = config.BLOCK_THRESHOLD,
                       duration_s: float = config.BLOCK_DURATION_S, whitelist: list[str] | None = None,
                       ip: str = "src_ip", ts: str = "ts_us", tie: str = "event_id", bucket_s: float = 60) -> DataFrame:
    """W8 + J9 + J10: the state of each source at each of its attack events, in time order.

    Adds ``status`` (``strike`` / ``blocked`` = the strike that triggers a
    block / ``ignored`` = arrived while blocked), ``strike_no`` and, on rows that start a
    block, ``until_us`` (its end).  A block
    lasts ``duration_s`` (unblocked exactly at +duration, strikes cleared).
    Whitelisted sources (J9) never enter.  An optional ``action``
    column (``attack`` / ``block`` / ``unblock``) mixes in manual decisions:
    a manual block ends like any other, an unblock ends a block and clears the strikes; they are
    ``manual_block`` / ``manual_unblock``, or ``noop`` where nothing changes.  ``tie`` orders rows of equal time uniquely.

    A source that starts afresh at a row is blocked at the earlier of its
    ``threshold``-th attack and the first manual block from there on; it starts afresh at the
    earlier of the first row at the block's end and the row after the first manual unblock.  These links are
    followed from each source's first row by pointer doubling.
    """
    wl = config.DEFAULT_WHITELIST if whitelist is None else whitelist
    a = attacks.filter(F.col(ip).isNotNull() & ~F.col(ip).isin(*wl)) if wl else attacks.filter(F.col(ip).isNotNull())
    dur_us, bucket_us = int(round(duration_s * 1_000_000)), int(bucket_s * 1_000_000)
    kind = F.when(F.col("action").isin("block", "unblock"), F.col("action")).otherwise("attack") if "action" in a.columns else F.lit("attack")
    rows = materialize(a.withColumn("_kind", kind), "strikes-in")
    numbered = keyed_scan(rows, [ip], ts, tie, bucket_us, sums=[("_r", F.lit(1)), ("_a", (F.col("_kind") == "attack").cast("int"))])
    rows = materialize(numbered.drop(BUCKET_COL), "strikes-rows")
    n = rows.select(F.col(ip).alias("k"), F.col(ts).alias("t"), F.col("_r").alias("r"), F.col("_a").alias("a"), F.col("_kind").alias("kind"))

    # latest first: what follows each row, and the first row at or after the end of a block that starts there
    both = n.select("k", "kind", F.explode(F.array(F.struct((-F.col("t")).alias("neg"), (-F.col("r")).alias("tie"), "r", F.lit(0).alias("end")),
                                                   F.struct((-F.col("t") - dur_us).alias("neg"), F.col("r").alias("tie"), "r", F.lit(1).alias("end")))).alias("m"))
    real = F.col("end") == 0
    after = keyed_scan(both.select("k", "kind", "m.*"), ["k"], "neg", "tie", bucket_us,
                       lasts=[("nxt", F.when(real, F.col("r"))), ("blk", F.when(real & (F.col("kind") == "block"), F.col("r"))),
                              ("unb", F.when(real & (F.col("kind") == "unblock"), F.struct("r", (-F.col("neg")).alias("t"))))])
    after = after.groupBy("k", "r").agg(F.max(F.when(real, F.col("blk"))).alias("blk"), F.max(F.when(real, F.col("unb"))).alias("unb"),
                                        F.max(F.when(~real, F.col("nxt"))).alias("expires"), F.max(F.when(real, F.col("nxt"))).alias("nxt"),
                                        F.max(F.when(real, -F.col("neg"))).alias("t"))
    # if a block starts at row r: its end, and the row of the fresh start after it
    early = F.col("unb").isNotNull() & (F.col("unb.t") < F.col("t") + dur_us)
    ends = after.select("k", "r", F.when(early, F.col("unb.t")).otherwise(F.col("t") + dur_us).alias("until"),
                        F.when(early, F.col("unb.r") + 1).otherwise(F.col("expires")).alias("fresh"), "blk")
    ends = materialize(ends, "strikes-ends")
    # if a source starts afresh at row r: where it is blocked
    nth = n.where("kind = 'attack'").select("k", (F.col("a") - threshold).alias("before"), F.col("r").alias("hit"))
    begin = n.withColumn("before", F.col("a") - (F.col("kind") == "attack").cast("int")).join(ends.select("k", "r", "blk"), ["k", "r"]).join(nth, ["k", "before"], "left")
    first_block = F.when(F.col("kind") == "block", F.col("r")).otherwise(F.col("blk"))
    begin = materialize(begin.select("k", "r", "before", F.least("hit", first_block).alias("b")), "strikes-begin")
    stops = begin.join(ends.select("k", F.col("r").alias("b"), "until", "fresh"), ["k", "b"])
    last = n.groupBy("k").agg(F.max("r").alias("last"))
    links = stops.join(last, "k").where("fresh <= last").select("k", F.col("r").alias("at"), F.col("fresh").alias("to"))
    fresh = reached(n.where("r = 1").select("k", F.col("r").alias("at")), links, "k").select("k", F.col("at").alias("r"))
    held = begin.join(fresh, ["k", "r"]).join(ends.select("k", F.col("r").alias("b"), "until"), ["k", "b"], "left")
    held = held.select(F.col("k").alias(ip), F.col("r").alias("_r"), F.struct("before", "b", "until").alias("_now"))
    rows = materialize(rows.join(held, [ip, "_r"], "left"), "strikes-held")
    out = keyed_scan(rows, [ip], ts, tie, bucket_us, lasts=[("_was", F.col("_now"))]).withColumn("_s", F.coalesce("_now", "_was"))

    attack, before_block = F.col("_kind") == "attack", F.col("_s.b").isNull() | (F.col("_r") < F.col("_s.b"))
    at_block = F.col("_r") == F.col("_s.b")
    status = (F.when(attack & before_block, "strike").when(attack & at_block, "blocked").when(attack, "ignored")
              .when(at_block, "manual_block")
              .when((F.col("_kind") == "unblock") & ~before_block & (F.col(ts) <= F.col("_s.until")), "manual_unblock").otherwise("noop"))
    counts = attack & (before_block | at_block)
    return out.select(*a.columns, status.alias("status"), F.when(counts, F.col("_a") - F.col("_s.before")).otherwise(F.lit(0)).cast("long").alias("strike_no"),
                      F.when(at_block, F.col("_s.until")).alias("until_us"))


def blocks(strikes: DataFrame, ip: str = "src_ip", ts: str = "ts_us") -> DataFrame:
    """D15 interval rows ``(ip, blocked_at_us, unblocked_at_us)``; a manual unblock ends its block early."""
    return strikes.filter(F.col("status").isin("blocked", "manual_block")).select(
        F.col(ip).alias("ip"), F.col(ts).alias("blocked_at_us"), F.col("until_us").alias("unblocked_at_us"))


def in_block(events: DataFrame, block_rows: DataFrame, ip: str = "src_ip", ts: str = "ts_us", name: str = "source_blocked", bucket_s: float = 60) -> DataFrame:
    """Adds whether each event's source is blocked at its time (``blocked_at <= ts < unblocked_at``).

    A stabbing join as one ordered scan: blocks of a source do not overlap, so the last one that began is the
    one that may still hold.  Events without an address or a time are not blocked.
    """
    ev = events.select(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("_e"), F.coalesce(F.col(ip), F.lit("")).alias("_k"), F.col(ts).alias("_ts"), F.lit(1).alias("_kind"))
    starts = block_rows.select(F.col("ip").alias("_k"), F.col("blocked_at_us").alias("_ts"), F.lit(0).alias("_kind"), F.col("unblocked_at_us").alias("_until"))
    both = keyed_scan(ev.unionByName(starts, allowMissingColumns=True), ["_k"], "_ts", "_kind", int(bucket_s * 1_000_000), lasts=[("_held", F.col("_until"))])
    return both.where("_kind = 1").select("_e.*", F.coalesce(F.col("_ts") < F.col("_held"), F.lit(False)).alias(name))


def block_state(verdicts: DataFrame, strikes: DataFrame, ip: str = "src_ip", ts: str = "last_seen_us", id_col: str = "flow_id") -> DataFrame:
    """Verdicts with ``block_status``, ``strike_no``, ``auto_blocked`` (this event triggered a block) and ``source_blocked``.

    ``strikes`` is ``strikes_and_blocks`` of the attacks among them; other events have status ``none``.
    """
    st = strikes.select(F.col(id_col).alias("_id"), F.col("status").alias("_status"), F.col("strike_no").alias("_no"))
    v = verdicts.join(st, F.col(id_col) == F.col("_id"), "left")
    v = v.select(*verdicts.columns, F.coalesce("_status", F.lit("none")).alias("block_status"), F.coalesce("_no", F.lit(0)).cast("long").alias("strike_no"),
                 F.coalesce(F.col("_status") == "blocked", F.lit(False)).alias("auto_blocked"))
    return in_block(v, blocks(strikes, ip), ip, ts)


def blocked_at(block_rows: DataFrame, now_us: int | Column, duration_s: float = config.BLOCK_DURATION_S) -> DataFrame:
    """Blocks active at ``now_us`` with remaining whole seconds."""
    now = now_us if isinstance(now_us, Column) else F.lit(int(now_us))
    dur_us = int(round(duration_s * 1_000_000))
    return (block_rows.filter((F.col("blocked_at_us") <= now) & (now < F.col("unblocked_at_us")))
            .select("ip", "blocked_at_us",
                    F.greatest(F.lit(0), ((F.lit(dur_us) - (now - F.col("blocked_at_us"))) / 1_000_000)
                               .cast("long")).alias("remaining_sec")))


# ---------------------------------------------------------------- P23
SEVERITY_MARK = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡"}   # FIXED VALUES; anything else green
OTHER_MARK = "🟢"
ACTIONS = {"banned": "source is blocked", "strike": "strike counted", "monitor": "watching only"}
NO_PORTS = "none known"


def format_alerts(df: DataFrame, auto_block_enabled: bool = False) -> DataFrame:
    """The dispatch text of each alert, one line a fact (needs geo_/rep_ columns and
    ``auto_blocked``); time is the event time in UTC.  Works alike for flow, DNS and honeypot alerts."""
    sev = F.col("severity")
    mark = F.coalesce(F.create_map(*[x for k, v in SEVERITY_MARK.items() for x in (F.lit(k), F.lit(v))])[sev], F.lit(OTHER_MARK))
    exp = F.col("rep_exposure")
    ports = F.when(F.size(exp.getField("ports")) > 0, F.array_join(F.slice(exp.getField("ports"), 1, 10).cast("array<string>"), ", ")).otherwise(F.lit(NO_PORTS))
    attack = F.coalesce(F.col("is_attack"), F.lit(True)) if "is_attack" in df.columns else F.lit(True)
    action = F.when(F.col("auto_blocked"), F.lit(ACTIONS["banned"])).when(attack & F.lit(auto_block_enabled), F.lit(ACTIONS["strike"])).otherwise(F.lit(ACTIONS["monitor"]))
    facts = [
        ("Confidence", F.concat(round_bin(F.coalesce(F.col("confidence"), F.lit(0.0)) * 100, 1).cast("string"), F.lit(" %"))),
        ("Source", F.concat(F.coalesce("src_ip", F.lit("?")), F.lit(" in "), F.col("geo_country"), F.lit(" / "), F.col("geo_city"), F.lit(" via "), F.col("geo_isp"))),
        ("Target", F.concat("dst_ip", F.lit(" port "), F.col("dst_port").cast("string"))),
        ("Host", F.concat(exp.getField("os"), F.lit(", "), exp.getField("org"), F.lit(", open ports "), ports)),
        ("Reputation", F.concat(F.col("rep_abuse_score").cast("string"), F.lit(" % from "), F.col("rep_total_reports").cast("string"), F.lit(" reports"))),
        ("Action", action),
        ("Advice", F.col("recommendation")),
        ("Time", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd HH:mm:ss 'UTC'")),
    ]
    text = F.concat_ws("\n", F.concat(mark, F.lit(" "), sev, F.lit(" "), F.col("label")), *[F.concat(F.lit(name + ": "), value) for name, value in facts])
    return df.select("*", mark.alias("severity_mark"), ports.alias("open_ports"), action.alias("mitigation"), text.alias("message"))


# ---------------------------------------------------------------- S9
def dispatch_alerts(alerts: DataFrame, writer) -> None:
    """S9 for batch input: hand the throttled, formatted alerts to ``writer(df, 0)``."""
    writer(alerts, 0)

