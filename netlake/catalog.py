"""Registered queries: name -> (spark callable, DuckDB twin or None).

Every query reads the driver's tables at ``sf_dir`` (through the fixture
derivations) so its work grows with them.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .operators import flows as fl
from .session import apply_engine_conf, ship_package
from .twins import flows as tfl

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_engine_conf(spark)
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return run
    return deco


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)


_LOADED = False


def _load_all() -> None:
    global _LOADED
    if _LOADED:
        return
    _LOADED = True
    from . import queries_more  # noqa: F401  (registers the remaining phases)


# ------------------------------------------------------------------ phase 1: packets and flows
def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.assign_flows(fl.clean_packets(fx.packets(spark, sf_dir)))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow table for downstream operators: written once under the checkpoint folder, so
    consumers (verdicts, profiles, enrichment, alerts) read ~1 row per flow instead of
    re-running flow assembly, and stages stay small enough for whole-stage codegen."""
    from .plans.stage import materialize
    return materialize(fl.flow_features(assigned(spark, sf_dir)), "flows")


@register("packets_clean", "SELECT * FROM (" + fx.PACKETS_LOOPBACK_SQL + ") t "
          "WHERE ip_version IN (4, 6) AND NOT (starts_with(src_ip, '127.') OR starts_with(dst_ip, '127.'))")
def q_packets_clean(spark, sf_dir):
    """S2 + P1 + P2: packet table with injected loopback rows removed."""
    return fl.clean_packets(fx.packets(spark, sf_dir, with_loopback=True))


@register("flags_decoded", "SELECT packet_id, " + ", ".join(
    f"(tcp_flags & {m}) <> 0 AS {n}" for n, m in fl.config.TCP_FLAG_BITS) + " FROM (" + fx.PACKETS_SQL + ") t")
def q_flags_decoded(spark, sf_dir):
    """TCP flag bits -> booleans."""
    return fl.decode_flags(fx.packets(spark, sf_dir)).select("packet_id", *fl.FLAG_NAMES)


@register("flow_assignment", tfl.FLOW_ASSIGNMENT_SQL)
def q_flow_assignment(spark, sf_dir):
    """W1 + W2: packet -> flow id, direction, boundary."""
    return assigned(spark, sf_dir).select("packet_id", "flow_id", "fwd", "boundary")


@register("flow_iat", tfl.FLOW_IAT_SQL)
def q_flow_iat(spark, sf_dir):
    """Inter-arrival gaps per flow and per direction (µs)."""
    return assigned(spark, sf_dir).select("packet_id", "flow_id", F.col("flow_iat_us").cast("double"),
                                          F.col("dir_iat_us").cast("double"))


@register("flow_active_idle", tfl.FLOW_ACTIVE_IDLE_SQL)
def q_flow_active_idle(spark, sf_dir):
    """Idle gaps and the active periods they close (µs)."""
    return (assigned(spark, sf_dir).filter(F.col("idle_us").isNotNull())
            .select("packet_id", "flow_id", "idle_us", "active_us"))


@register("flow_features", tfl.FLOW_FEATURES_SQL)
def q_flow_features(spark, sf_dir):
    """A1: the 77 flow features per flow."""
    return fl.flow_features(assigned(spark, sf_dir))
