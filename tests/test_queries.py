"""Registered queries against their DuckDB twins on the smallest scale, and the entry point."""
import duckdb
import pytest

import __spark_entry__ as ent

from conftest import SF001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
FAST = ["packets_clean", "flow_features", "verdicts", "dns_alerts", "dns_rate", "geo_enriched", "reputation_asof",
        "alerts_throttled", "strikes", "honeypot_top_ips", "throughput", "posture", "label_stats",
        "geo_prefix_match", "ip_profiles_idle", "event_block_state", "stream_dns_alerts", "stream_late_rows", "capture_stream", "split_gains"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(r[c]) for c in cols) for r in df.to_dict("records")), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    s = ent.queries()[name](spark, SF001).toPandas()
    d = con.execute(ent.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert _rows(s) == _rows(d)


def test_entry_smoke(spark):
    df = ent.entry(spark)
    assert df.count() >= 0 and "label" in df.columns


def test_every_query_has_callable_and_docs():
    q, o = ent.queries(), ent.oracle_sql()
    assert set(o) <= set(q)
    assert all(fn.__doc__ for fn in q.values())
