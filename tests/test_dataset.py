"""Labelled-CSV source and cleaning rules."""
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from netlake import config
from netlake import fixtures as fx
from netlake.operators import dataset as ds
from netlake.sources.flow_csv import read_flow_csv


def test_header_fallback_steps():
    plan = ds.header_plan([" Flow Duration", "Flow Duration ", "Total Fwd Packets", "flow iat mean", " Label", "x"])
    assert plan[" Flow Duration"] == "flow_duration"          # exact
    assert plan["Flow Duration "] == "flow_duration"          # ' ' + strip
    assert plan["Total Fwd Packets"] == "total_fwd_packets"   # ' ' + strip
    assert plan["flow iat mean"] == "flow_iat_mean"           # case-insensitive
    assert plan[" Label"] == "label_raw" and "x" not in plan


def test_clean_rules_and_source(spark):
    d = tempfile.mkdtemp(prefix="netlake-csv-")
    a, b = os.path.join(d, "a.csv"), os.path.join(d, "b.csv")
    with open(a, "w", encoding="utf-8") as fh:
        fh.write(" Flow Duration, Fwd IAT Min, Init_Win_bytes_backward,Flow Bytes/s, Label\n")
        fh.write("10,-1,-5,3.5,BENIGN\n20,-2,7,Infinity,DDoS\n30,1,1,,PortScan\n40,2,2,1.0, Bot \n")
    with open(b, "w", encoding="utf-8") as fh:
        fh.write("Flow Duration,Label\n50,Something New\n60,BENIGN\n")
    raw = read_flow_csv(spark, [a, os.path.join(d, "missing.csv"), b], max_rows_per_file=None)
    rows = sorted(ds.clean_flows(raw).collect(), key=lambda r: r["flow_duration"])
    # Inf and empty cells dropped; file b lacks columns that file a has, so after the
    # union its rows hold nulls there and are dropped too (as concat + dropna does)
    assert [r["flow_duration"] for r in rows] == [10.0, 40.0]
    assert [r["label"] for r in rows] == [0, 3]                                 # ' Bot ' is trimmed before mapping
    assert rows[0]["fwd_iat_min"] == -1.0 and rows[0]["init_win_bytes_backward"] == 0.0   # iat kept, other clipped
    assert rows[0]["flow_iat_mean"] == 0.0                                      # absent everywhere -> 0.0
    st = ds.clean_stats(raw).first()
    assert (st["rows_before"], st["rows_after"], st["unmapped_labels"]) == (6, 2, 1)
    capped = read_flow_csv(spark, [a, b], max_rows_per_file=1)
    assert capped.count() == 2
    with pytest.raises(FileNotFoundError):
        read_flow_csv(spark, [os.path.join(d, "none.csv")])


def _flow_rows(spark, rows, parts=3):
    zero = [F.lit(0.0).alias(c) for c in config.FEATURE_NAMES[1:]]
    raw = spark.createDataFrame(rows, "flow_duration double, label int").repartition(parts)
    return raw.select("flow_duration", *zero, "label")


@pytest.mark.parametrize("fraction", [0.2, 0.0, 1.0])
def test_split_takes_the_smallest_hashes_and_moves_no_wide_rows(spark, fraction):
    rows = [(float(i % 97), i % 3) for i in range(600)] + [(5.0, 7)] * 400 + [(1.0, None)]
    df = _flow_rows(spark, rows)
    split = ds.stratified_split(df, fraction)
    got = split.select("label", "h1", "h2", "is_test").collect()
    assert len(got) == 1000
    for label in (0, 1, 2, 7):
        mine = sorted((r["h1"], r["h2"], r["is_test"]) for r in got if r["label"] == label)
        n = math.ceil(len(mine) * fraction)
        assert sum(t for *_, t in mine) == n
        assert sorted(m[:2] for m in mine if m[2]) == [m[:2] for m in mine][:n]
    wide = [line for line in split.filter("label <> 7")._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert len(wide) <= 2       # the scan of tied rows alone


def test_csv_tables_have_a_file_a_task(spark, tmp_path):
    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double"
    rows = [(i, i % 7 + 1, i, float(i), 1.5, 0.1) for i in range(400)]
    spark.createDataFrame(rows, cols).repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))       # a file a task
    try:
        paths = fx.flow_csv_paths(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert [len(spark.read.text(p).inputFiles()) for p in paths] == [4, 4]
    assert read_flow_csv(spark, paths).count() == 400
