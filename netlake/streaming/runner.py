"""Run a Structured Streaming query to completion over staged files.

Input rows are written as a sequence of parquet files in time order; the
file source reads one file per micro-batch (``maxFilesPerTrigger=1``), so a
stateful query sees several batches.  ``trigger(availableNow=True)`` drains
them and stops.  Results land in a parquet table under the checkpoint folder
and come back as a batch DataFrame.  All folders come from
``spark.checkpoint.dir``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


LAST_RUN: dict = {}        # T9 accounting of the last run_to_table call


def _base(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/netlake/stream-{tag}-{uuid.uuid4().hex}"


def stage_files(df: DataFrame, ts_col: str, n_files: int, tag: str, end_marker: dict | None = None) -> str:
    """Write ``df`` as ``n_files`` parquet files of consecutive time ranges (oldest first).

    ``end_marker`` (column -> value) appends one last file with a single row
    far in the future; its only job is to move the watermark past every open
    group so event-time timeouts flush them at end of input.
    """
    spark = df.sparkSession
    base = _base(spark, tag) + "/in"
    bounds = df.agg(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi")).first()
    lo, hi = int(bounds["lo"]), int(bounds["hi"])
    step = max((hi - lo) // n_files + 1, 1)
    for i in range(n_files):
        part = df.filter((F.col(ts_col) >= lo + i * step) & (F.col(ts_col) < lo + (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(base)
    if end_marker is not None:
        # two marker files: the first moves the watermark, the second is a
        # data batch that runs with the moved watermark, so windows and
        # timeouts close even where no trailing no-data batch is scheduled
        for bump in (0, 1):
            row = {c: end_marker.get(c) for c in df.columns}
            if ts_col in row and row[ts_col] is not None:
                row[ts_col] = int(row[ts_col]) + bump
            marker = spark.createDataFrame([tuple(row[c] for c in df.columns)], df.schema)
            marker.coalesce(1).write.mode("append").parquet(base)
    return base


def add_file(df: DataFrame, path: str) -> None:
    """One more input file, to be read after those that are there."""
    df.coalesce(1).write.mode("append").parquet(path)


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_table(stream: DataFrame, tag: str, output_mode: str = "append", conf: dict | None = None) -> DataFrame:
    """Drain ``stream`` with availableNow into parquet; return the written rows.  ``conf`` holds for this query only."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or ()}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        return _drained(spark, stream, tag, output_mode)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _drained(spark: SparkSession, stream: DataFrame, tag: str, output_mode: str) -> DataFrame:
    base = _base(spark, tag)
    out, ck = base + "/out", base + "/checkpoint"
    if output_mode == "append":
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .outputMode("append").trigger(availableNow=True).start())
    else:
        def write(batch_df: DataFrame, batch_id: int) -> None:
            batch_df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)
        q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", ck).outputMode(output_mode)
             .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    progress = q.recentProgress
    LAST_RUN.clear()
    LAST_RUN.update({
        "tag": tag, "batches": len(progress),
        "input_rows": sum(int(p.get("numInputRows", 0)) for p in progress),
        # Rows later than the watermark are dropped by the stateful operator and counted here
        "late_rows_dropped": sum(int(so.get("numRowsDroppedByWatermark", 0))
                                 for p in progress for so in p.get("stateOperators", [])),
    })
    return spark.read.parquet(out)
