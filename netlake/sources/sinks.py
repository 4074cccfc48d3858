"""Event-log, CSV and alert sinks (S5, S6, S9 writer hooks)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import round_bin
from ..operators.enrich import GEO_FIELDS


def log_records(events: DataFrame) -> DataFrame:
    """The nested log record (timestamp text, epoch 3 dp, verdict, scores, whole geo record, threat with host exposure)."""
    cols = events.columns
    out = [F.date_format(F.timestamp_micros("last_seen_us"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
           round_bin(F.col("last_seen_us") / F.lit(1e6), 3).alias("ts_epoch"),
           "src_ip", "dst_ip", "dst_port", "label", "severity", "confidence", "rule_triggered", "recommendation"]
    if "scores" in cols:
        out.append("scores")
    geo = [c for c in GEO_FIELDS if f"geo_{c}" in cols]
    if geo:
        out.append(F.struct(*[F.col(f"geo_{c}").alias(c) for c in geo]).alias("geo"))
    threat = [(c, n) for c, n in (("rep_abuse_score", "abuse_score"), ("rep_is_known_bad", "is_known_bad"), ("rep_total_reports", "total_reports"), ("rep_exposure", "shodan")) if c in cols]
    if threat:
        out.append(F.struct(*[F.col(c).alias(n) for c, n in threat]).alias("threat"))
    return events.select(*out)


def write_events(records: DataFrame, path: str, max_records_per_file: int = 50_000) -> None:
    """JSON lines, rolled by record count (the reference rolls a 10 MB file 5 times)."""
    records.write.mode("append").option("maxRecordsPerFile", max_records_per_file).json(path)


def export_rows(records: DataFrame) -> DataFrame:
    """S6 pre-write frame: drop ``scores``; nested cells become JSON text."""
    keep = [c for c in records.columns if c != "scores"]
    out = []
    for c in keep:
        t = records.schema[c].dataType
        out.append(F.to_json(F.col(c)).alias(c) if isinstance(t, (T.StructType, T.MapType, T.ArrayType)) else F.col(c))
    return records.select(*out)


def export_csv(records: DataFrame, path: str) -> None:
    """Header CSV of the log without scores; quotes inside a cell are doubled."""
    export_rows(records).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def table_writer(path: str):
    """S9 writer hook for ``foreachBatch``: append each micro-batch as parquet."""
    def write(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)
    return write
