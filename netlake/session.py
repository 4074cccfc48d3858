"""Spark session defaults for the engine.

Time arithmetic is done on ``ts_us`` BIGINT microseconds; the session time
zone is pinned to UTC so timestamp <-> epoch conversions are stable.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles a method of over 8000 bytes, which a row of 77 features makes of one fused stage
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "netlake") -> SparkSession:
    """Build (or reuse) a session with the engine defaults; for tests and the bench."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("NETLAKE_DRIVER_MEMORY", "16g"))
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_engine_conf(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Set the SQL confs the operators rely on (safe to call on any session)."""
    for k, v in ENGINE_CONF.items():
        if k == "spark.ui.enabled":
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and model tables.

    Reads ``spark.checkpoint.dir`` from the session (a cluster names a shared
    folder there), else the context's checkpoint folder.  Where neither is set,
    a single-machine session gets a scratch folder of its own; on a cluster the
    call fails, because executors do not share the driver's disk.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="netlake-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Make ``netlake`` importable in Python workers (pandas UDFs, mapInPandas, streaming state).

    Zips the package once per SparkContext and registers it with ``addPyFile``,
    Spark's own mechanism for distributing Python code to executors.
    """
    import uuid
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_netlake_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="netlake-pkg-"), f"netlake-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    sc._netlake_shipped = True
