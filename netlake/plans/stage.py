"""Lineage cuts: write an intermediate result as parquet under the shared
checkpoint folder and continue from the written table.

Multi-pass operators (the bucketed scans) read their input twice — once for
the row window, once for the bucket summary.  Cutting the lineage in front of
each pass keeps the plan linear in the number of passes and lets the summary
branch read only the columns it needs.  The folder comes from the session's
``spark.checkpoint.dir`` (see ``session.checkpoint_dir``), never a machine-local
path on a cluster.  ``release`` deletes a cut once what was made from it is
itself written.
"""
from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame

from ..session import checkpoint_dir


def materialize(df: DataFrame, tag: str = "stage", by: str | None = None) -> DataFrame:
    """Write ``df`` to ``<checkpoint dir>/netlake/<tag>-<uuid>`` and read it back.

    With ``by``, a column of few values and no nulls, each value has a folder: a filter on it reads no other rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/netlake/{tag}-{uuid.uuid4().hex}"
    out = df.write.mode("overwrite")
    if by is None:
        out.parquet(path)
        return spark.read.parquet(path)
    out.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)       # no rows leave no file to take a schema from


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more.

    Call it only when every result derived from them has been written.  Paths
    outside the cut folder are left alone.  Shuffle files of finished jobs go
    when the driver collects its garbage, so it is asked to.
    """
    for df in tables:
        spark = df.sparkSession
        own = f"{checkpoint_dir(spark).rstrip('/')}/netlake/".split(":", 1)[-1].replace("//", "/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if own in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        spark._jvm.System.gc()
