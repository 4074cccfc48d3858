"""Labelled flow CSV source."""
from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_flow_csv(spark: SparkSession, paths: list[str], max_rows_per_file: int | None = None) -> DataFrame:
    """Read each CSV (header, UTF-8, every column as text) and union them by name.

    Missing paths are skipped; none readable -> error.  ``max_rows_per_file``
    keeps the first rows of each file (the reference's fast mode).
    """
    frames = []
    for p in paths:
        try:
            df = (spark.read.option("header", True).option("encoding", "UTF-8").option("inferSchema", False)
                  .option("mode", "PERMISSIVE").csv(p))
            df.schema  # resolve now so a missing path is skipped here
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            warnings.warn(f"skipping {p}: no such path")
            continue
        if max_rows_per_file is not None:
            df = df.limit(max_rows_per_file)
        frames.append(df)
    if not frames:
        raise FileNotFoundError(f"no readable flow CSV among {paths}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
