"""Corpus pipeline over ``documents``: language ID, line dedup, near duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor
kept; all but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlake.llm import decontaminate, language_crf, line_dedup, ngram_jaccard, packing
from netlake.llm.tokens import public_bpe
from netlake.plans.stage import materialize
from netlake.session import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; texts without letters or without a leading language go."""
    ship_package(spark)
    return language_crf.accepted(docs, language_crf.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut from the texts; a text of which nothing is left goes."""
    ship_package(spark)
    out = line_dedup.dedup_lines(docs)
    out = out.where((F.size("lines_removed") == 0) | (F.trim(F.regexp_replace("text", "\\s+", " ")) != ""))
    changed = F.when(F.size("lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that links connect (four of five shingles of five words alike), one stays: that with the smallest id.

    Rows, not ids, are grouped: of copies under one id or under null ids one stays too, and different texts under
    one id are judged each.  A null id counts as the largest.  Rows without words are in no group.
    """
    ship_package(spark)
    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any column: prefixed names are free
    row, group = free + "row", free + "group"
    # numbered once and written: row numbers must not change when a task runs again
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = ngram_jaccard.ngram_jaccard(rows, id_col=row, width=5, num=80).select(row, F.col("component_id").alias(group))
    members = rows.select(row, F.col("doc_id").alias(free + "id")).join(groups, row)
    stays = members.groupBy(group).agg(F.min(F.struct(F.col(free + "id").isNull().alias("unknown"), F.col(free + "id"), F.col(row))).getField(row).alias(row))
    return rows.join(stays.select(row), row, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    ship_package(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of training sequences."""
    ship_package(spark)
    return packing.pack(docs, public_bpe())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("packed", packed)]
#: Language and token stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet below ``spark.checkpoint.dir`` and read again as the next one's input."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
