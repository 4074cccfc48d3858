"""Registered queries of this folder: each applies its operator, with production parameters, to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import decontaminate, filter_audit, language_crf, line_dedup, ngram_jaccard, packing, prefix_trie, quality_eb, secret_scan, simhash_ball, spotsigs, toxicity, training_order
from .tokens import public_bpe

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_ngram_jaccard", None)
def op1(spark, sf_dir):
    """Components of documents that share 85 of 100 four-word shingles."""
    return ngram_jaccard.ngram_jaccard(table(spark, sf_dir, "documents"))


@register("op4_secret_scan", None)
def op4(spark, sf_dir):
    """Secret spans of every text, scanned once per distinct content."""
    paths, findings, _ = secret_scan.scan(table(spark, sf_dir, "documents"))
    d = secret_scan.path_digest(paths, findings)
    return d.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


@register("op5_packing", None)
def op5(spark, sf_dir):
    """Every document as pieces of sequences of at most 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_bpe())


@register("op9_line_dedup", line_dedup.oracle())
def op9(spark, sf_dir):
    """Repeated line runs cut from every document, as digests."""
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.size("lines_removed").cast("long").alias("n_removed"), F.array_join(F.transform("lines_removed", lambda i: i.cast("string")), ",").alias("removed"), F.md5("text").alias("kept_md5"))


@register("op3_decontaminate", None)
def op3(spark, sf_dir):
    """Benchmark items found in documents, with edits and span."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op8_toxicity", None)
def op8(spark, sf_dir):
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model).select("doc_id", language_crf.held_out().alias("held_out"), "score", "predicted")


@register("op10_language_crf", None)
def op10(spark, sf_dir):
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language_crf.predict(docs, language_crf.fit(docs)).select("doc_id", language_crf.held_out().alias("held_out"), "lang_pred", "score")


@register("op2_spotsigs", None)
def op2(spark, sf_dir):
    """Fingerprints of every text and of its edited text, and their likeness."""
    return spotsigs.fingerprints_with_edits(table(spark, sf_dir, "documents"))


@register("op6_quality_eb", None)
def op6(spark, sf_dir):
    """Quality score of every document from its text, host and path."""
    return quality_eb.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_training_order", None)
def op7(spark, sf_dir):
    """Every training sequence as a record at its global slot."""
    return training_order.training_records(table(spark, sf_dir, "documents"), public_bpe())


@register("op11_simhash_ball", None)
def op11(spark, sf_dir):
    """SimHash of every document and the component of those within four bits."""
    return simhash_ball.simhash_near(table(spark, sf_dir, "documents"))


@register("op13_filter_audit", filter_audit.oracle())
def op13(spark, sf_dir):
    """Five filters in all orders: what each step keeps, removes and loses, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op12_prefix_trie", prefix_trie.oracle())
def op12(spark, sf_dir):
    """Prefix trie of the rebuilt conversations, a row per node."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@register("spotsigs_join", None)
def spotsigs_join(spark, sf_dir):
    """The pruned SpotSigs join: a row per document with its class of equal spots, that class's size and its links to other classes."""
    pairs, classes = spotsigs.similar_documents(table(spark, sf_dir, "documents"))
    links = pairs.select("a").union(pairs.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n"))
    size = classes.groupBy("class_id").agg(F.count("*").alias("n_members"))
    return classes.join(size, "class_id").join(links, F.col("class_id") == F.col("a"), "left").select("doc_id", "class_id", "n_members", F.coalesce("n", F.lit(0)).alias("n_links"))
