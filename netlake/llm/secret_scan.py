"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by its content (sha-256).  A ledger
of (blob, rule version) pairs says what has been scanned; only unseen pairs are
scanned, once per blob however many paths hold it, and findings join back to all
paths.  Positions come from two JVM functions: ``split`` gives the text between
matches, ``regexp_extract_all`` the matches, and running lengths give code-point spans.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import materialize

#: Rule -> (pattern, group that must be long enough, its least length, order in digests, version).
RULES = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, 0, 1),
    "access": ("AKIA[A-Z0-9]+", 0, 20, 1, 1),
    "hex": ("[0-9a-f]{24,}", 0, 24, 2, 1),  # every run of fewer characters would fail the length anyway
}


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """``array<struct<start, end>>`` of the leftmost non-overlapping matches whose group is long enough; ends exclusive, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    each = F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("hit"), F.transform(value, F.length).alias("val"))
    none = F.array().cast("array<struct<start:int,end:int,val:int>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("at"),
        F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["hit"]).alias("end"), x["val"].alias("val"))))).alias("out"))
    all_ = F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    hit = F.transform(F.filter(all_, lambda s: s["val"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), hit).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: dict | None = None, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(paths, findings, scanned)``.

    ``paths(path, blob)``: every version's content address (null text reads as empty).
    ``findings(blob, rule, version, start, end)``: spans of the blobs scanned now.
    ``scanned(blob, rule, version)``: the pairs to add to the ledger.  With a ``ledger``
    of such rows, blob and rule-version pairs in it are not scanned again.
    Rows with a null path keep it; repeated rows stay; other columns are ignored; empty tables give empty results.
    """
    rules = rules or RULES
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(F.col(path_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"))
    paths = materialize(rows.select("path", "blob"), "paths")
    todo = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        seen = ledger.join(F.broadcast(versions.sparkSession.createDataFrame([(r, v[4]) for r, v in rules.items()], "rule string, version int")), ["rule", "version"])
        old = seen.groupBy("blob").agg(F.collect_set("rule").alias("old"))
        todo = todo.join(old, "blob", "left").where(f"coalesce(size(old), 0) < {len(rules)}")
    else:
        todo = todo.withColumn("old", F.lit(None).cast("array<string>"))
    text_of = versions.select(F.col(path_col).alias("path"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
    todo = todo.select(F.col("path").alias("at"), F.col("blob").alias("of"), "old").hint("shuffle_hash")
    todo = text_of.join(todo, F.col("path").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("of"))).select("blob", "text", "old")
    fresh = lambda r: F.coalesce(~F.array_contains("old", r), F.lit(True))
    done = materialize(todo.select("blob", *[F.when(fresh(r), spans(F.col("text"), *v[:3])).alias(r) for r, v in rules.items()]).dropDuplicates(["blob"]), "findings")
    per_rule = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v[4]).alias("version"), F.col(r).alias("spans")) for r, v in rules.items()])
    flat = done.select("blob", F.explode(per_rule).alias("f")).where("f.spans is not null")
    findings = flat.select("blob", "f.rule", "f.version", F.explode("f.spans").alias("s")).select("blob", "rule", "version", "s.start", "s.end")
    return paths, findings, flat.select("blob", "f.rule", "f.version")


def path_digest(paths: DataFrame, findings: DataFrame, rules: dict | None = None) -> DataFrame:
    """One row per path: spans per rule counted, and all spans as ``kind:start:end`` by start, then rule order."""
    rules = rules or RULES
    rank = F.create_map(*[x for r, v in rules.items() for x in (F.lit(r), F.lit(v[3]))])
    per = findings.groupBy("blob").agg(
        *[F.count(F.when(F.col("rule") == r, 1)).alias(f"n_{r}") for r in rules],
        F.array_sort(F.collect_list(F.struct("start", rank[F.col("rule")].alias("k"), "end", "rule"))).alias("s"))
    per = per.withColumn("spans", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ","))
    out = paths.join(per.drop("s"), "blob", "left")
    return out.select("path", *[F.coalesce(f"n_{r}", F.lit(0)).cast("long").alias(f"n_{r}") for r in rules], F.coalesce("spans", F.lit("")).alias("spans"))
