"""Quality classifier: document evidence combined with host and path posteriors (hierarchical empirical Bayes).

A logistic classifier over text statistics, trained on a bounded sample of labelled
rows, gives each document a probability under the global prior.  Hosts and
paths (a section of a host) have posterior mean qualities: sums of those probabilities, shrunk
towards the level above by pseudo-counts that the spread between sites gives.  A document's score is its
own odds times the odds its path (the document itself left out) has over the global prior.

Scale.  One text pass yields a few numbers a row; the rest is grouped sums, pre-aggregated
before their shuffle, so a host with a third of all rows costs a row per task.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import materialize
from .language_crf import held_out
from .spotsigs import _ANCHOR
from .textops import LOWER, blocks, buffers, span_hash, word_spans

PER_CLASS = 4000
_KIND = np.zeros(256, np.int64)  # 0 other sign, 1 lower, 2 upper, 3 digit, 4 space, 5 line end
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91], _KIND[48:58], _KIND[[32, 9, 11, 12, 13]], _KIND[10] = 2, 3, 4, 5
NAMES = ["bias", "size", "signs", "upper", "digits", "common", "distinct", "word_length", "runs", "distinct_lines", "stops"]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` per text, each about 0 to 1."""
    n_docs, size = len(off) - 1, np.maximum(np.diff(off), 1)
    kind = _KIND[data]
    cum = lambda mask: (lambda c: c[off[1:]] - c[off[:-1]])(np.concatenate(([0], np.cumsum(mask))))
    low = LOWER[data]
    s, e, ptr = word_spans((kind == 1) | (kind == 2) | (kind == 3), off)
    h = span_hash(low, s, e)
    words = np.maximum(np.diff(ptr), 1)
    doc = np.repeat(np.arange(n_docs), np.diff(ptr))
    at = np.searchsorted(_ANCHOR, h)
    at[at == len(_ANCHOR)] = 0
    per = lambda x: np.bincount(doc, x, n_docs) / words
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    one = np.unique(np.stack((doc.astype(np.uint64), h), 1), axis=0)[:, 0].astype(np.int64) if len(h) else doc
    ls, le, lptr = word_spans(kind != 5, off)
    line_doc = np.repeat(np.arange(n_docs), np.diff(lptr))
    lh = span_hash(data, ls, le)
    lone = np.unique(np.stack((line_doc.astype(np.uint64), lh), 1), axis=0)[:, 0].astype(np.int64) if len(lh) else line_doc
    stop = (data == 46) | (data == 44)
    return np.stack([
        np.ones(n_docs), np.log1p(np.diff(off)) / 10, cum((kind == 0) & ~stop) / size, cum(kind == 2) / size, cum(kind == 3) / size, per((_ANCHOR[at] == h).astype(float)),
        np.bincount(one, minlength=n_docs) / words, per((e - s).astype(float)) / 10, per(again.astype(float)), np.bincount(lone, minlength=n_docs) / np.maximum(np.diff(lptr), 1), cum(stop) / words,
    ], 1)


def _expand(x: np.ndarray) -> np.ndarray:
    """Statistics, their squares and pairwise products."""
    i, j = np.triu_indices(x.shape[1])
    return x[:, i] * x[:, j]


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    z, w = _expand(x), np.zeros(x.shape[1] * (x.shape[1] + 1) // 2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + l2 * np.eye(len(w)), z.T @ (weight * (y - p)) - l2 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-5:
            break
    return w


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = buffers(batch.column(1))
        x = [statistics(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in blocks(off)]
        if x:
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:4], pa.array(list(np.concatenate(x)), pa.list_(pa.float64()))], names=["doc_id", "host", "path", "x"])


def _evidence(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
                p = 1 / (1 + np.exp(-np.clip(_expand(x) @ w, -12, 12)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], names=["doc_id", "host", "path", "evidence"])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str | None = "lang", label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, held_out, evidence, host_mean, path_mean, score, keep)`` per row; ``keep`` is 1 for a score of 0.5 or more.

    Labels are learned from about ``per_class`` rows a class that are not held out; without both classes all evidence is 0.5.  A null
    host or path is a site of its own; a null or empty text is judged by its statistics (all zero);
    repeated rows count as rows; other columns are ignored; an empty table gives no rows.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    stats = materialize(rows.mapInArrow(_stats, "doc_id long, host string, path string, x array<double>"), "stats")
    lab = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(~held_out() & F.expr("y is not null"))
    counts = {r.y: r.n for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row a class
    w = np.zeros(len(NAMES) * (len(NAMES) + 1) // 2)
    if len(counts) > 1:
        share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1 << 30, (per_class << 30) // n)))])
        got = stats.join(F.broadcast(lab.where(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 30)) < share[F.col("y")])), "doc_id").select("doc_id", "x", "y").collect()
        got.sort(key=lambda r: (r.doc_id, r.y))
        y = np.array([float(r.y == 1) for r in got])
        if 0 < y.sum() < len(y):
            good = counts.get(1, 0) / sum(counts.values())
            w = train(np.array([r.x for r in got]), y, np.where(y > 0, good / y.mean(), (1 - good) / (1 - y.mean())))
    ev = materialize(stats.mapInArrow(_evidence(w), "doc_id long, host string, path string, evidence double"), "evidence")
    site = ev.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s"))
    site = materialize(site, "sites")
    hosts = site.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = site.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total.n:
        prior, host_weight, path_weight = 0.5, 10.0, 10.0
    else:
        prior = min(max(total.s / total.n, 1e-4), 1 - 1e-4)
        host_weight = _pseudo(hosts.select(F.col("hn").alias("n"), (F.col("hs") / F.col("hn")).alias("m")), F.lit(prior), prior)
        path_weight = _pseudo(site.join(hosts, "host").select("n", (F.col("s") / F.col("n")).alias("m"), (F.col("hs") / F.col("hn")).alias("up")), F.col("up"), prior)
    means = site.join(hosts, "host").select("host", "path", "n", "s", "hn", "hs")
    out = ev.join(means, ["host", "path"])
    host_mean = (F.col("hs") - F.col("evidence") + host_weight * prior) / (F.col("hn") - 1 + host_weight)
    out = out.withColumn("host_mean", host_mean).withColumn("path_mean", (F.col("s") - F.col("evidence") + path_weight * F.col("host_mean")) / (F.col("n") - 1 + path_weight))
    odds = lambda c: F.log(c / (1 - c))
    z = odds(F.col("evidence")) + odds(F.expr("greatest(least(path_mean, 0.9999), 0.0001)")) - odds(F.lit(prior))
    return out.withColumn("score", 1 / (1 + F.exp(-z))).select("doc_id", held_out().alias("held_out"), "evidence", "host_mean", "path_mean", "score", (F.col("score") >= 0.5).cast("int").alias("keep"))


def _pseudo(sites: DataFrame, centre, prior: float) -> float:
    """Pseudo-count by moments: the spread of site means beyond what their row counts explain; 2 to 1000."""
    r = sites.agg(F.sum(F.col("n") * F.pow(F.col("m") - centre, 2)).alias("q"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.pow(F.col("n"), 2)).alias("n2")).first()
    room = prior * (1 - prior)
    spread = (r.q - max(r.k - 1, 0) * room) / max(r.n - r.n2 / r.n, 1e-9) if r.n else 0.0
    return float(min(max(room / max(spread, 1e-9) - 1, 2.0), 1000.0))
