"""Isolation forest (M6): not in pyspark.ml, built from Spark primitives.

* Train: a tree's sample is the ``psi`` rows with the smallest hash of row and
  tree, the same at every size, order and partitioning of the data (equal rows are told apart by a
  copy number).  A bound on the hash leaves a few more than ``psi`` rows per tree; ``groupBy(tree_id).applyInPandas``
  takes the smallest and grows one isolation tree per group (bounded by psi).  Trees come
  back as a written node table (tree_id, node, feature, threshold, left, right, size).
* Score: trees are packed a row each, and broadcast in chunks whose node count is bounded
  (``max_nodes_per_pass``).  One Arrow pass scores a block of rows with one chunk after the other and
  holds one chunk at a time.  score = -2^(-E[h] / c(psi)) (Liu, Ting, Zhou
  2008), the ``score_samples`` convention; the cut is the contamination
  quantile of training scores.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dataset import feature_ranges
from ..plans.stage import materialize, release
from .boosting import BLOCK, _matrix, joined, one_at_a_time

EULER = 0.5772156649

NODE_SCHEMA = T.StructType([T.StructField(n, t, False) for n, t in [
    ("tree_id", T.IntegerType()), ("node", T.IntegerType()), ("feature", T.IntegerType()),
    ("threshold", T.DoubleType()), ("left", T.IntegerType()), ("right", T.IntegerType()), ("size", T.LongType())]])


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]   # rows, depth, parent, side
    while stack:
        idx, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(idx)])
        if parent >= 0:
            nodes[parent][3 if side == 0 else 4] = me
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            continue
        f = int(rng.choice(cand))
        thr = float(rng.uniform(lo[f], hi[f]))
        nodes[me][1], nodes[me][2] = f, thr
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        stack.append((right, depth + 1, me, 1))
        stack.append((left, depth + 1, me, 0))
    return nodes


COPIES_A_RUN = 1 << 14


def fit_iforest(df: DataFrame, features: list[str], n_trees: int = 300, max_samples: int = 80_000,
                seed: int = 42) -> tuple[DataFrame, int]:
    """Grow ``n_trees`` isolation trees on ``df``; returns (node table, psi)."""
    seen = feature_ranges(df, [F.col(c) for c in features])
    n = df.count()
    # a feature of one value is never cut: samples travel and are held without it
    vary = [i for i, (lo, hi, _) in enumerate(seen) if lo != hi]
    cut = [features[i] for i in vary]
    psi = int(min(n, max_samples))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    # rows of one value and no null in a feature are not told apart by it
    keys = [c for c, (lo, hi, nulls) in zip(features, seen) if lo != hi or (nulls and lo is not None)]
    whole = [F.col(c) if c in keys else F.lit(lo).cast("double") for c, (lo, _, _) in zip(features, seen)]
    rows = df.groupBy(*[F.col(c).cast("double").alias(c) for c in keys]).count().filter("count > 0")
    # copies are numbered per value; many copies of one value are dealt to tasks in runs first
    run = F.lit(COPIES_A_RUN)
    rows = rows.select(*keys, "count", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {COPIES_A_RUN}"))).alias("_run"))
    rows = rows.repartition(F.xxhash64(*keys, "_run"))
    rows = rows.select(*keys, F.explode(F.sequence(F.col("_run") * run + 1, F.least("count", (F.col("_run") + 1) * run))).alias("_copy"))
    rows = rows.select(*cut, F.xxhash64(*whole, "_copy").alias("_row"))

    names = NODE_SCHEMA.names
    kinds = [pa.int32()] * 3 + [pa.float64()] + [pa.int32()] * 2 + [pa.int64()]

    def build(sample: pa.Table) -> pa.Table:
        tid = sample.column("tree_id")[0].as_py()
        first = np.argsort(sample.column("_h").to_numpy(), kind="stable")[:psi]
        x = np.empty((len(first), len(cut)))
        for j, c in enumerate(cut):
            x[:, j] = sample.column(c).to_numpy()[first]        # a column at a time: one copy of the sample is held
        rng = np.random.default_rng(seed * 100003 + tid)
        grown = list(zip(*_grow(x, rng, max_depth)))
        grown[1] = np.array(vary + [-1])[np.array(grown[1])]    # -1 stays -1
        return pa.table([pa.array(v, k) for v, k in zip([[tid] * len(grown[0]), *grown], kinds)], names)
    share = (psi + 6.0 * math.sqrt(psi) + 64) / max(n, 1)   # six standard deviations more than psi rows a tree
    while True:
        bound = F.lit(int(-2 ** 63 + share * 2 ** 64) if share < 1 else 2 ** 63 - 1)
        trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.xxhash64(F.col("_row"), t) <= bound)
        smp = rows.select(*cut, "_row", F.explode(trees).alias("tree_id"))
        smp = smp.select(*cut, "tree_id", F.xxhash64("_row", "tree_id").alias("_h"))
        nodes = materialize(smp.groupBy("tree_id").applyInArrow(build, NODE_SCHEMA), "iforest-nodes")
        full = nodes.filter((F.col("node") == 0) & (F.col("size") == psi)).count()
        if full == n_trees or share >= 1:
            return nodes, psi
        share *= 2                              # a tree fell short of psi rows


def _packed(g: pd.DataFrame) -> tuple:
    """A tree in 14 bytes a node: feature (-1 on a leaf), threshold or a leaf's c(size), right child; the left child is the next node."""
    feature = g["feature"].to_numpy()
    assert (g["left"].to_numpy()[feature >= 0] == np.flatnonzero(feature >= 0) + 1).all()
    size = g["size"].to_numpy()
    value = g["threshold"].to_numpy().copy()
    sizes, which = np.unique(size[feature < 0], return_inverse=True)
    value[feature < 0] = np.array([c_factor(x) for x in sizes])[which]
    return feature.astype(np.int16), value, g["right"].to_numpy().astype(np.int32)


PACKED_SCHEMA = "tree_id int, n int, feature binary, value binary, right binary"


def _pack(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("node")
    return pd.DataFrame([(g["tree_id"].iloc[0], len(g), *[a.tobytes() for a in _packed(g)])], columns=["tree_id", "n", "feature", "value", "right"])


def _path_sums(trees, x: np.ndarray) -> np.ndarray:
    """Each row's path lengths in ``trees``, added up; all rows still on their way stand on the same level."""
    n, width = x.shape
    flat, total = x.reshape(-1), np.zeros(n)
    for feature, value, right in trees:
        rows, node, level = np.arange(n), np.zeros(n, np.int64), 0
        base = rows * width
        while True:
            f = feature.take(node)
            on = f >= 0
            keep = np.flatnonzero(on)
            if len(keep) < n:
                done = np.flatnonzero(~on)
                total[rows.take(done)] += level + value.take(node.take(done))
                if not len(keep):
                    break
                rows, node, base, f = rows.take(keep), node.take(keep), base.take(keep), f.take(keep)
            node = np.where(flat.take(base + f) < value.take(node), node + 1, right.take(node))
            level += 1
    return total


def _scorer(chunks: list, width: int):
    most = max(min(BLOCK, (32 << 20) // (8 * width)), 1)

    @F.arrow_udf("double")
    def add_paths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for held in joined(batches, most):
            x, at = np.concatenate([_matrix(b, width) for b in held]), 0
            total = np.zeros(len(x))
            for trees in one_at_a_time(chunks):
                total = total + _path_sums(trees, x)
                del trees
            for b in held:
                yield pa.array(total[at:at + len(b)])
                at += len(b)
    return add_paths


def score_iforest(spark: SparkSession, df: DataFrame, nodes: DataFrame, psi: int, features: list[str],
                  out: str = "iso_score", max_nodes_per_pass: int = 2_000_000) -> DataFrame:
    """Add ``out`` = -2^(-mean path length / c(psi)) to every row of ``df``."""
    packed = materialize(nodes.groupBy("tree_id").applyInPandas(_pack, PACKED_SCHEMA), "iforest-packed")
    counts = {r["tree_id"]: r["n"] for r in packed.select("tree_id", "n").collect()}
    tree_ids = sorted(counts)
    chunks, cur, size = [], [], 0
    for t in tree_ids:
        if cur and size + counts[t] > max_nodes_per_pass:
            chunks.append(cur)
            cur, size = [], 0
        cur.append(t)
        size += counts[t]
    if cur:
        chunks.append(cur)
    # rows go to Python with the features that some tree cuts
    used = sorted(r[0] for r in nodes.filter("feature >= 0").select("feature").distinct().collect()) or [0]
    where = np.full(len(features) + 1, -1, np.int64)        # the last for a leaf's -1
    where[used] = np.arange(len(used))
    vec = F.array(*[F.coalesce(F.col(features[i]).cast("double"), F.lit(0.0)) for i in used])
    sent = []
    for chunk in chunks:
        rows = packed.filter(F.col("tree_id").isin(chunk)).collect()        # <= max_nodes_per_pass nodes, 14 bytes each
        sent.append(spark.sparkContext.broadcast([
            (where.take(np.frombuffer(r["feature"], np.int16)).astype(np.int16), np.frombuffer(r["value"], np.float64), np.frombuffer(r["right"], np.int32))
            for r in sorted(rows, key=lambda r: r["tree_id"])]))
        del rows
    release(packed)
    n_trees = len(tree_ids)
    cn = c_factor(psi)
    d = df.withColumn("_iso_sum", _scorer(sent, len(used))(vec) if sent else F.lit(0.0))
    return d.withColumn(out, -F.pow(F.lit(2.0), -(F.col("_iso_sum") / F.lit(float(n_trees))) / F.lit(cn))).drop("_iso_sum")
