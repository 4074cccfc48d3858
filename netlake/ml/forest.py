"""Random forest of classification trees (M4, M5, M8, O8): the algorithm of ``pyspark.ml``'s, without its memory.

Trees are as there: each row is drawn for each tree as often as a Poisson number of mean
one says, each node looks at the square root of the features, cuts lie between at most ``bins``
bins a feature, the largest drop of weighted Gini impurity wins, two leaves of one parent that
predict the same class are taken together, and trees vote with their leaves' shares.

``pyspark.ml`` holds a number of copies for every row and tree and visits every row for
each.  Here a number of copies is computed anew from row, tree and seed whenever it is
asked for, rows are written once as bins of the features that can be cut, by column and thousands to a cell, and
only rows below an open node are followed:

1. A level of all trees is one job: every task draws and routes its rows, by column and a node's
   together while they are many, and adds their weights into histograms of (open node, looked-at feature, bin, class).
2. The tasks' non-empty bins are summed; running sums give each cut's drop and the best cut
   of each node comes back.  A child's classes are known from its parent's cut, so nodes that
   look at no feature that can be cut are leaves without another look.

Weights are added as integers in units of 2^-20: the trees of the same written rows do not depend on
the order in which they are added.  Open nodes are taken in groups of at most ``CELLS`` histogram cells.
A null feature counts as NaN, which goes right; a null label or weight drops the training row.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import narrow_pass
from ..plans.stage import materialize, release
from .boosting import BLOCK, CELLS, NODES_PER_PASS, UNIT, _matrix, cells_of, follow, joined, one_at_a_time, row_blocks


@dataclass
class Tree:
    """Parallel node lists; ``feature`` -1 marks a leaf, the right child follows the left, ``classes`` are weights a class."""
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [0])
    gain: list = field(default_factory=lambda: [0.0])
    classes: list = field(default_factory=lambda: [None])

    def split(self, node: int, feature: int, cut: float, gain: float, left: list, right: list) -> int:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.gain[node], self.left[node] = feature, cut, gain, a
        for classes in (left, right):
            for col, v in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.gain, 0.0), (self.classes, classes)):
                col.append(v)
        return a

    def prune(self) -> "Tree":
        """Leaves of one parent that predict the same class are taken together, from the bottom up."""
        feature = list(self.feature)
        for n in range(len(feature) - 1, -1, -1):
            a = self.left[n]
            if feature[n] >= 0 and feature[a] < 0 and feature[a + 1] < 0 and np.argmax(self.classes[a]) == np.argmax(self.classes[a + 1]):
                feature[n] = -1
        kept, queue = Tree(classes=[self.classes[0]]), [(0, 0)]
        for old, new in queue:
            if feature[old] >= 0:
                a = self.left[old]
                b = kept.split(new, feature[old], self.cut[old], self.gain[old], self.classes[a], self.classes[a + 1])
                queue += [(a, b), (a + 1, b + 1)]
        return kept


# a row is drawn once more for each of these that its 32 random bits reach: a Poisson number of mean one
STEPS = [np.uint32(p * 2 ** 32) for p in np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]) if p * 2 ** 32 < 2 ** 32 - 1]


def _row_bits(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit halves of a 64-bit mix of the written row number."""
    z = row.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z.astype(np.uint32), (z >> np.uint64(32)).astype(np.uint32)


@lru_cache(4096)
def _key(tree: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, tree)).integers(0, 1 << 32, 2, dtype=np.uint32)


def _copies(low: np.ndarray, high: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for ``tree``, the same whenever it is asked for."""
    key = _key(tree, seed)
    z = low + key[0]
    t = z >> np.uint32(16)
    z ^= t
    z *= np.uint32(0x85EBCA6B)
    np.right_shift(z, np.uint32(13), out=t)
    z ^= t
    np.bitwise_xor(high, key[1], out=t)
    z += t
    z *= np.uint32(0xC2B2AE35)
    np.right_shift(z, np.uint32(16), out=t)
    z ^= t
    z *= np.uint32(0x7FEB352D)
    np.right_shift(z, np.uint32(15), out=t)
    z ^= t
    copies = np.zeros(len(z), np.uint8)
    for p in STEPS[:3]:
        copies += z >= p
    many = np.flatnonzero(z >= STEPS[3])            # one row in fifty
    if len(many):
        z = z.take(many)
        more = np.zeros(len(z), np.uint8)
        for p in STEPS[3:]:
            more += z >= p
        copies[many] += more
    return copies


def _number(name: str, i: int):
    """A feature by number, a null as NaN (as the assembler keeps it)."""
    return F.coalesce(F.col(name).cast("double"), F.lit(float("nan"))).alias(f"x{i}")


def _raw(df: DataFrame, features: list[str]) -> DataFrame:
    return df.select(*[_number(c, i) for i, c in enumerate(features)])


def _values(df: DataFrame, features: list[str], bins: int) -> list[tuple]:
    """Of each feature, by number, its least and largest value (NaN is the largest), whether it has more than ``bins`` values, and else which, in one job."""
    def over(first: int, width: int):
        def run(batches):
            lo, hi = np.full(width, np.nan), np.full(width, -np.inf)
            found: list = [np.array([], dtype=np.float64)] * width
            rows = 0
            for b in batches:
                rows += b.num_rows
                for i in range(width if b.num_rows else 0):
                    v = b.column(i).to_numpy()
                    low, high = np.fmin.reduce(v), v.max()          # NaN where all are, NaN where any is
                    lo[i], hi[i] = np.fmin(lo[i], low), np.maximum(hi[i], high)
                    if found[i] is None or (low == high and len(found[i]) == 1 and found[i][0] == low):
                        continue
                    found[i] = np.unique(np.concatenate([found[i], v[~np.isnan(v)]]))
                    if len(found[i]) > bins:
                        found[i] = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + width), pa.int32()), pa.array(lo, from_pandas=False), pa.array(hi, from_pandas=False),
                                                  pa.array([None if f is None else f.tolist() for f in found], pa.list_(pa.float64()))], ["i", "lo", "hi", "v"])
        return run

    told = narrow_pass(df, [_number(c, i) for i, c in enumerate(features)], [], over, "i int, lo double, hi double, v array<double>").groupBy("i").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.col("v").isNull()).alias("many"), F.array_distinct(F.flatten(F.collect_set("v"))).alias("v"))
    return sorted(tuple(r) for r in told.collect())         # a row a column, of at most ``bins`` values a task


def cut_points(df: DataFrame, features: list[str], bins: int, seen: list[tuple] | None = None) -> list[np.ndarray]:
    """``seen`` is what ``_values`` tells of ``df``, if known.  Where each feature can be cut: between its values where there are at most ``bins``, else at quantiles; none for a feature of one value."""
    x = _raw(df, features)
    vary, values = [], {}
    for i, lo, hi, many, v in seen or _values(df, features, bins):
        if lo is None or lo == hi:
            continue
        vary.append(i)
        if not many and len(v) <= bins:
            values[i] = sorted(v)
    points = [np.array([], dtype=np.float64)] * len(features)
    many = [i for i in vary if i not in values]
    for i, v in values.items():
        points[i] = (np.array(v[:-1]) + np.array(v[1:])) / 2
    if many:
        probs = [i / bins for i in range(1, bins)]
        for i, q in zip(many, x.approxQuantile([f"x{i}" for i in many], probs, 1.0 / (16 * bins))):
            points[i] = np.unique(np.array(q, dtype=np.float64))
    return points


def _binned(df: DataFrame, features: list[str], label: str, weight: str, vary: list[int], points: list[np.ndarray]) -> DataFrame:
    """Rows of number, class, weight and one byte for the bin of each feature that can be cut, written ``A_CELL`` to a cell."""
    src = df.filter(F.col(label).isNotNull() & F.col(weight).isNotNull())
    # only the features that can be cut are read
    src = src.select(F.monotonically_increasing_id().alias("row"), F.col(label).cast("int").alias("y"),
                     F.col(weight).cast("double").alias("w"), *[_number(features[i], i) for i in vary])

    def run(batches):
        for b in batches:
            if b.num_rows:
                q = np.zeros((max(len(vary), 1), b.num_rows), np.uint8)
                for j, i in enumerate(vary):
                    q[j] = np.searchsorted(points[i], b.column(3 + j).to_numpy(), side="left")
                yield pa.RecordBatch.from_arrays(cells_of(*(b.column(c).to_numpy() for c in ("row", "y", "w")), q), ["row", "n", "y", "w", "x"])

    return materialize(src.mapInArrow(run, "row long, n int, y binary, w binary, x binary"), "forest-rows")


class _Block:
    """Rows by column, with their (bin, class) cells of the columns asked for so far."""

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int, span: int):
        self.n = x.shape[1]
        self.cols, self.flat = x, x.reshape(-1)
        self.y, self.k, self.span, self.cells = y, k, span, {}

    def add(self, total: np.ndarray, slot: int, column: int, rows: np.ndarray | None, w: np.ndarray) -> None:
        """Adds the rows' weights into the (bin, class) cells of ``slot``."""
        if column not in self.cells:
            self.cells[column] = self.cols[column] * np.int64(self.k) + self.y
        cells = self.cells[column]
        np.add.at(total[slot * self.span:(slot + 1) * self.span], cells if rows is None else cells.take(rows), w)


def _histograms(rows: DataFrame, part: list, trees: list[Tree], level: int, vary: list[int], k: int, bins: int, seed: int) -> DataFrame:
    """Non-empty (place, feature, bin) rows of the open ``part`` of (tree, node, positions in ``vary``), with the weight of each class."""
    width = max(len(vary), 1)
    where = {f: j for j, f in enumerate(vary)}
    place_of = np.repeat(np.arange(len(part)), [len(c) for _, _, c in part])
    column = np.array([j for _, _, c in part for j in c], dtype=np.int64)
    by_tree: dict[int, list] = {}
    for t, n, c in part:                            # a tree's slots lie side by side
        by_tree.setdefault(t, []).append((n, c))
    at_slot = 0
    routes = []
    for t, mine in by_tree.items():
        tree, size = trees[t], len(trees[t].feature)
        feature = np.array([where.get(f, 0) for f in tree.feature], np.int64)
        cut, left = np.array(tree.cut, np.int64), np.array(tree.left, np.int64)
        first, count, needed = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
        for n, c in mine:
            first[n], count[n], needed[n] = at_slot, len(c), True
            at_slot += len(c)
        for n in range(size - 1, -1, -1):           # rows are followed to open nodes only
            if tree.feature[n] >= 0:
                needed[n] = needed[n] or needed[left[n]] or needed[left[n] + 1]
        # where few rows are followed, only they are drawn
        most = level == 0 or sum(sum(tree.classes[n]) for n, _ in mine) > 0.4 * sum(tree.classes[0])
        routes.append((t, feature, cut, left, needed, first, count, most))

    def run(batches):
        span = bins * k
        total = np.zeros(len(column) * span, np.int64)
        for row, y, w, x in row_blocks(batches, {"y": (np.int32, None), "w": (np.float64, None), "x": (np.uint8, width)}):
            low, high = _row_bits(row)
            y, units = y.astype(np.int64), np.rint(w * UNIT).astype(np.int64)
            block = _Block(x, y, k, span)
            for t, feature, cut, left, needed, first, count, most in routes:
                copies = _copies(low, high, t, seed) if most else None

                def weights(rows):
                    return units.take(rows) * (copies.take(rows) if most else _copies(low.take(rows), high.take(rows), t, seed))

                if level == 0:                      # every row is at the root
                    w = units * copies
                    for slot in range(first[0], first[0] + count[0]):
                        block.add(total, slot, column[slot], None, w)
                    continue
                large, node, rows = follow(x, copies, feature, cut, left, needed, count, level)
                for n, at in large:
                    w = weights(at)
                    for slot in range(first[n], first[n] + count[n]):
                        block.add(total, slot, column[slot], at, w)
                if len(rows):
                    w, start, n = weights(rows), first.take(node), count.take(node)
                    for j in range(int(n.max())):
                        on = np.flatnonzero(n > j)
                        slot, at = start.take(on) + j, rows.take(on)
                        cell = (slot * bins + block.flat.take(column.take(slot) * block.n + at)) * k + y.take(at)
                        np.add.at(total, cell, w.take(on))
        total = total.reshape(-1, k)
        hit = np.flatnonzero(total.any(axis=1))
        slot, bin_ = np.divmod(hit, bins)
        out = [place_of[slot], column[slot], bin_] + [total[hit, c] for c in range(k)]
        for a in range(0, len(hit), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c[a:a + 65536].astype(np.int64)) for c in out],
                                             ["place", "feature", "bin"] + [f"c{c}" for c in range(k)])

    return rows.mapInArrow(run, "place long, feature long, bin long, " + ", ".join(f"c{c} long" for c in range(k)))


def best_cuts(cells: DataFrame, k: int) -> DataFrame:
    """Largest drop of Gini impurity of each place, ties to the lower feature and bin; ``gain`` is null where nothing drops."""
    every = "PARTITION BY place, feature"
    upto = f"{every} ORDER BY bin ROWS UNBOUNDED PRECEDING"
    cs = range(k)

    def purity(side):
        return "(" + " + ".join(f"{side}{c} * {side}{c}" for c in cs) + ")"
    # expression text: a level is one short job
    return (cells.groupBy("place", "feature", "bin").agg({f"c{c}": "sum" for c in cs})
            .selectExpr("place", "feature", "bin", *[f"sum(`sum(c{c})`) OVER ({w}) / {UNIT}D AS {s}{c}" for c in cs for s, w in (("l", upto), ("t", every))])
            .selectExpr("*", *[f"t{c} - l{c} AS r{c}" for c in cs])
            .selectExpr("*", *[" + ".join(f"{s}{c}" for c in cs) + f" AS {s}w" for s in "ltr"])
            .selectExpr("*", f"CASE WHEN lw > 0 AND rw > 0 THEN {purity('l')} / (lw * tw) + {purity('r')} / (rw * tw) - {purity('t')} / (tw * tw) END AS found")
            .selectExpr("place", "feature", "bin", "CASE WHEN found > 1e-12D THEN found END AS gain",
                        *[f"array({', '.join(f'{s}{c}' for c in cs)}) AS {n}" for s, n in (("l", "below"), ("t", "all"))])
            .groupBy("place").agg(F.expr("max_by(struct(feature, bin, gain, below, all), struct(coalesce(gain, -1D), -feature, -bin))").alias("best"))
            .select("place", "best.*"))


def train_forest(df: DataFrame, features: list[str], trees: int = 500, depth: int = 20, bins: int = 64, seed: int = 42,
                 label: str = "label", weight: str = "weight", seen: list[tuple] | None = None) -> "ForestModel":
    """M4: ``trees`` trees of at most ``depth`` levels of cuts; ``df`` has the assembled ``features`` vector beside its columns."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256: a bin is one byte")
    top = df.filter(F.col(weight).isNotNull()).agg(F.max(F.col(label).cast("int"))).first()[0]
    if top is None:
        raise ValueError("no labelled rows to train on")
    k, width = top + 1, len(features)
    points = cut_points(df, features, bins, seen)
    vary = [i for i, p in enumerate(points) if len(p)]
    rows = _binned(df, features, label, weight, vary, points)
    looked = width if trees == 1 else math.ceil(math.sqrt(width))
    where = {f: j for j, f in enumerate(vary)}

    def look(tree: int, node: int) -> list[int]:
        """The features that a node looks at, of them those that can be cut."""
        chosen = np.random.default_rng((seed, tree, node)).choice(width, looked, replace=False)
        return sorted(where[i] for i in chosen.tolist() if i in where)

    grown = [Tree() for _ in range(trees)]
    # the classes of a root come from its histogram, so one column is added up even where none can be cut
    roots = {t: look(t, 0) if depth else [] for t in range(trees)}
    open_nodes = [(t, 0, c or [0]) for t, c in roots.items()]
    for level in range(max(depth, 1)):
        following, a = [], 0
        while a < len(open_nodes):
            b, slots = a, 0
            while b < len(open_nodes) and (b == a or (slots + len(open_nodes[b][2])) * bins * k <= CELLS):
                slots += len(open_nodes[b][2])
                b += 1
            part, a = open_nodes[a:b], b
            cells = _histograms(rows, part, grown, level, vary, k, bins, seed)
            for r in sorted(best_cuts(cells, k).collect(), key=lambda r: r["place"]):      # one row per open node
                t, node, _ = part[r["place"]]
                grown[t].classes[node] = list(r["all"])
                if r["gain"] is None or (level == 0 and not roots[t]):
                    continue
                right = [x - y for x, y in zip(r["all"], r["below"])]
                child = grown[t].split(node, vary[r["feature"]], r["bin"], r["gain"], list(r["below"]), right)
                for n in (child, child + 1):
                    if level + 1 < depth and np.count_nonzero(grown[t].classes[n]) > 1 and (c := look(t, n)):
                        following.append((t, n, c))
        open_nodes = following
        if not open_nodes:
            break
    release(rows)
    for t in grown:                 # bin b holds the values up to cut point b
        t.classes = [[0.0] * k if c is None else c for c in t.classes]      # a tree may draw no row
        t.cut = [float(points[f][int(c)]) if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)]
    return ForestModel(list(features), k, [t.prune() for t in grown])


def _votes(chunks: list, width: int, k: int):
    most = max(min(BLOCK, (32 << 20) // (8 * max(width, k))), 1)

    @F.arrow_udf("array<double>")
    def add(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for held in joined(batches, most):
            flat = np.concatenate([_matrix(b, width).reshape(-1) for b in held])
            n = len(flat) // width
            total = np.zeros((n, k))
            for part in one_at_a_time(chunks):
                for feature, cut, left, share in part:
                    node = np.zeros(n, np.int64)
                    rows = np.arange(n) if feature[0] >= 0 else np.zeros(0, np.int64)
                    while len(rows):
                        at = node.take(rows)
                        at = left.take(at) + ~(flat.take(rows * width + feature.take(at)) <= cut.take(at))
                        node[rows] = at
                        rows = rows[feature.take(at) >= 0]
                    total += share.take(node, axis=0)
                del part
            at = 0
            for b in held:
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * k, pa.int32()), pa.array(total[at:at + len(b)].reshape(-1)))
                at += len(b)
    return add


@dataclass
class ForestModel:
    features: list[str]
    k: int
    trees: list[Tree]               # cuts are thresholds

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (array over classes 0 to k - 1) and ``prediction``; trees go out in chunks of bounded size."""
        used = sorted({f for t in self.trees for f in t.feature if f >= 0}) or [0]
        where = {f: j for j, f in enumerate(used)}
        x = F.array(*[F.coalesce(F.col(self.features[i]).cast("double"), F.lit(float("nan"))) for i in used])
        fresh = next(n for n in (f"_votes{i}" for i in range(len(df.columns) + 1)) if n not in df.columns)
        spark, chunk, size, sent = df.sparkSession, [], 0, []
        for t in self.trees:
            if chunk and size + len(t.feature) > NODES_PER_PASS:
                sent.append(spark.sparkContext.broadcast(chunk))
                chunk, size = [], 0
            classes = np.array(t.classes, np.float64)
            whole = classes.sum(axis=1, keepdims=True)
            chunk.append((np.array([where.get(f, -1) for f in t.feature], np.int64), np.array(t.cut, np.float64), np.array(t.left, np.int64),
                          np.divide(classes, whole, out=np.zeros_like(classes), where=whole > 0)))
            size += len(t.feature)
        sent.append(spark.sparkContext.broadcast(chunk))
        out = df.withColumn(fresh, _votes(sent, len(used), self.k)(x))
        whole = F.aggregate(fresh, F.lit(0.0), lambda a, v: a + v)
        out = out.withColumn("probability", F.when(whole > 0, F.transform(fresh, lambda v: v / whole)).otherwise(F.col(fresh))).drop(fresh)
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def importances(self) -> np.ndarray:
        """Mean over trees of each feature's share of the weighted impurity drops, summing to 1 (all zero without cuts)."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            mine = np.zeros(len(self.features))
            for f, g, c in zip(t.feature, t.gain, t.classes):
                if f >= 0:
                    mine[f] += g * sum(c)
            if mine.sum() > 0:
                total += mine / mine.sum()
        return total / total.sum() if total.sum() > 0 else total

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, t.feature, [float(v) for v in t.cut], t.left, [float(v) for v in t.gain], t.classes) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, feature array<int>, cut array<double>, left array<int>, gain array<double>, "
                              "classes array<array<double>>").write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.features, self.k)], "features array<string>, k int").write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ForestModel":
        m = spark.read.parquet(f"{path}/model").first()
        trees = [Tree(list(r["feature"]), list(r["cut"]), list(r["left"]), list(r["gain"]), [list(c) for c in r["classes"]])
                 for r in spark.read.parquet(f"{path}/trees").orderBy("tree").collect()]
        return cls(list(m["features"]), m["k"], trees)
