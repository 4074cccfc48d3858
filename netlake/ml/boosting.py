"""Softmax-boosted trees (the boosted branch of M4).

Each round adds one tree per class.  A tree grows level by level, and a level
of all classes is one Spark job:

1. Every task routes its rows through the trees so far and adds gradient and
   hessian of each row into histograms of (open node, feature, bin).
2. The tasks' non-empty cells are summed by (node, feature, bin); running sums
   over a feature's bins give the gain of each cut; the best cut of each node
   comes back, so the driver sees one row per open node, never data rows.

Gradients are added as 64-bit integers in units of 2^-20, so sums, and with
them the trees, do not depend on the order or partitioning of the rows.  Open
nodes are taken in groups, so that a task's histogram has at most ``CELLS``
cells.  Rows are binned once at quantiles and written as bytes, by column and thousands to a cell; after every
``cut_every`` rounds their scores are written too, so that a job replays only
few trees and a lost executor costs only its own tasks.

Null features count as 0.0, NaN goes to the right child of every cut, a null
label or weight drops the training row, an empty table raises ``ValueError``.
A single class gives single-leaf trees.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators.dataset import feature_ranges
from ..plans.stage import materialize, release

UNIT = float(1 << 20)
CELLS = 1 << 22
NODES_PER_PASS = 1 << 20
BLOCK = 1 << 16
LOSS = -1           # the node id under which a round's loss travels


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 500
    depth: int = 10
    rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_weight: float = 3.0
    gamma: float = 0.05
    alpha: float = 0.05
    lam: float = 1.0
    bins: int = 64
    seed: int = 42
    cut_every: int = 10


@dataclass
class Tree:
    """Parallel node lists; ``feature`` -1 marks a leaf, ``cut`` is the last bin that goes left."""
    label: int
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = a, a + 1
        for _ in range(2):
            for col, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0),
                           (self.gain, 0.0)):
                col.append(v)
        return a, a + 1

    def arrays(self):
        return (self.label, np.array(self.feature, np.int32), np.array(self.cut, np.float64),
                np.array(self.left, np.int32), np.array(self.right, np.int32), np.array(self.value))


def _route(tree, x: np.ndarray) -> np.ndarray:
    """Node of each row; ``x`` holds bins where cuts are bins, values where they are thresholds."""
    _, feature, cut, left, right, _ = tree
    node = np.zeros(len(x), np.int32)
    rows = np.arange(len(x))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        goes_left = x[rows, np.maximum(f, 0)] <= cut[node]
        node = np.where(inner, np.where(goes_left, left[node], right[node]), node)


def _sampled(row: np.ndarray, turn: int, share: float, seed: int) -> np.ndarray:
    """Keyed 64-bit mix of the written row number: the same rows on every retry."""
    z = row.astype(np.uint64) + np.uint64((turn * 0x9E3779B97F4A7C15 + seed) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) / float(1 << 64) < share


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width)


def _number(name: str):
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _features(names: list[str]):
    return F.array(*[_number(c) for c in names])


def bin_edges(df: DataFrame, features: list[str], bins: int, ranges: list[tuple] | None = None) -> list[np.ndarray]:
    """Distinct approximate quantiles of each feature: one pass, at most ``bins`` - 1 numbers a feature."""
    clean = df.select(*[_number(c).alias(f"x{i}") for i, c in enumerate(features)])
    # one value needs no quantiles
    found = [np.array([] if v is None else [v]) if v == w else None for v, w, _ in ranges or _ranges(df, features)]
    vary = [i for i, e in enumerate(found) if e is None]
    probs = [i / bins for i in range(1, bins)]
    for i, e in zip(vary, clean.approxQuantile([f"x{i}" for i in vary], probs, 1.0 / (16 * bins)) if vary else ()):
        found[i] = np.unique(np.array(e, dtype=np.float64))
    return found


def _ranges(df: DataFrame, features: list[str]) -> list[tuple]:
    """Least and largest value of each feature (NaN is the largest)."""
    return feature_ranges(df, [_number(c) for c in features])


A_CELL = 4096


def cells_of(row: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """Rows that follow each other, ``A_CELL`` to a cell: the first one's number, how many they are, and each column's values."""
    assert row[-1] - row[0] == len(row) - 1
    at = [slice(a, a + A_CELL) for a in range(0, len(row), A_CELL)]
    return [pa.array([row[c][0] for c in at], pa.int64()), pa.array([len(row[c]) for c in at], pa.int32()),
            *[pa.array([v[..., c].tobytes() for c in at], pa.binary()) for v in columns]]


class _Cell:
    def __init__(self, *columns):
        self.columns = columns

    def __len__(self):
        return len(self.columns[0])


def read_cells(batches: Iterator, kinds: dict) -> Iterator[_Cell]:
    """The row numbers and the columns of ``kinds``, (type, height) by name; a height of none is one value a row."""
    for b in batches:
        for i in range(b.num_rows):
            n, first = b.column("n")[i].as_py(), b.column("row")[i].as_py()
            values = [np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, (kind, _) in kinds.items()]
            yield _Cell(np.arange(first, first + n), *[v if h is None else v.reshape(h, n) for v, (_, h) in zip(values, kinds.values())])


def row_blocks(batches: Iterator, kinds: dict) -> Iterator[tuple]:
    """The same for ``BLOCK`` rows or more at a time, so that they are counted together."""
    for held in joined(read_cells(batches, kinds), BLOCK):
        yield tuple(np.concatenate(c, axis=-1) for c in zip(*(h.columns for h in held)))


def _kinds(k: int, width: int) -> dict:
    return {"y": (np.int32, None), "w": (np.float64, None), "x": (np.uint8, width), "s": (np.float64, k)}


BOOST_ROWS = "row long, n int, y binary, w binary, x binary, s binary"
BOOST_NAMES = ["row", "n", "y", "w", "x", "s"]


def _binned(df: DataFrame, features, label, weight, classes, edges, vary: list[int]) -> DataFrame:
    """Rows of class, weight, one byte for the bin of each feature that can be cut, and scores, written ``A_CELL`` to a cell."""
    src = df.filter(F.col(label).isNotNull() & F.col(weight).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(label).cast("int").alias("y"),
        F.col(weight).cast("double").alias("w"), *[_number(features[i]).alias(f"x{i}") for i in vary])
    k = len(classes)
    order = np.array(classes)

    def run(batches):
        for b in batches:
            if n := b.num_rows:
                q = np.zeros((max(len(vary), 1), n), np.uint8)
                for j, i in enumerate(vary):
                    q[j] = np.searchsorted(edges[i], b.column(3 + j).to_numpy(), side="left")
                y = np.searchsorted(order, b.column("y").to_numpy()).astype(np.int32)
                yield pa.RecordBatch.from_arrays(cells_of(b.column("row").to_numpy(), y, b.column("w").to_numpy(), q, np.zeros((k, n))), BOOST_NAMES)

    return materialize(src.mapInArrow(run, BOOST_ROWS), "boost-rows")


def _placed(trees: list, where: dict) -> list:
    """Trees' arrays with the features' places among the written ones."""
    return [(c, np.array([where.get(f, 0) if f >= 0 else -1 for f in feature.tolist()], np.int32), *rest) for c, feature, *rest in trees]


def _with_scores(rows: DataFrame, done: list, k: int, where: dict) -> DataFrame:
    """The rows with the trees of ``done`` added to their scores, written."""
    kinds, done = _kinds(k, max(len(where), 1)), _placed(done, where)

    def run(batches):
        for cell in read_cells(batches, kinds):
            row, y, w, x, s = cell.columns
            s = s.copy()
            for t in done:
                s[t[0]] += t[5][_route(t, x.T)]
            yield pa.RecordBatch.from_arrays(cells_of(row, y, w, x, s), BOOST_NAMES)
    return materialize(rows.mapInArrow(run, BOOST_ROWS), "boost-rows")


def _blocks(batches):
    """Tables of at least ``BLOCK`` rows where there are so many: a histogram is then added up for many rows at a time."""
    held, n = [], 0
    for b in batches:
        held, n = held + [b], n + b.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


FEW = 1024


def follow(cols: np.ndarray, copies: np.ndarray | None, feature, cut, left, needed, count, level: int) -> tuple[list, np.ndarray, np.ndarray]:
    """The (drawn, if ``copies`` tells) rows at the open nodes of ``level``: (node, rows) where they are many, and node by row of the others.

    Rows are bins by column.  While a node has many they are followed as a mask or as row numbers, the others all at once.
    """
    total, flat = cols.shape[1], cols.reshape(-1)
    large, small = [], [[] for _ in range(level + 1)]
    todo = [(0, 0, None if copies is None else copies != 0)]
    while todo:
        node, depth, rows = todo.pop()
        if depth == level:
            large.append((node, np.arange(total) if rows is None else np.flatnonzero(rows) if rows.dtype == bool else rows))
            continue
        col, a = cols[feature[node]], left[node]
        mask = rows is None or rows.dtype == bool
        right = (col if mask else col.take(rows)) > cut[node]
        for child in (a, a + 1):
            if not needed[child]:
                continue
            to = right if child > a else ~right
            if mask:
                to = to if rows is None else to & rows
                size = int(np.count_nonzero(to))
                if 32 * size < total or size < FEW:
                    to = np.flatnonzero(to)
            else:
                to = rows[to]
                size = len(to)
            if size >= FEW:
                todo.append((child, depth + 1, to))
            elif size:
                small[depth + 1].append((child, to))
    node, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for depth in range(1, level + 1):
        if small[depth]:
            node = np.concatenate([node, *[np.full(len(r), n, np.int64) for n, r in small[depth]]])
            at = np.concatenate([at, *[r for _, r in small[depth]]])
        if depth < level and len(at):
            node = left.take(node) + (flat.take(feature.take(node) * total + at) > cut.take(node))
            keep = np.flatnonzero(needed.take(node))
            if len(keep) < len(node):
                node, at = node.take(keep), at.take(keep)
    return large, node, at


def joined(batches: Iterator, most: int) -> Iterator[list]:
    """Lists of batches of ``most`` rows or more, but for the last: what is held for them is read once for many rows."""
    held, n = [], 0
    for b in batches:
        held, n = held + [b], n + len(b)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def one_at_a_time(chunks: list) -> Iterator[list]:
    """The value of each broadcast chunk; a worker drops one before it reads the next from its executor's file."""
    for bc in chunks:
        value = bc.value
        if getattr(bc, "_path", None):
            del bc._value
        yield value
        del value


def _cells(rows: DataFrame, done: list, growing: list, open_nodes: list, columns: list, turn: int, p: BoostParams,
           k: int, where: dict, with_loss: bool, level: int) -> DataFrame:
    """Non-empty histogram cells of the open (class, node) places of a level, one set a task."""
    slots = {}
    for place, (c, node) in enumerate(open_nodes):
        slots.setdefault(c, {})[node] = place
    deepest = {c: max(s) for c, s in slots.items()}
    span = max(len(c) for c in columns) * p.bins
    kinds, done = _kinds(k, max(len(where), 1)), _placed(done, where)
    routes = []
    for c, places in slots.items():
        _, feature, cut, left, *_ = growing[c]
        table, needed = np.full(len(feature), -1, np.int64), np.zeros(len(feature), bool)
        for node, place in places.items():
            table[node], needed[node] = place, True
        for n in range(len(feature) - 1, -1, -1):           # rows are followed to open nodes only
            if feature[n] >= 0:
                needed[n] = needed[n] or needed[left[n]] or needed[left[n] + 1]
        at = np.array([where.get(f, 0) for f in feature.tolist()], np.int64)
        # a column that can not be cut lies in bin 0
        routes.append((c, [where.get(f) for f in columns[c]], table, (at, cut.astype(np.int64), left.astype(np.int64), needed, table >= 0)))

    def run(batches):
        g_sum, h_sum = (np.zeros(len(open_nodes) * span, np.int64) for _ in range(2))
        loss, weight = 0, 0
        for row, y, w, x, s in row_blocks(batches, kinds):
            for t in done:
                s[t[0]] += t[5][_route(t, x.T)]
            if with_loss:
                prob = _softmax(s.T)
                loss += int(np.rint(-np.log(np.maximum(prob[np.arange(len(y)), y], 1e-16)) * w * UNIT).sum())
                weight += int(np.rint(w * UNIT).sum())
            keep = np.flatnonzero(_sampled(row, turn, p.subsample, p.seed))
            x, y, w = x.take(keep, axis=1), y.take(keep), w.take(keep)
            prob, flat = _softmax(s.take(keep, axis=1).T), x.reshape(-1)
            for c, cols, table, tree in routes:
                large, node, at = follow(x, None, *tree, level)
                if not large and not len(at):
                    continue
                q = prob[:, c]
                g = np.rint((q - (y == c)) * w * UNIT).astype(np.int64)
                h = np.rint(np.maximum(2.0 * q * (1.0 - q), 1e-16) * w * UNIT).astype(np.int64)
                for n, on in large:
                    gn, hn, start = g.take(on), h.take(on), table[n] * span
                    for j, f in enumerate(cols):
                        bin_ = np.zeros(len(on), np.int64) if f is None else x[f].take(on).astype(np.int64)
                        for total, v in ((g_sum, gn), (h_sum, hn)):
                            np.add.at(total[start + j * p.bins:start + (j + 1) * p.bins], bin_, v)
                gn, hn, start = g.take(at), h.take(at), table.take(node) * span
                for j, f in enumerate(cols if len(at) else ()):
                    cell = start + j * p.bins + (0 if f is None else flat.take(f * x.shape[1] + at))
                    for total, v in ((g_sum, gn), (h_sum, hn)):
                        np.add.at(total, cell, v)
        hit = np.flatnonzero((g_sum != 0) | (h_sum != 0))
        place, rest = np.divmod(hit, span)
        which, bin_ = np.divmod(rest, p.bins)
        names = np.array([np.pad(np.array(columns[c]), (0, span // p.bins - len(columns[c]))) for c, _ in open_nodes])
        out = [place, names[place, which], bin_, g_sum[hit], h_sum[hit]]
        if with_loss and weight:
            out = [np.append(col, v) for col, v in zip(out, (LOSS, 0, 0, loss, weight))]
        for lo in range(0, len(out[0]), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(col[lo:lo + 65536].astype(np.int64)) for col in out],
                                             ["node", "feature", "bin", "g", "h"])

    assert all(n < len(growing[c][1]) for c, n in deepest.items())
    return rows.mapInArrow(run, "node long, feature long, bin long, g long, h long")


def best_cuts(cells: DataFrame, p: BoostParams) -> DataFrame:
    """Best cut of each node by gain, ties to the lower feature and bin; ``gain`` is null where none is allowed."""
    soft = "pow(greatest(abs({g}) - {alpha}D, 0D), 2) / ({h} + {lam}D)"

    def score(g, h):
        return soft.format(g=g, h=h, alpha=p.alpha, lam=p.lam)

    every = "PARTITION BY node, feature"
    upto = f"{every} ORDER BY bin ROWS UNBOUNDED PRECEDING"
    least = f"least(h_left, h_all - h_left) >= {p.min_child_weight}D AND least(h_left, h_all - h_left) > 0"
    gain = f"{score('g_left', 'h_left')} + {score('(g_all - g_left)', '(h_all - h_left)')} - {score('g_all', 'h_all')}"
    # expression text, not Column calls: a level is one short job, and building it call by call took longer than running it
    return (cells.repartition("node", "feature").groupBy("node", "feature", "bin").agg({"g": "sum", "h": "sum"})
            .selectExpr("node", "feature", "bin", *[f"sum(`sum({c})`) OVER ({w}) / {UNIT}D AS {c}_{n}" for c in "gh"
                                                    for n, w in (("left", upto), ("all", every))])
            .selectExpr("*", f"CASE WHEN node <> {LOSS} AND {least} THEN {gain} END AS found")
            .selectExpr("*", f"CASE WHEN found > {max(p.gamma, 1e-9)}D THEN found END AS gain")
            .groupBy("node").agg(F.expr("max_by(struct(feature, bin, gain, g_left, h_left, g_all, h_all), "
                                        "struct(coalesce(gain, -1D), -feature, -bin))").alias("best"))
            .select("node", "best.*"))


def _leaf(g: float, h: float, p: BoostParams) -> float:
    return -p.rate * float(np.sign(g)) * max(abs(g) - p.alpha, 0.0) / (h + p.lam) if h + p.lam > 0 else 0.0


@dataclass
class BoostModel:
    features: list[str]
    classes: list[int]
    trees: list[Tree]               # cuts are thresholds
    history: list[float]            # training log-loss before each round

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (array over ``classes``) and ``prediction``; trees go out in chunks of bounded size."""
        k, width = len(self.classes), len(self.features)
        fresh = next(n for n in (f"_boost{i}" for i in range(len(df.columns) + 1)) if n not in df.columns)
        out = df.withColumn(fresh, F.array(*[F.lit(0.0)] * k))
        chunk, size, chunks = [], 0, []
        for t in self.trees:
            if chunk and size + len(t.feature) > NODES_PER_PASS:
                chunks.append(chunk)
                chunk, size = [], 0
            chunk.append(t.arrays())
            size += len(t.feature)
        for part in chunks + ([chunk] if chunk else []):
            out = out.withColumn(fresh, _adder(part, k, width)(_features(self.features), F.col(fresh)))
        top = F.array_max(fresh)
        exps = F.transform(fresh, lambda v: F.exp(v - top))
        total = F.aggregate(exps, F.lit(0.0), lambda a, v: a + v)
        out = out.withColumn("probability", F.transform(exps, lambda v: v / total)).drop(fresh)
        names = F.array(*[F.lit(float(c)) for c in self.classes])
        return out.withColumn("prediction", F.element_at(
            names, F.array_position("probability", F.array_max("probability")).cast("int")))

    def importances(self) -> np.ndarray:
        """Mean gain of the cuts on each feature, summing to 1 (all zero without cuts)."""
        total, count = (np.zeros(len(self.features)) for _ in range(2))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += g
                    count[f] += 1
        mean = np.divide(total, count, out=np.zeros_like(total), where=count > 0)
        return mean / mean.sum() if mean.sum() > 0 else mean

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, t.label, t.feature, [float(v) for v in t.cut], t.left, t.right, t.value, t.gain)
                for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, label int, feature array<int>, cut array<double>, left array<int>, "
                              "right array<int>, value array<double>, gain array<double>").write.mode(
            "overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.features, self.classes, self.history)],
                              "features array<string>, classes array<int>, history array<double>").write.mode(
            "overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostModel":
        m = spark.read.parquet(f"{path}/model").first()
        trees = [Tree(r["label"], r["feature"], r["cut"], r["left"], r["right"], r["value"], r["gain"])
                 for r in spark.read.parquet(f"{path}/trees").orderBy("tree").collect()]
        return cls(list(m["features"]), list(m["classes"]), trees, list(m["history"]))


def _adder(part: list, k: int, width: int):
    @F.arrow_udf("array<double>")
    def add(x: pa.Array, s: pa.Array) -> pa.Array:
        xs, ss = _matrix(x, width), _matrix(s, k).copy()
        for t in part:
            ss[:, t[0]] += t[5][_route(t, xs)]
        return pa.array(list(ss), pa.list_(pa.float64()))
    return add


def train_boosted(df: DataFrame, features: list[str] | None = None, params: BoostParams = BoostParams(),
                  label: str = "label", weight: str = "weight") -> BoostModel:
    """M4: ``params.rounds`` rounds of one tree per class, with sampled rows and features and L1/L2 leaf shrinkage."""
    features, p = features or config.FEATURE_NAMES, params
    if not 2 <= p.bins <= 256:
        raise ValueError("bins must be between 2 and 256: a bin is one byte")
    classes = sorted(int(r[0]) for r in df.filter(F.col(weight).isNotNull()).select(F.col(label).cast("int"))
                     .dropna().distinct().collect())       # one row per class
    if not classes:
        raise ValueError("no labelled rows to train on")
    k, width = len(classes), len(features)
    ranges = _ranges(df, features)
    edges = bin_edges(df, features, p.bins, ranges)
    # a feature whose values all lie in one bin has no cut
    vary = [i for i, (e, (_, hi, _)) in enumerate(zip(edges, ranges)) if not (len(e) == 1 and hi <= e[0])]
    where = {f: j for j, f in enumerate(vary)}
    rows = _binned(df, features, label, weight, classes, edges, vary)
    rng = np.random.RandomState(p.seed)
    kept, done, history = [], [], []
    for turn in range(p.rounds):
        round_trees = [Tree(c) for c in range(k)]
        columns = [sorted(rng.choice(width, max(int(p.colsample * width), 1), replace=False).tolist()) for _ in range(k)]
        columns = [[i for i in c if i in where] or c[:1] for c in columns]      # one is left to give a node's totals
        group = max(CELLS // (max(map(len, columns)) * p.bins), 1)
        open_nodes = [(c, 0) for c in range(k)]
        for level in range(p.depth):
            growing, following = [t.arrays() for t in round_trees], []
            for lo in range(0, len(open_nodes), group):
                part = open_nodes[lo:lo + group]
                cells = _cells(rows, done, growing, part, columns, turn, p, k, where, level == 0 and lo == 0, level)
                for r in sorted(best_cuts(cells, p).collect(), key=lambda r: r["node"]):     # one row per open node
                    if r["node"] == LOSS:
                        history.append(r["g_all"] / r["h_all"])
                        continue
                    c, node = part[r["node"]]
                    tree = round_trees[c]
                    tree.value[node] = _leaf(r["g_all"], r["h_all"], p)
                    if r["gain"] is not None:
                        a, b = tree.split(node, int(r["feature"]), int(r["bin"]), float(r["gain"]))
                        tree.value[a] = _leaf(r["g_left"], r["h_left"], p)
                        tree.value[b] = _leaf(r["g_all"] - r["g_left"], r["h_all"] - r["h_left"], p)
                        following += [(c, a), (c, b)]
            open_nodes = following
            if not open_nodes:
                break
        kept += round_trees
        done += [t.arrays() for t in round_trees]
        if (turn + 1) % p.cut_every == 0 and turn + 1 < p.rounds:
            before, rows, done = rows, _with_scores(rows, done, k, where), []
            release(before)
    release(rows)
    for t in kept:                  # bins become thresholds: bin b holds the values up to edge b
        t.cut = [float(edges[f][int(b)]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.cut)]
    return BoostModel(features, classes, kept, history)
