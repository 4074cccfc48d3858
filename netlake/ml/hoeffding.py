"""Incremental decision tree on streams (M9, T10): a Hoeffding tree over micro-batches.

Each leaf keeps, per class and feature, the row count, mean, squared deviation,
least and greatest value.  A micro-batch is one pass: every task routes its
rows to leaves, predicts them with the tree as it stood before the batch
(test), and adds them to partial moments (train).  The partials and the old
state are merged by (leaf, class, feature); the split search over the merged
state is SQL.  A leaf splits when its best feature beats the second by the
Hoeffding bound, or when the bound falls under ``tie``.  What reaches the
driver, and goes back to the tasks, is leaves x classes x features numbers,
at most ``max_leaves`` leaves: it grows with the tree, not with the stream.

``learn_stream`` runs it in ``foreachBatch``.  The state after batch b is
written under b and read for b + 1, so a replayed batch starts from the same
state and overwrites its own result.

Leaves predict by naive Bayes or by majority, whichever was right more often
there.  Null and NaN features count as 0.0, rows with a null label are not
learnt, an empty batch changes nothing.  Replacing subtrees on drift is not
built.
"""
from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from .boosting import _matrix, _route

STATE = "leaf int, y int, feature int, n long, mean double, m2 double, lo double, hi double"
COUNTERS = -1       # the feature under which a leaf's test counters travel: n tested, mean majority, m2 bayes right

# normal distribution function by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 2e-7)
# FIXED VALUES
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def normal_cdf(z: str) -> str:
    x, t = f"(abs({z}) / sqrt(2D))", f"(1D / (1D + {ERF_P}D * abs({z}) / sqrt(2D)))"
    poly = " + ".join(f"{a}D * pow({t}, {i}D)" for i, a in enumerate(ERF, 1))
    return f"0.5D * (1D + sign({z}) * (1D - ({poly}) * exp(-{x} * {x})))"


@dataclass
class HoeffdingTree:
    features: list[str] = field(default_factory=lambda: list(config.FEATURE_NAMES))
    grace: int = 50
    delta: float = 1e-5
    tie: float = 0.05
    cuts: int = 10
    max_leaves: int = 256
    ready_at: int = 100
    # the tree: feature -1 marks a leaf
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    base: list = field(default_factory=lambda: [{}])        # class masses a leaf was born with
    checked: list = field(default_factory=lambda: [0])      # rows a leaf had at its last split attempt
    n_seen: int = 0
    n_tested: int = 0
    n_correct: int = 0
    state: list = field(default_factory=list)               # rows of STATE

    # ------------------------------------------------------------ prediction
    def _frozen(self):
        """Everything a task needs to predict, as arrays by (leaf, class, feature)."""
        classes = sorted({r[1] for r in self.state if r[2] != COUNTERS} | {int(c) for b in self.base for c in b})
        nodes, width, at = len(self.feature), len(self.features), {c: i for i, c in enumerate(classes)}
        n = np.zeros((nodes, len(classes)))
        mean, var, lo, hi = (np.zeros((nodes, len(classes), width)) for _ in range(4))
        lo += np.inf
        hi -= np.inf
        right = np.zeros((nodes, 2))
        for leaf, y, f, cnt, m, m2, a, b in self.state:
            if f == COUNTERS:
                right[leaf] += (m, m2)
                continue
            c = at[y]
            n[leaf, c], mean[leaf, c, f], var[leaf, c, f], lo[leaf, c, f], hi[leaf, c, f] = cnt, m, m2 / cnt, a, b
        masses = n.copy()
        for leaf, born in enumerate(self.base):
            for c, v in born.items():
                masses[leaf, at[int(c)]] += v
        span = hi.max(axis=1) - lo.min(axis=1) if classes else np.zeros((nodes, width))
        var += 1e-6 * np.where(np.isfinite(span), span, 0.0)[:, None, :] ** 2 + 1e-12
        tree = (0, np.array(self.feature, np.int32), np.array(self.cut), np.array(self.left, np.int32),
                np.array(self.right, np.int32), None)
        return np.array(classes, np.int32), n, masses, mean, var, right, tree

    @property
    def ready(self) -> bool:
        return self.n_seen >= self.ready_at

    @property
    def running_accuracy(self) -> float:
        return round(100.0 * self.n_correct / self.n_tested, 2) if self.n_tested else 0.0

    def predict(self, df: DataFrame, out: str = "online_prediction") -> DataFrame:
        """The class of each row as an int column; null before ``ready_at`` learnt rows."""
        if not self.ready:
            return df.withColumn(out, F.lit(None).cast("int"))
        frozen, width = self._frozen(), len(self.features)

        @F.arrow_udf("int")
        def label(x: pa.Array) -> pa.Array:
            return pa.array(_predict(frozen, _matrix(x, width))[0], pa.int32())
        return df.withColumn(out, label(_vector(self.features)))

    # ------------------------------------------------------------ learning
    def learn(self, batch: DataFrame, label: str = "label") -> tuple[int, int]:
        """Test, then train on one batch; (right, tested) rows, (0, 0) before the tree is ready."""
        ready, frozen, width = self.ready, self._frozen(), len(self.features)
        src = batch.filter(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"),
                                                            _vector(self.features).alias("x"))

        def run(batches):
            moments, counters = {}, {}
            for b in batches:
                if not b.num_rows:
                    continue
                x, y = _matrix(b.column("x"), width), b.column("y").to_numpy()
                leaf = _route(frozen[6], x)
                got, major, bayes = _predict(frozen, x)
                for at in np.unique(leaf):
                    on = leaf == at
                    c = counters.setdefault(int(at), [0, 0, 0, 0])
                    c[0] += int(on.sum())
                    c[1] += int((major[on] == y[on]).sum())
                    c[2] += int((bayes[on] == y[on]).sum())
                    c[3] += int((got[on] == y[on]).sum())
                    for cls in np.unique(y[on]):
                        v = x[on & (y == cls)]
                        m = v.mean(axis=0)
                        new = (len(v), m, ((v - m) ** 2).sum(axis=0), v.min(axis=0), v.max(axis=0))
                        key = (int(at), int(cls))
                        moments[key] = _merge(moments[key], new) if key in moments else new
            rows = [(leaf, y, f, n, float(m[f]), float(s[f]), float(a[f]), float(z[f]))
                    for (leaf, y), (n, m, s, a, z) in moments.items() for f in range(width)]
            rows += [(leaf, 0, COUNTERS, n, float(a), float(b), float(g), 0.0) for leaf, (n, a, b, g) in counters.items()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, t) for col, t in zip(zip(*rows), [pa.int32()] * 3 + [pa.int64()] + [pa.float64()] * 4)],
                    ["leaf", "y", "feature", "n", "mean", "m2", "lo", "hi"])

        spark = batch.sparkSession
        old = spark.createDataFrame(self.state, STATE)
        merged = merge_moments(old.withColumn("fresh", F.lit(0)).unionByName(
            src.mapInArrow(run, STATE).withColumn("fresh", F.lit(1)))).collect()    # leaves x classes x features
        tested = right = 0
        state = []
        for r in merged:
            if r["feature"] == COUNTERS:
                tested, right = tested + r["fresh_n"], right + int(r["fresh_right"])
                state.append((r["leaf"], 0, COUNTERS, r["n"], r["total_mean"], r["total_m2"], 0.0, 0.0))
            else:
                state.append(tuple(r[c] for c in ("leaf", "y", "feature", "n", "mean", "m2", "lo", "hi")))
        self.state = sorted(state)
        self.n_seen += tested
        if ready:
            self.n_tested, self.n_correct = self.n_tested + tested, self.n_correct + right
        if tested:
            self._grow(spark)
        return (right, tested) if ready else (0, 0)

    def _grow(self, spark: SparkSession) -> None:
        rows = {}
        for leaf, _, f, n, *_ in self.state:
            if f == 0:
                rows[leaf] = rows.get(leaf, 0) + n
        due = {leaf for leaf, n in rows.items() if n - self.checked[leaf] >= self.grace}
        if not due:
            return
        table = spark.createDataFrame([r for r in self.state if r[0] in due and r[2] != COUNTERS], STATE)
        for r in sorted(split_candidates(table, self.cuts).collect(), key=lambda r: r["leaf"]):   # one row a leaf
            leaf, n = r["leaf"], rows[r["leaf"]]
            self.checked[leaf] = n
            best, second = r["best"]["gain"], max(r["second_gain"] or 0.0, 0.0)
            bound = hoeffding_bound(math.log2(max(r["n_classes"], 2)), self.delta, n)
            room = sum(f < 0 for f in self.feature) < self.max_leaves
            if r["n_classes"] > 1 and best > 0 and (best - second > bound or bound < self.tie) and room:
                self._split(leaf, r["best"])
        gone = {i for i, f in enumerate(self.feature) if f >= 0}
        self.state = [s for s in self.state if s[0] not in gone]

    def _split(self, leaf: int, best) -> None:
        a = len(self.feature)
        self.feature[leaf], self.cut[leaf], self.left[leaf], self.right[leaf] = best["feature"], best["cut"], a, a + 1
        for side in ("to_left", "to_right"):
            self.feature.append(-1)
            self.cut.append(0.0)
            self.left.append(0)
            self.right.append(0)
            self.base.append({int(m["y"]): float(m[side]) for m in best["masses"] if m[side] > 0})
            self.checked.append(0)

    # ------------------------------------------------------------ persistence
    def save(self, spark: SparkSession, path: str) -> None:
        doc = {k: v for k, v in self.__dict__.items() if k != "state"}
        spark.createDataFrame([(json.dumps(doc),)], "doc string").coalesce(1).write.mode("overwrite").text(f"{path}/tree")
        spark.createDataFrame(self.state, STATE).write.mode("overwrite").parquet(f"{path}/leaves")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "HoeffdingTree":
        doc = json.loads(spark.read.text(f"{path}/tree").first()[0])
        doc["base"] = [{int(c): v for c, v in b.items()} for b in doc["base"]]
        return cls(**doc, state=sorted(tuple(r) for r in spark.read.parquet(f"{path}/leaves").collect()))


def _vector(names: list[str]):
    x = [F.col(c).cast("double") for c in names]
    return F.array(*[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in x])


def _merge(a, b):
    """Moments of two disjoint sets of rows (Chan, Golub and LeVeque)."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    return (n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n), np.minimum(a[3], b[3]),
            np.maximum(a[4], b[4]))


def _predict(frozen, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen, majority, naive Bayes) class of each row, -1 where the leaf has seen nothing."""
    classes, n, masses, mean, var, right, tree = frozen
    none = np.full(len(x), -1, np.int32)
    if not len(classes):
        return none, none, none
    leaf = _route(tree, x)
    major = np.where(masses[leaf].sum(axis=1) > 0, classes[masses[leaf].argmax(axis=1)], -1).astype(np.int32)
    bayes = major.copy()
    for at in np.unique(leaf):
        on, seen = leaf == at, n[at] > 0
        if seen.any():
            m, v = mean[at, seen], var[at, seen]
            ll = np.log(n[at, seen] / n[at].sum()) - 0.5 * np.log(2 * math.pi * v).sum(axis=1)
            dist = np.stack([((x[on] - m[c]) ** 2 / v[c]).sum(axis=1) for c in range(len(m))], axis=1)
            bayes[on] = classes[seen][(ll - 0.5 * dist).argmax(axis=1)]
    return np.where(right[leaf, 1] >= right[leaf, 0], bayes, major).astype(np.int32), major, bayes


def merge_moments(parts: DataFrame) -> DataFrame:
    """Partial moments of one (leaf, class, feature) as one row; deviations are taken from the merged mean."""
    w = "OVER (PARTITION BY leaf, y, feature)"
    return (parts.selectExpr("*", f"sum(n * mean) {w} / sum(n) {w} AS m")
            .groupBy("leaf", "y", "feature").agg(
                F.sum("n").alias("n"), F.first("m").alias("mean"),
                F.expr("sum(m2 + n * (mean - m) * (mean - m))").alias("m2"),
                F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                F.sum("mean").alias("total_mean"), F.sum("m2").alias("total_m2"),
                F.expr("coalesce(sum(CASE WHEN fresh = 1 THEN n END), 0)").alias("fresh_n"),
                F.expr("coalesce(sum(CASE WHEN fresh = 1 THEN lo END), 0)").alias("fresh_right")))


def feature_gains(state: DataFrame, cuts: int) -> DataFrame:
    """Per leaf and feature with a spread: ``c``, its best cut with the information gain and the class masses.

    ``cuts`` even steps between a feature's extremes are tried; a class's share
    left of a cut is its normal distribution's, cut off at its own extremes.
    """
    def plogp(v):
        return f"CASE WHEN {v} > 0 THEN {v} * log2({v}) ELSE 0D END"

    w = "OVER (PARTITION BY leaf, feature)"
    sd = "sqrt(m2 / n)"
    share = (f"CASE WHEN cut < lo THEN 0D WHEN cut >= hi THEN 1D WHEN {sd} = 0 THEN CAST(mean <= cut AS double) "
             f"ELSE {normal_cdf(f'((cut - mean) / {sd})')} END")
    masses = (state.selectExpr("*", f"min(lo) {w} AS a", f"max(hi) {w} AS b")
              .where("b > a").selectExpr("*", f"explode(sequence(1, {int(cuts)})) AS i")
              .selectExpr("*", f"a + (b - a) * i / {int(cuts) + 1}D AS cut")
              .selectExpr("leaf", "feature", "i", "cut", "y", "n", f"n * ({share}) AS l"))
    sums = masses.groupBy("leaf", "feature", "i", "cut").agg(
        F.sum("n").alias("N"), F.sum("l").alias("L"), F.count_distinct("y").alias("n_classes"),
        F.expr(f"sum({plogp('n')})").alias("hn"), F.expr(f"sum({plogp('l')})").alias("hl"),
        F.expr(f"sum({plogp('(n - l)')})").alias("hr"),
        F.expr("sort_array(collect_list(struct(y, l AS to_left, n - l AS to_right)))").alias("masses"))
    gain = f"({plogp('N')} - hn - {plogp('L')} + hl - {plogp('(N - L)')} + hr) / N"
    return sums.selectExpr("leaf", "feature", "i", "cut", "n_classes", "masses", f"{gain} AS gain").groupBy(
        "leaf", "feature").agg(F.expr("max_by(struct(gain, feature, cut, masses, n_classes), "
                                      "struct(gain, -i))").alias("c"))


def split_candidates(state: DataFrame, cuts: int) -> DataFrame:
    """Per leaf: the best cut with its class masses, the gain of the second-best feature, the number of classes."""
    return feature_gains(state, cuts).groupBy("leaf").agg(
        F.expr("max_by(c, struct(c.gain, -feature))").alias("best"),
        F.expr("sort_array(collect_list(c.gain), false)[1]").alias("second_gain"),
        F.max("c.n_classes").alias("n_classes"))


def hoeffding_bound(span: float, delta: float, n: float) -> float:
    return math.sqrt(span * span * math.log(1.0 / delta) / (2.0 * n))


def learn_stream(stream: DataFrame, base: str, make=HoeffdingTree, label: str = "label") -> DataFrame:
    """Test-then-train over a stream; one row a batch (batch, correct, scored, leaves) from the states' folder."""
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        tree = make() if batch_id == 0 else HoeffdingTree.load(spark, f"{base}/state/{batch_id - 1}")
        right, tested = tree.learn(batch, label)
        tree.save(spark, f"{base}/state/{batch_id}")
        spark.createDataFrame([(right, tested, sum(f < 0 for f in tree.feature))],
                              "correct long, scored long, leaves int").coalesce(1).write.mode("overwrite").parquet(
            f"{base}/batches/batch={batch_id}")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(
        availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("correct long, scored long, leaves int, batch int").parquet(f"{base}/batches").select(
        "batch", "correct", "scored", "leaves")
