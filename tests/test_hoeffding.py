"""The incremental tree against plain loops."""
import math

import numpy as np
import pytest

from netlake.ml import hoeffding
from netlake.ml.hoeffding import HoeffdingTree, learn_stream

NAMES = ["a", "b", "c"]


def _data(n, seed):
    r = np.random.RandomState(seed)
    x = np.round(r.rand(n, 3) * (10, 1, 1000), 3)
    return x, np.where(x[:, 0] > 6, np.where(x[:, 2] > 500, 3, 1), 0)


def _frame(spark, x, y, parts=3):
    return spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)],
                                 "a double, b double, c double, label int").repartition(parts)


def _entropy(m):
    t = sum(m)
    return -sum(v / t * math.log2(v / t) for v in m if v > 0) if t > 0 else 0.0


def _loop_best(x, y, cuts=10):
    """Gain, feature and cut of each feature's best cut, best first, from the rows themselves."""
    found = []
    for f in range(x.shape[1]):
        a, b, best = x[:, f].min(), x[:, f].max(), (-1.0, f, None)
        for i in range(1, cuts + 1):
            cut, left, right = a + (b - a) * i / (cuts + 1), [], []
            for c in sorted(set(y)):
                v = x[y == c, f]
                sd = v.std()
                share = (0.0 if cut < v.min() else 1.0 if cut >= v.max() else
                         0.5 * (1 + math.erf((cut - v.mean()) / sd / math.sqrt(2))))
                left.append(share * len(v))
                right.append(len(v) - share * len(v))
            n, l = len(y), sum(left)
            gain = _entropy([l + r for l, r in zip(left, right)]) - l / n * _entropy(left) - (n - l) / n * _entropy(right)
            if gain > best[0]:
                best = (gain, f, cut)
        found.append(best)
    return sorted(found, reverse=True)


def test_splits_equal_a_plain_loop(spark):
    tree = HoeffdingTree(NAMES)
    seen_x, seen_y, root = np.zeros((0, 3)), np.zeros(0, int), None
    for i in range(4):
        x, y = _data(60, i)
        seen_x, seen_y = np.vstack([seen_x, x]), np.concatenate([seen_y, y])
        tree.learn(_frame(spark, x, y))
        (gain, f, cut), second = _loop_best(seen_x, seen_y)[:2]
        bound = math.sqrt(math.log2(len(set(seen_y))) ** 2 * math.log(1e5) / (2 * len(seen_y)))
        if gain - second[0] > bound:
            root = (f, cut)
            break
        assert tree.feature == [-1]
    assert root and tree.feature[0] == root[0] and tree.cut[0] == pytest.approx(root[1])
    assert sum(sum(b.values()) for b in tree.base[1:3]) == pytest.approx(len(seen_y))
    assert not [s for s in tree.state if s[0] == 0]


def test_moments_merge_exactly(spark):
    x, y = _data(200, 9)
    x[:, 1] += 1e6                       # large offset, small spread
    tree = HoeffdingTree(NAMES, grace=10 ** 9)
    for part in (slice(0, 70), slice(70, 71), slice(71, 200)):
        tree.learn(_frame(spark, x[part], y[part], 4))
    for leaf, c, f, n, mean, m2, lo, hi in (s for s in tree.state if s[2] >= 0):
        v = x[y == c, f]
        assert (n, lo, hi) == (len(v), v.min(), v.max())
        assert mean == pytest.approx(v.mean()) and m2 == pytest.approx(((v - v.mean()) ** 2).sum(), rel=1e-6)
    # batches are tested before they are learnt: 70 rows, then 71, are too few to be ready
    assert tree.n_seen == 200 and tree.n_tested == 0 and tree.ready
    counters = [s for s in tree.state if s[2] == hoeffding.COUNTERS]
    assert len(counters) == 1 and counters[0][3] == 200


def test_stream_learns_and_replays(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(6):
        _frame(spark, *_data(300, i), 1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("a double, b double, c double, label int").option(
        "maxFilesPerTrigger", 1).parquet(folder)
    base = str(tmp_path / "run")
    rows = sorted(tuple(r) for r in learn_stream(stream, base, lambda: HoeffdingTree(NAMES)).collect())
    assert [r[0] for r in rows] == list(range(6)) and rows[0][1:3] == (0, 0) and all(r[2] == 300 for r in rows[1:])
    assert rows[-1][1] > 280 and rows[-1][3] > 1
    # the same batch from the same state gives the same result
    tree, last = HoeffdingTree.load(spark, f"{base}/state/4"), HoeffdingTree.load(spark, f"{base}/state/5")
    assert last.n_seen == 1800 and last.n_tested == 1500 and last.n_correct == sum(r[1] for r in rows)
    got = tree.learn(_frame(spark, *_data(300, 5)))
    assert got[1] == 300 and tree.feature == last.feature
    x, y = _data(500, 77)
    out = last.predict(_frame(spark, x, y)).collect()
    assert np.mean([r["online_prediction"] == r["label"] for r in out]) > 0.93


def test_odd_rows(spark):
    schema = "a double, b double, c double, label int, leaf string"
    tree = HoeffdingTree(NAMES, ready_at=1, grace=1)
    assert tree.learn(spark.createDataFrame([], schema)) == (0, 0) and tree.state == []
    odd = spark.createDataFrame([(None, 1.0, 2.0, 0, None), (float("nan"), 1.0, 2.0, 0, "x"), (0.0, 1.0, 2.0, None, "x")],
                                schema)
    tree.learn(odd)
    assert tree.n_seen == 2 and tree.feature == [-1]
    assert tree.learn(odd) == (2, 2)
    assert [r["online_prediction"] for r in tree.predict(odd).collect()] == [0, 0, 0]
