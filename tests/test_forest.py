"""The forest against plain loops over its rows."""
import math
import re

import numpy as np
import pytest

from netlake.ml import boosting, forest, trees
from netlake.operators import dataset as ds

SEED, BINS = 7, 16


def _table(spark, n=300):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 6)), 5.0, float(rng.integers(0, 9)), None if i % 17 == 0 else float(rng.integers(0, 4)), int(rng.integers(0, 3)), 1.0 + i % 3)
            for i in range(n)]
    rows = [r[:4] + ((int(r[0] > 2) + int(r[2] > 4)) if i % 4 else r[4],) + r[5:] for i, r in enumerate(rows)]
    return rows, spark.createDataFrame(rows, "a double, b double, c double, d double, label int, weight double").coalesce(1)


def _assembled(df):
    return trees.assembler(["a", "b", "c", "d"]).transform(df)


def _gini(w):
    return 1.0 - sum((v / sum(w)) ** 2 for v in w) if sum(w) > 0 else 0.0


def _plain(x, y, w, rows, look, node, tree, level, depth, k):
    """(classes, None) of a leaf or (classes, (feature, threshold, gain, left, right)); nodes are numbered as they are met, level by level."""
    classes = [float(sum(w[i] for i in rows if y[i] == c)) for c in range(k)]
    best = None
    for f in look:
        values = sorted({v for v in x[:, f] if not math.isnan(v)})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            left = [i for i in rows if x[i, f] <= cut]
            lw = [float(sum(w[i] for i in left if y[i] == c)) for c in range(k)]
            rw = [t - v for t, v in zip(classes, lw)]
            if sum(lw) > 0 and sum(rw) > 0:
                gain = _gini(classes) - (sum(lw) * _gini(lw) + sum(rw) * _gini(rw)) / sum(classes)
                if gain > 1e-12 and (best is None or gain > best[2] + 1e-12):
                    best = (f, cut, gain)
    return classes, best


def test_every_node_is_the_plain_loops(spark, monkeypatch):
    rows, df = _table(spark)
    monkeypatch.setattr(forest.Tree, "prune", lambda t: t)
    m = forest.train_forest(_assembled(df), ["a", "b", "c", "d"], trees=6, depth=4, bins=BINS, seed=SEED)
    x = np.array([[math.nan if v is None else v for v in r[:4]] for r in rows])
    y, w = [r[4] for r in rows], np.array([r[5] for r in rows])
    low, high = forest._row_bits(np.arange(len(rows)))
    cuts = 0
    for t, tree in enumerate(m.trees):
        drawn = w * forest._copies(low, high, t, SEED)
        todo = [(0, [i for i in range(len(rows)) if drawn[i] > 0], 0)]
        for node, inside, level in todo:
            look = sorted(np.random.default_rng((SEED, t, node)).choice(4, 2, replace=False).tolist()) if level < 4 else []
            classes, best = _plain(x, y, drawn, inside, look, node, t, level, 4, 3)
            assert tree.classes[node] == pytest.approx(classes)
            if best is None:
                assert tree.feature[node] == -1
                continue
            assert tree.gain[node] == pytest.approx(best[2]) and tree.feature[node] >= 0
            if (tree.feature[node], tree.cut[node]) == best[:2]:
                cuts += 1
            f, cut, a = tree.feature[node], tree.cut[node], tree.left[node]
            todo += [(a, [i for i in inside if x[i, f] <= cut], level + 1), (a + 1, [i for i in inside if not x[i, f] <= cut], level + 1)]
        assert len(todo) == len(tree.feature)
    assert cuts > 20 and all(1 not in t.feature for t in m.trees)       # b has one value


def test_votes_are_the_leaves_shares_and_are_read_back(spark, tmp_path):
    rows, df = _table(spark)
    m = forest.train_forest(_assembled(df), ["a", "b", "c", "d"], trees=9, depth=5, bins=BINS, seed=SEED)
    m.save(spark, str(tmp_path / "m"))
    back = forest.ForestModel.load(spark, str(tmp_path / "m"))
    assert back == m
    got = {tuple(r)[:4]: (r["prediction"], r["probability"]) for r in trees.predict(back, df).collect()}
    for r in rows:
        total = np.zeros(3)
        for t in m.trees:
            n = 0
            while t.feature[n] >= 0:
                v = r[t.feature[n]]
                n = t.left[n] + (0 if v is not None and v <= t.cut[n] else 1)
            total += np.array(t.classes[n]) / sum(t.classes[n])
        prediction, probability = got[r[:4]]
        assert probability == pytest.approx((total / 9).tolist()) and probability[int(prediction)] == max(probability)
    assert m.importances().sum() == pytest.approx(1.0) and m.importances()[1] == 0.0
    hits = sum(got[r[:4]][0] == r[4] for r in rows)
    assert hits > 0.6 * len(rows)


def test_leaves_of_one_answer_are_taken_together():
    t = forest.Tree(classes=[[9.0, 3.0]])
    a = t.split(0, 0, 1.0, 0.1, [6.0, 1.0], [3.0, 2.0])
    t.split(a, 1, 2.0, 0.1, [5.0, 0.0], [1.0, 1.0])
    assert t.prune() == forest.Tree(classes=[[9.0, 3.0]])
    t.classes[a + 1] = [2.0, 3.0]
    assert t.prune().feature == [0, -1, -1]


def test_copies_are_poisson_and_independent():
    low, high = forest._row_bits(np.arange(200_000) + (3 << 33))
    a, b = (forest._copies(low, high, t, 42).astype(float) for t in (0, 1))
    for v in (a, b):
        assert [np.mean(v == i) for i in range(4)] == pytest.approx([math.exp(-1) / math.factorial(i) for i in range(4)], abs=5e-3)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01 and abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.01


def test_one_class_no_cut_and_no_rows(spark):
    df = _assembled(spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 2, 1.0)] * 8, "a double, b double, c double, d double, label int, weight double"))
    m = forest.train_forest(df, ["a", "b", "c", "d"], trees=3, depth=2)
    assert [t.feature for t in m.trees] == [[-1]] * 3
    assert {r["prediction"] for r in m.transform(df).collect()} == {2.0}
    with pytest.raises(ValueError):
        forest.train_forest(df.filter("a > 1"), ["a", "b", "c", "d"])


def test_moments_take_few_aggregates_at_once(spark):
    names = [f"x{i}" for i in range(40)]
    df = spark.createDataFrame([[float(i * j % 7) if i or j % 2 else None for j in range(40)] for i in range(20)], ", ".join(f"{n} double" for n in names))
    m = ds.scaler_moments(df, names)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("stddev_pop(") for line in re.findall(r"Aggregate .*", plan)) <= ds.AGGS_AT_ONCE
    got = {r["feature"]: (r["mean"], r["std"]) for r in m.collect()}
    for n in names:
        v = [r[0] for r in df.select(n).dropna().collect()]
        assert got[n] == pytest.approx((np.mean(v), np.std(v) or 1.0))


def test_rows_are_written_thousands_to_a_cell(spark):
    rows, df = _table(spark)
    points = forest.cut_points(df, ["a", "b", "c", "d"], BINS)
    written = forest._binned(df, ["a", "b", "c", "d"], "label", "weight", [0, 2, 3], points)
    got = written.collect()
    assert len(got) == 1 and got[0]["n"] == len(rows) and len(got[0]["x"]) == 3 * len(rows)
    kinds = {"y": (np.int32, None), "w": (np.float64, None), "x": (np.uint8, 3)}
    first = next(boosting.row_blocks(iter([written.toArrow().to_batches()[0]]), kinds))
    assert first[1].tolist() == [r[4] for r in rows] and first[2].tolist() == [r[5] for r in rows]
    assert first[3][0].tolist() == [int(r[0]) for r in rows]


def test_rows_followed_by_mask_number_or_together_are_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    x, level = rng.integers(0, 16, (4, 3000)).astype(np.uint8), 5
    feature, cut, left, depths = [-1], [0], [0], [0]
    for node in range(63):          # cut all over but for a few leaves
        if depths[node] < level and node % 7 != 5:
            feature[node], cut[node], left[node] = int(rng.integers(0, 4)), int(rng.integers(2, 13)), len(feature)
            feature, cut, left, depths = feature + [-1] * 2, cut + [0] * 2, left + [0] * 2, depths + [depths[node] + 1] * 2
        if node + 1 == len(feature):
            break
    feature, cut, left = (np.array(v, np.int64) for v in (feature, cut, left))
    count = np.array([int(d == level and n % 3 > 0) for n, d in enumerate(depths)])
    needed = count > 0
    for n in range(len(feature) - 1, -1, -1):
        if feature[n] >= 0:
            needed[n] = needed[left[n]] or needed[left[n] + 1]
    copies = rng.integers(0, 3, 3000).astype(np.uint8)
    for drawn in (None, copies):
        want = {}
        for row in range(3000):
            n = 0
            while feature[n] >= 0:
                n = left[n] + int(x[feature[n], row] > cut[n])
            if count[n] and (drawn is None or drawn[row]):
                want.setdefault(int(n), []).append(row)
        for few in (0, 40, 600, 1 << 30):
            monkeypatch.setattr(boosting, "FEW", few)
            large, node, rows = boosting.follow(x, drawn, feature, cut, left, needed, count, level)
            got = {int(n): r.tolist() for n, r in large if len(r)}
            for n, r in zip(node.tolist(), rows.tolist()):
                got.setdefault(n, []).append(r)
            assert {n: sorted(r) for n, r in got.items()} == want and len(want) > 4


def test_folds_share_one_pass_and_equal_trainings_of_their_own(spark, monkeypatch):
    names = ["a", "b", "c", "d"]
    monkeypatch.setattr(trees.config, "FEATURE_NAMES", names)
    rows = [(r[0], 5.1, r[2] + 0.1, r[3], r[4], i % 3) for i, r in enumerate(_table(spark)[0])]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, label int, fold int").repartition(3)
    stats = ds.fold_stats(df, "fold", names, BINS)
    for f in range(3):
        tr = df.filter(f"fold <> {f}")
        moments, seen = ds.moments_without(stats, f, names, BINS)
        want = [(r["feature"], r["mean"], r["std"]) for r in ds.scaler_moments(tr, names).collect()]
        assert [m[0] for m in moments] == names and [m[1:] for m in moments] == [pytest.approx(w[1:]) for w in want]
        told = forest._values(ds.standardize(tr, moments), names, BINS)
        assert [s[:4] for s in map(str, ([x[0], x[3]] for x in seen))] == [s[:4] for s in map(str, ([x[0], x[3]] for x in told))]
        for s, t in zip(seen, told):
            assert s[1:3] == pytest.approx(t[1:3], nan_ok=True) and sorted(s[4]) == pytest.approx(sorted(t[4]))
    got = trees.cross_validate(df, k=3, trees=5, depth=4, seed=SEED).orderBy("fold").collect()
    for f, r in enumerate(got):
        tr, te = df.filter(f"fold <> {f}"), df.filter(f"fold = {f}")
        assert r["fold"] == f and 0.3 < r["accuracy"] <= 1.0
    assert got[0]["accuracy_mean"] == pytest.approx(np.mean([r["accuracy"] for r in got]))
    assert ds.fold_stats(df.filter("a > 99"), "fold", names, BINS) == {}
