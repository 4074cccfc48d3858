"""Boosted trees against plain loops."""
import math

import numpy as np
import pytest

from netlake.ml import boosting
from netlake.ml.boosting import BoostModel, BoostParams, train_boosted

NAMES = ["a", "b", "c"]
PLAIN = dict(subsample=1.0, colsample=1.0, bins=16, min_child_weight=1.0)


def _rows(n=600, seed=3):
    r = np.random.RandomState(seed)
    x = np.round(r.rand(n, 3), 2)
    y = np.where(x[:, 0] > 0.6, 2, np.where(x[:, 1] > 0.5, 5, 0))
    w = np.where(y == 2, 2.0, 1.0)
    return x, y, w


def _frame(spark, x, y, w, parts=3):
    rows = [(*map(float, r), int(v), float(q)) for r, v, q in zip(x, y, w)]
    return spark.createDataFrame(rows, "a double, b double, c double, label int, weight double").repartition(parts)


def _loop_root(x, y, w, edges, classes, p):
    """Best first cut of each class by trying every edge on every row."""
    def score(g, h):
        return max(abs(g) - p.alpha, 0.0) ** 2 / (h + p.lam)

    best = []
    for c in classes:
        q = 1 / len(classes)
        g, h = (q - (y == c)) * w, 2 * q * (1 - q) * w
        found = (-1.0, None, None)
        for f in range(x.shape[1]):
            for e in edges[f]:
                left = x[:, f] <= e
                if min(h[left].sum(), h[~left].sum()) < p.min_child_weight:
                    continue
                gain = (score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum())
                        - score(g.sum(), h.sum()))
                if gain > found[0] + 1e-3:
                    found = (gain, f, e)
        best.append(found)
    return best


def test_first_cut_is_the_best_of_all(spark):
    x, y, w = _rows()
    df, p = _frame(spark, x, y, w), BoostParams(rounds=1, depth=1, **PLAIN)
    m = train_boosted(df, NAMES, p)
    edges = boosting.bin_edges(df, NAMES, p.bins)
    for t, c, (gain, f, e) in zip(m.trees, m.classes, _loop_root(x, y, w, edges, m.classes, p)):
        assert (t.feature[0], t.cut[0]) == (f, e)
        assert t.gain[0] == pytest.approx(gain, rel=1e-3)
        left = x[:, f] <= e
        for node, on in ((t.left[0], left), (t.right[0], ~left)):
            g, h = ((1 / 3 - (y == c)) * w)[on].sum(), (4 / 9 * w)[on].sum()
            want = -p.rate * math.copysign(max(abs(g) - p.alpha, 0), g) / (h + p.lam)
            assert t.value[node] == pytest.approx(want, rel=1e-3)


def test_loss_falls_and_classes_are_learnt(spark, tmp_path):
    x, y, w = _rows()
    df = _frame(spark, x, y, w)
    m = train_boosted(df, NAMES, BoostParams(rounds=8, depth=3, rate=0.5, bins=32, cut_every=3, min_child_weight=1.0))
    assert len(m.history) == 8 and m.history[0] == pytest.approx(math.log(3), abs=1e-4)
    assert all(b < a for a, b in zip(m.history, m.history[1:]))
    m.save(spark, str(tmp_path / "m"))
    out = BoostModel.load(spark, str(tmp_path / "m")).transform(df).collect()
    assert np.mean([r["prediction"] == r["label"] for r in out]) > 0.97
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in out)
    imp = m.importances()
    assert imp.sum() == pytest.approx(1) and imp[2] < min(imp[0], imp[1])


def test_written_scores_and_replayed_trees_agree(spark):
    """The same trees whatever the partitions, the groups of open nodes and how often scores are written."""
    x, y, w = _rows(300)
    got = []
    for parts, cut, cells in ((1, 100, 1 << 22), (5, 1, 1)):
        old, boosting.CELLS = boosting.CELLS, cells
        try:
            p = BoostParams(rounds=3, depth=3, cut_every=cut, **PLAIN)
            got.append(train_boosted(_frame(spark, x, y, w, parts), NAMES, p))
        finally:
            boosting.CELLS = old
    assert got[0].history == got[1].history
    for s, t in zip(got[0].trees, got[1].trees):
        assert sorted(zip(s.feature, s.cut, s.gain)) == sorted(zip(t.feature, t.cut, t.gain))


def test_sampling_leaves_out_rows_and_features():
    rows = np.arange(20000)
    a, b = boosting._sampled(rows, 0, 0.8, 42), boosting._sampled(rows, 1, 0.8, 42)
    assert abs(a.mean() - 0.8) < 0.02 and abs((a & b).mean() - 0.64) < 0.02
    assert (a == boosting._sampled(rows, 0, 0.8, 42)).all() and boosting._sampled(rows, 0, 1.0, 42).all()


def test_odd_rows(spark):
    schema = "a double, b double, c double, label int, weight double, probability_ string"
    with pytest.raises(ValueError):
        train_boosted(spark.createDataFrame([], schema), NAMES, BoostParams(rounds=1))
    odd = spark.createDataFrame([(None, 1.0, 2.0, 0, 1.0, None), (float("nan"), 1.0, 2.0, 0, 1.0, "x"),
                                 (5.0, 1.0, 2.0, None, 1.0, "x"), (5.0, 1.0, 2.0, 0, None, "x")], schema)
    m = train_boosted(odd, NAMES, BoostParams(rounds=2, depth=2, **PLAIN))
    assert m.classes == [0] and [t.feature for t in m.trees] == [[-1], [-1]]
    assert [r["prediction"] for r in m.transform(odd).collect()] == [0.0] * 4


def test_features_in_one_bin_are_not_summed(spark, monkeypatch):
    x, y, w = _rows(300)
    x[:, 2] = 4.0
    df, p = _frame(spark, x, y, w), BoostParams(rounds=2, depth=3, **PLAIN)
    seen = []
    cells = boosting._cells
    monkeypatch.setattr(boosting, "_cells", lambda *a: seen.append(a[4]) or cells(*a))
    m = train_boosted(df, NAMES, p)
    assert {i for columns in seen for c in columns for i in c} == {0, 1}
    two = train_boosted(df, ["a", "b"], p)
    assert [(t.feature, t.cut, t.gain, t.value) for t in m.trees] == [(t.feature, t.cut, t.gain, t.value) for t in two.trees]
    flat = train_boosted(df, ["c"], p)          # nothing to cut, but each node has its value
    assert [t.feature for t in flat.trees] == [[-1]] * 6 and all(t.value[0] != 0 for t in flat.trees[:3])


def test_small_batches_are_joined():
    import pyarrow as pa
    parts = [pa.RecordBatch.from_pydict({"a": list(range(7))})] * 20000
    assert [t.num_rows >= boosting.BLOCK for t in boosting._blocks(parts)] == [True, True, False]


def test_rows_are_written_thousands_to_a_cell_with_the_columns_that_vary(spark):
    x, y, w = _rows()
    x[:, 1] = 0.5           # cannot be cut
    df = _frame(spark, x, y, w, parts=1)
    edges = [np.array([0.25, 0.5, 0.75]), np.array([]), np.array([0.5])]
    written = boosting._binned(df, NAMES, "label", "weight", [0, 2, 5], edges, [0, 2])
    cells = list(boosting.row_blocks(iter(written.toArrow().to_batches()), boosting._kinds(3, 2)))
    assert written.count() == 1 and len(cells) == 1
    row, label, weight, bins, scores = cells[0]
    got = sorted(zip(label.tolist(), weight.tolist(), *map(np.ndarray.tolist, bins)))
    want = sorted((([0, 2, 5].index(int(v)), float(q), int(np.searchsorted(edges[0], r[0])), int(np.searchsorted(edges[2], r[2])))
                   for r, v, q in zip(x, y, w)))
    assert got == want and len(set(row.tolist())) == len(x) and scores.shape == (3, len(x)) and not scores.any()
