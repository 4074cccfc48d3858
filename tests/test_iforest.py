"""Isolation forest samples."""
import numpy as np
from pyspark.sql import functions as F

from netlake.ml import iforest
from netlake.operators import dataset as ds


def _nodes(nodes):
    return sorted(tuple(r) for r in nodes.collect())


def test_each_tree_has_psi_rows_in_any_order(spark):
    x = np.random.RandomState(1).rand(2000, 2).tolist()
    x += [[0.5, 0.5]] * 200
    a = spark.createDataFrame(x, "a double, b double").repartition(3)
    b = spark.createDataFrame(x[::-1], "a double, b double").coalesce(1)
    for trees in (5, 40):           # fewer and more sampled rows than the table has
        got, psi = iforest.fit_iforest(a, ["a", "b"], trees, 100)
        rows = _nodes(got)
        assert psi == 100 and [r[6] for r in rows if r[1] == 0] == [100] * trees
        assert rows == _nodes(iforest.fit_iforest(b, ["a", "b"], trees, 100)[0])
    whole, psi = iforest.fit_iforest(a, ["a", "b"], 3, 80_000)
    assert psi == 2200 and [r[6] for r in _nodes(whole) if r[1] == 0] == [2200] * 3


def _loop_score(trees, psi, row):
    total = 0.0
    for nodes in trees:
        at, depth = 0, 0
        while nodes[at][2] >= 0:
            at, depth = (nodes[at][4] if row[nodes[at][2]] < nodes[at][3] else nodes[at][5]), depth + 1
        total += depth + iforest.c_factor(nodes[at][6])
    return -2.0 ** (-(total / len(trees)) / iforest.c_factor(psi))


def test_features_of_one_value_are_left_out_and_trees_are_packed(spark):
    x = [(7.0, a, None, b) for a, b in np.random.RandomState(2).rand(300, 2).tolist()]
    df = spark.createDataFrame(x, "k double, a double, n double, b double")
    names = ["k", "a", "n", "b"]
    nodes, psi = iforest.fit_iforest(df, names, 6, 64)
    assert {r[2] for r in _nodes(nodes)} == {-1, 1, 3}
    trees = [sorted(tuple(r) for r in nodes.where(f"tree_id = {t}").collect()) for t in range(6)]
    packed = iforest._packed(nodes.where("tree_id = 0").toPandas().sort_values("node"))
    assert sum(a.itemsize for a in packed) == 14
    for r in iforest.score_iforest(spark, df, nodes, psi, names, max_nodes_per_pass=100).take(40):
        assert abs(r["iso_score"] - _loop_score(trees, psi, (7.0, r["a"], 0.0, r["b"]))) < 1e-12


def test_all_chunks_are_scored_in_one_pass_and_held_one_at_a_time(spark):
    df = spark.createDataFrame(np.random.RandomState(4).rand(300, 2).tolist(), "a double, b double")
    nodes, psi = iforest.fit_iforest(df, ["a", "b"], 6, 64)
    scored = iforest.score_iforest(spark, df, nodes, psi, ["a", "b"], max_nodes_per_pass=100)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert sum("EvalPython" in line for line in plan.splitlines()) == 1
    one = iforest.score_iforest(spark, df, nodes, psi, ["a", "b"])
    assert np.allclose(sorted(r["iso_score"] for r in scored.collect()), sorted(r["iso_score"] for r in one.collect()), rtol=0, atol=1e-12)
    alive = []

    class Sent:
        def __init__(self, i):
            self.i, self._path = i, "there"

        @property
        def value(self):
            if not hasattr(self, "_value"):
                self._value = [self.i]
            return self._value

    sent = [Sent(i) for i in range(4)]
    for turn in range(2):
        for trees in iforest.one_at_a_time(sent):
            alive.append(([s.i for s in sent if hasattr(s, "_value")], trees))
    assert alive == [([], [i]) for i in range(4)] * 2


def test_rows_are_told_apart_by_nulls_and_values_only(spark):
    x = [(1.0, None if i % 3 else 2.0, None, float(i % 5)) for i in range(40)] + [(1.0, 2.0, None, float("nan"))] * 2
    names = ["one", "some", "none", "many"]
    df = spark.createDataFrame(x, "one double, some double, none double, many double")
    assert str(ds.feature_ranges(df, [F.col(c) for c in names])) == str([(1.0, 1.0, 0), (2.0, 2.0, 26), (None, None, 42), (0.0, float("nan"), 0)])
    assert ds.feature_ranges(df.filter("one > 1"), [F.col("one")]) == [(None, None, 0)]
    nodes, psi = iforest.fit_iforest(df, names, 3, 8)
    assert psi == 8 and {r[2] for r in _nodes(nodes)} == {-1, 3}
