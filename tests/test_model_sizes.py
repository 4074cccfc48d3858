"""Registered model queries train at the full sizes."""
import inspect

import pytest

import __spark_entry__ as ent
from netlake.ml import iforest, models, trees

from conftest import SF001

FOREST = (trees, "train_classifier", {"trees": 500, "depth": 20})
SIZES = {"rf_scores": FOREST, "feature_importance": FOREST, "cv_metrics": (trees, "cross_validate", {"k": 5, "trees": 200, "depth": 8}),
         "iforest_scores": (iforest, "fit_iforest", {"n_trees": 300, "max_samples": 80_000}),
         "model_metadata": (models, "train", {"trees_n": 500, "depth": 20, "iso_trees": 300, "iso_samples": 80_000})}


class Called(Exception):
    pass


@pytest.mark.parametrize("name", SIZES)
def test_full_sizes(spark, monkeypatch, name):
    module, function, sizes = SIZES[name]
    signature = inspect.signature(getattr(module, function))

    def stop(*args, **kwargs):
        call = signature.bind(*args, **kwargs)
        call.apply_defaults()
        raise Called({k: call.arguments[k] for k in sizes})

    monkeypatch.setattr(module, function, stop)
    with pytest.raises(Called) as got:
        ent.queries()[name](spark, SF001)
    assert got.value.args[0] == sizes
