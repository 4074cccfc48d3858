"""Models that were saved and read back score as before; CV figures."""
import json
import statistics

import pytest

from netlake import config
from netlake.ml import models, trees
from netlake.ml.boosting import BoostModel, BoostParams
from netlake.operators import dataset as ds
from netlake.queries_more import cleaned

from conftest import SF001


@pytest.fixture(scope="module")
def flows(spark):
    return cleaned(spark, SF001).limit(400).cache()


@pytest.mark.parametrize("boost", [None, BoostParams(rounds=1, depth=2, bins=8)])
def test_reloaded_models_score_alike(spark, flows, boost, tmp_path):
    m, _ = models.train(flows, trees_n=3, depth=3, iso_trees=3, iso_samples=64, ae_k=8, boost=boost)
    back = models.load(spark, models.save(m, str(tmp_path / "m"), spark))
    assert isinstance(back.classifier, BoostModel) == (boost is not None)
    assert back.metadata == m.metadata and json.loads(back.metadata["attack_labels"]).keys() == {
        str(k) for k in config.ATTACK_LABELS}
    assert back.metadata["autoencoder_trained"] and back.metadata["cv_accuracy_mean"] == back.metadata["test_accuracy"]
    cols = ["prediction", "probability", "iso_score", "ae_error"]
    a, b = (sorted(map(tuple, models.score_flows(x, flows).select(*cols).collect())) for x in (m, back))
    assert a == b and len(a) == flows.count()
    if boost:
        top = trees.feature_importance(back.classifier, top=5).collect()
        assert top[0]["relative"] == 1.0


def test_folds_have_mean_and_deviation(spark, flows):
    cv = trees.cross_validate(ds.stratified_folds(ds.stratified_split(flows), 2), k=2, trees=3, depth=3).collect()
    for c in ("accuracy", "f1_weighted"):
        values = [r[c] for r in cv]
        assert cv[0][f"{c}_mean"] == pytest.approx(statistics.mean(values))
        assert cv[1][f"{c}_std"] == pytest.approx(statistics.pstdev(values))
