"""The model queries ask for the reference's whole job; what they ask for is caught, so nothing large is fitted here."""

from pathlib import Path

import pytest

from panelwright.ml import models
from panelwright.plans import modelling

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data here")


class Caught(Exception):
    pass


@pytest.fixture
def asked(monkeypatch):
    fits, searches = [], []

    def train(df, family, target, stages, params, *rest, **more):
        fits.append((family, params))
        raise Caught

    def cross_validate(df, family, target, stages, fold="fold_id", weight=None, n=50, overrides=None, **more):
        searches.append((family, n, weight, overrides))
        if family == "mlp" or len(searches) == 1 and more:
            raise Caught
        return df.sparkSession.range(1)

    monkeypatch.setattr(models, "train", train)
    monkeypatch.setattr(models, "cross_validate", cross_validate)
    return fits, searches


@pytest.mark.parametrize("family", ["gbt", "gbt_regression", "rf", "rf_regression"])
def test_trees_are_fitted_with_the_fixed_parameters(spark, asked, family):
    with pytest.raises(Caught):
        modelling.QUERIES[f"train_{family}"](spark, FOLDER)
    params = asked[0][0][1]
    if "gbt" in family:
        assert params == {"maxIter": 200, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.7, "minInstancesPerNode": 5, "minInfoGain": 0.0, "maxBins": 32, "featureSubsetStrategy": "sqrt"}
    else:
        impurity = "variance" if "regression" in family else "entropy"
        assert params == {"numTrees": 150, "maxDepth": 20, "minInstancesPerNode": 10, "maxBins": 32, "featureSubsetStrategy": "auto", "subsamplingRate": 0.7, "impurity": impurity}


@pytest.mark.parametrize("family", ["lr", "svm", "mlp", "glm", "linear"])
def test_other_families_are_searched(spark, asked, family):
    with pytest.raises(Caught):
        modelling.QUERIES[f"train_{family}"](spark, FOLDER)
    assert not asked[0] and [x[:3] for x in asked[1]] == [(family, 4, "weight")]


def test_search_and_selection(spark, asked):
    fits, searches = asked
    with pytest.raises(Caught):
        modelling.QUERIES["cv_search"](spark, FOLDER)
    assert [x[:2] for x in searches] == [("lr", 4), ("svm", 4), ("mlp", 4)] and all("maxIter" not in x[3] for x in searches)
    with pytest.raises(Caught):
        modelling.QUERIES["rf_feature_select"](spark, FOLDER)
    assert fits == [("rf", {"numTrees": 200, "maxDepth": 10})]
