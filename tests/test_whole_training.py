"""Training runs until the validation rows stop it; trying fewer rounds first changes no model."""

import numpy as np
import pytest

from plumbline.operators import evaluation, training
from plumbline.plans import catalog, flows


@pytest.mark.parametrize("name", ["train_report", "train_risk"])
def test_training_queries_may_use_all_rounds(spark, monkeypatch, name):
    asked = []

    def train(classes, settings=None, *_):
        asked.append((settings or training.BoostingSettings()).rounds)
        raise InterruptedError

    monkeypatch.setattr(flows, "train", train)
    with pytest.raises(InterruptedError):
        catalog.REGISTRY[name](spark, "/root/testdata/sf0.001")
    assert asked == [500] and evaluation.early_stopping_rounds(asked[0]) == 50


def test_fewer_rounds_first_give_the_same_model(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 3))
    y = np.where(x[:, 0] > 0.2, 1, np.where(rng.random(240) > 0.5, 0, 2))  # one class can be learned, two are noise
    rows = [(i, v, int(c), 1.0, i % 3 == 0) for i, (v, c) in enumerate(zip(x.tolist(), y))]
    df = training.as_vector(spark.createDataFrame(rows, "id long, features array<double>, y int, weight double, is_val boolean"))
    settings = training.BoostingSettings(rounds=30, step=0.3, depth=2, partitions=2)
    grown, fit = [], training.GBTClassifier.fit

    def counted(self, *args):
        grown.append(self.getMaxIter())
        return fit(self, *args)

    monkeypatch.setattr(training.GBTClassifier, "fit", counted)
    models = []
    for first in (10, 30):
        monkeypatch.setattr(training, "FIRST_ROUNDS", first)
        models.append([m.toDebugString.split("\n")[1:] for m in training.fit_boosting(df, settings).models])
    assert models[0] == models[1]
    assert grown.count(10) >= 3 and grown.count(30) >= 3
