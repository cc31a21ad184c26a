"""Isotonic pools of any slicing equal the sequential fit."""

import numpy as np
import pytest

from plumbline.operators import training


def sequential(scores, hits):
    """(low, high, hits, n) of the levels, from sorted distinct scores."""
    pools = []
    for s in np.unique(scores):
        at = scores == s
        pools.append([s, s, int(hits[at].sum()), int(at.sum())])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            b = pools.pop()
            pools[-1] = [pools[-1][0], b[1], pools[-1][2] + b[2], pools[-1][3] + b[3]]
    return {tuple(p) for p in pools}


@pytest.mark.parametrize(("slices", "fan_in"), [(1, 16), (5, 16), (9, 2), (40, 3)])
@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "ties"])
def test_slices_do_not_change_the_fit(spark, slices, fan_in, kind):
    rng = np.random.default_rng(11)
    p = np.round(rng.random(600), 2 if kind == "ties" else 9)
    chance = {"noise": 0.3, "rising": p, "falling": 1 - p, "ties": p}[kind]
    y = (rng.random(600) < chance).astype(int)
    rows = [(int(k), float(a), float(1 - a), 0.5) for k, a in zip(y, p)] + [(None, 0.1, 0.2, 0.3), (1, None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "y int, p0 double, p1 double, p2 double")
    found = {k: set() for k in range(3)}
    for r in training.isotonic_pools(df, slices, fan_in).collect():
        found[r["class"]].add((r["low"], r["high"], r["hits"], r["n"]))
    assert found[0] == sequential(p, y == 0)
    assert found[1] == sequential(np.append(1 - p, 0.5), np.append(y == 1, True))
    assert found[2] == {(0.5, 0.5, 0, 601)}


def test_model_keeps_the_levels(spark):
    rng = np.random.default_rng(4)
    p = rng.random(300)
    rows = [(int(rng.random() < a), float(1 - a), float(a), 0.0) for a in p]
    df = spark.createDataFrame(rows, "y int, p0 double, p1 double, p2 double")
    table = {(r["class"], round(r["boundary"], 9)): r["value"] for r in training.calibration_table(training.isotonic_pools(df)).collect()}
    for k, model in enumerate(training.fit_calibration(df)):
        ends = {round(float(b), 9): float(v) for b, v in zip(model.boundaries, model.predictions)}
        assert ends == pytest.approx({b: v for (c, b), v in table.items() if c == k})
