import numpy as np
import pytest

from plumbline.llm import pitman_yor as py
from plumbline.llm import seating


def log_stirling(customers):
    """log S(customers, t) for all t, by the recursion."""
    row = np.full(customers + 2, -np.inf)
    row[0] = 0
    for c in range(customers):
        t, new = np.arange(1, c + 2), np.full(customers + 2, -np.inf)
        with np.errstate(divide="ignore"):
            new[t] = np.logaddexp(row[t - 1], row[t] + np.log(np.maximum(c - seating.DISCOUNT * t, 0)))
        row = new
    return row[1 : customers + 1]


def moments(logits):
    t, p = np.arange(1, len(logits) + 1), np.exp(logits - logits.max())
    mean = (t * p).sum() / p.sum()
    return mean, np.sqrt(((t - mean) ** 2 * p).sum() / p.sum())


@pytest.mark.parametrize("customers", [3, 60, 3000])
@pytest.mark.parametrize("rate", [0.3, 40.0, 4000.0])
def test_tables_follow_the_exact_conditional(customers, rate):
    t = np.arange(1, customers + 1)
    mean, spread = moments(log_stirling(customers) + t * np.log(seating.DISCOUNT * rate))
    found = seating.draw(np.full(4000, customers), np.full(4000, rate), np.random.default_rng(1))
    assert found.mean() == pytest.approx(mean, abs=0.1 * spread + 1e-9) and found.std() == pytest.approx(spread, rel=0.12, abs=0.01)


def test_production_moves_reach_the_distribution_of_a_large_restaurant():
    """One dish with 3,000 customers: p(t) is proportional to S(c, t) theta (theta + d) ... (theta + (t - 1) d) H**t."""
    customers, parent = 3000, 0.05
    t = np.arange(1, customers + 1)
    rising = np.cumsum(np.log(seating.STRENGTH + seating.DISCOUNT * np.arange(customers)))
    mean, _ = moments(log_stirling(customers) + rising + t * np.log(parent))
    rng = np.random.default_rng(2)
    found = [py.reseat(np.array([customers]), np.array([parent]), rng)[0] for _ in range(400)]
    assert np.mean(found) == pytest.approx(mean, rel=0.1)
