"""Numbers of tables in Pitman-Yor restaurants, drawn from their exact conditional.

A dish with c customers at t tables weighs S(c, t) H**t, with S the generalised Stirling numbers of the discount d and H
the parent's probability of the dish; all dishes of a restaurant share the factor theta (theta + d) ... (theta + (T-1) d)
of its T tables.  Written as an integral over G ~ Gamma(theta / d + T), that factor splits over the dishes: given G, the
tables of all dishes are independent, with weight S(c, t) (d G H)**t.  One sweep draws G given T and then every t given
G, so all customers are seated anew and G is all that a sweep hands to the next.

S(c, t) comes from a table up to ``EXACT`` customers.  Beyond, S(c, t) = c! / (t! d**t) times the probability that t
Sibuya variables add up to c, which is a short series for few tables and a saddlepoint for many (they differ by about a
hundredth where they meet).  If more than ``NODES`` tables are likely, weights are log-linear between that many.
The cost of a dish does not depend on its number of customers.
"""

from __future__ import annotations

import math

import numpy as np

STRENGTH = 5.0
DISCOUNT = 0.8
EXACT = 1024
NODES = 32
SERIES = 120
MEET = 2.4
ROWS = 512


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive numbers."""
    x = np.asarray(x, float)
    small = np.where(x < 8, x, 1.0)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(small + k)
    y = np.where(x < 8, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return out - np.where(x < 8, shift, 0.0)


_TABLE: list[np.ndarray] = []


def stirling() -> np.ndarray:
    """log S(c, t) for up to ``EXACT`` customers."""
    if not _TABLE:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[0, 0] = 0.0
        for c in range(EXACT):
            t = np.arange(1, c + 2)
            with np.errstate(divide="ignore"):
                out[c + 1, t] = np.logaddexp(out[c, t - 1], out[c, t] + np.log(np.maximum(c - DISCOUNT * t, 0)))
        _TABLE.append(out)
    return _TABLE[0]


_J = np.arange(1, SERIES + 1)


def _series() -> tuple[np.ndarray, np.ndarray]:
    """Signs and logs of 1 / Gamma(-d j), 0 where d j is a whole number."""
    z = DISCOUNT * _J
    whole = np.abs(z - np.round(z)) < 1e-9
    sine = np.where(whole, 0.0, -np.sin(math.pi * np.where(whole, 0.5, z)))
    # 1 / Gamma(-z) = Gamma(z + 1) * (-sin(pi z)) / pi
    return np.sign(sine), np.where(whole, -np.inf, log_gamma(z + 1) + np.log(np.maximum(np.abs(sine), 1e-300)) - math.log(math.pi))


_SIGN, _LOG_RECIPROCAL = _series()


def log_sibuya(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log P(t Sibuya variables add up to c), for many customers; ``t`` has one row of numbers for each of ``c``."""
    c, t = np.asarray(c, float)[:, None], np.asarray(t, float)
    own = log_gamma(np.maximum(c - DISCOUNT * _J, 1e-9)) - log_gamma(c + 1) + _LOG_RECIPROCAL
    own[DISCOUNT * _J >= c] = -np.inf
    c = np.broadcast_to(c, t.shape)
    out = np.full(t.shape, -np.inf)
    few = t * c**-DISCOUNT <= MEET
    if few.any():
        b = t[few][:, None]
        with np.errstate(divide="ignore"):
            term = np.cumsum(np.log(np.maximum(b - _J + 1, 0) / _J), axis=1) + own[np.nonzero(few)[0]]
        top = term.max(axis=1)
        total = np.exp(term - top[:, None]) @ (np.where(_J % 2 == 1, -1, 1) * _SIGN)
        out[few] = top + np.log(np.maximum(total, 1e-300))
    many = ~few & (t < c)
    if many.any():
        a, b = c[many], t[many]
        s = _saddle(lambda z, y: b * DISCOUNT * z * y ** (DISCOUNT - 1) / (1 - y**DISCOUNT), a)
        y, z = np.exp(s), -np.expm1(s)
        phi = 1 - y**DISCOUNT
        first = DISCOUNT * z * y ** (DISCOUNT - 1) / phi
        # Second derivative of log phi(e^u).
        second = first * (1 + (1 - DISCOUNT) * z / y - first)
        out[many] = b * np.log(phi) - a * np.log(z) - 0.5 * np.log(2 * math.pi * b * np.maximum(second, 1e-300))
    out[t == c] = t[t == c] * math.log(DISCOUNT)
    return out


def _saddle(mean, wanted: np.ndarray) -> np.ndarray:
    """log y with mean(1 - y, y) = wanted; the mean falls in y."""
    low, high = np.full(wanted.shape, -90.0), np.full(wanted.shape, -1e-12)
    for _ in range(45):
        s = (low + high) / 2
        above = mean(-np.expm1(s), np.exp(s)) > wanted
        low, high = np.where(above, s, low), np.where(above, high, s)
    return (low + high) / 2


def _pick(logits: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column of each row, with probability proportional to exp(logits)."""
    mass = np.cumsum(np.exp(logits - logits.max(axis=1, keepdims=True)), axis=1)
    return (mass < rng.random(len(mass))[:, None] * mass[:, -1:]).sum(axis=1)


def _draw_large(c: np.ndarray, rate: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    s = _saddle(lambda z, y: rate * DISCOUNT * z * y ** (DISCOUNT - 1), c.astype(float))
    middle = np.maximum(rate * (1 - np.exp(DISCOUNT * s)), 1)
    reach = 6 * np.sqrt(middle) + 12
    low = np.clip(np.floor(middle - reach), 1, c).astype(np.int64)
    high = np.clip(np.ceil(middle + reach), low, c).astype(np.int64)
    count = np.minimum(high - low + 1, NODES)
    k = np.minimum(np.arange(NODES), count[:, None] - 1)
    nodes = low[:, None] + (k * (high - low)[:, None]) // np.maximum(count - 1, 1)[:, None]
    logits = nodes * np.log(rate)[:, None] - log_gamma(nodes + 1) + log_sibuya(c, nodes)
    logits[np.arange(NODES) >= count[:, None]] = -np.inf
    # Each node stands for the numbers up to halfway to its neighbours.
    left = np.c_[nodes[:, :1], (nodes[:, :-1] + nodes[:, 1:]) // 2 + 1]
    right = np.c_[left[:, 1:] - 1, nodes[:, -1:]]
    at = _pick(logits + np.log(np.maximum(right - left + 1, 1)), rng)
    row = np.arange(len(c))
    a, b = left[row, at], np.maximum(right[row, at], left[row, at])
    return np.clip(a + (rng.random(len(c)) * (b - a + 1)).astype(np.int64), 1, c)


def draw(customers: np.ndarray, rate: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish; ``rate`` is G times the parent's probability of the dish."""
    out = np.minimum(customers, 1).astype(np.int64)
    rate = np.maximum(rate, 1e-300)
    log_s, begin = stirling(), 2
    while begin <= EXACT:  # rows of about the same number of customers at once
        stop = min(2 * begin, EXACT + 1)
        chosen = np.flatnonzero((customers >= begin) & (customers < stop))
        for part in np.array_split(chosen, max(1, -(-len(chosen) * stop // (1 << 20)))) if len(chosen) else ():
            t = np.arange(1, stop)
            logits = log_s[customers[part], 1:stop] + t * np.log(DISCOUNT * rate[part])[:, None]
            out[part] = 1 + _pick(logits, rng)
        begin = stop
    large = np.flatnonzero(customers > EXACT)
    for part in np.array_split(large, -(-len(large) // ROWS)) if len(large) else ():
        out[part] = _draw_large(customers[part], rate[part], rng)
    return out


def draw_mass(tables: np.ndarray | float, rng: np.random.Generator) -> np.ndarray:
    """G of restaurants, given all their tables."""
    return rng.gamma(STRENGTH / DISCOUNT + np.asarray(tables, float))
