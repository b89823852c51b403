"""Number of tables at which the customers of a dish sit, drawn from its exact conditional.

Given the restaurant's other tables, ``t`` tables for ``c`` customers of one dish have the weight ``S(c, t) * base^t``
times the product of ``strength + discount * (others + j)`` over ``j < t``, where ``S`` are the generalised Stirling
numbers of the discount: all ways to seat ``c`` customers at ``t`` tables.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EXACT = 256  # customers up to which the numbers come from their recursion; beyond, from a saddle point
_GRID = 65
_NEWTON = 5  # steps; the error is below a millionth after five
_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive values: Stirling's series eight places higher, and back."""
    x = np.asarray(x, np.float64)
    back = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + sum(a / y ** (2 * i + 1) for i, a in enumerate(_SERIES)) - back


@lru_cache(maxsize=4)
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of ``S(c, t)`` for ``c, t <= most``: the next customer joins one of ``t`` tables or opens another."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            join = out[c] + np.log(np.maximum(c - discount * t, 0))
        out[c + 1] = np.logaddexp(join, np.r_[-np.inf, out[c][:-1]])
    return out


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """``log S(c, t)`` for ``1 <= t < c``: the coefficient of ``x^c`` in ``((1 - (1 - x)^d) / d)^t``, times ``c! / t!``."""
    ly = np.clip(np.log(d * t / c) / (1 - d), -700, -1e-9)
    for _ in range(_NEWTON):
        y, yd = np.exp(ly), np.exp(d * ly)
        miss = np.log1p(-y) + (d - 1) * ly + np.log(d) - np.log1p(-yd) - np.log(c / t)
        ly = np.clip(ly - miss / (d - 1 - y / (1 - y) + d * yd / (1 - yd)), -700, -1e-9)
    y = np.exp(ly)
    spread = c * np.maximum(1 + (1 - y) * (1 - d) / y - c / t, 1e-9)
    return log_gamma(c + 1) - log_gamma(t + 1) + t * (np.log1p(-np.exp(d * ly)) - np.log(d)) - c * np.log1p(-y) - 0.5 * np.log(2 * np.pi * spread)


@lru_cache(maxsize=4)
def _few_tables(discount: float) -> np.ndarray:
    """What the saddle point misses where few tables hold many customers; it depends on the number of tables."""
    t = np.arange(1, EXACT // 4 + 1, dtype=np.float64)
    return stirling(discount)[EXACT, 1:len(t) + 1] - _saddle(np.full(len(t), float(EXACT)), t, discount)


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """``log S(c, t)`` for many customers and any real ``1 <= t < c``."""
    known = _few_tables(discount)
    return _saddle(c, t, discount) + np.interp(t, np.arange(1, len(known) + 1), known, right=0.0)


def _pick(logits: np.ndarray, rng) -> np.ndarray:
    """A column of each row, by the exponential of its value."""
    total = np.cumsum(np.exp(logits - logits.max(axis=1, keepdims=True)), axis=1)
    return np.minimum((total < rng.random(len(total))[:, None] * total[:, -1:]).sum(axis=1), logits.shape[1] - 1)


def draw_tables(customers: np.ndarray, base: np.ndarray, others: np.ndarray, strength: float, discount: float, rng) -> np.ndarray:
    """Tables of each dish, given its customers, its probability in the parent and the restaurant's other tables.

    A dish without customers has none, one customer has one. Dishes of up to ``EXACT`` customers are drawn from all
    their weights; larger ones from the weights around the most likely number, on a grid of 65 points where the
    spread is wider.
    """
    c = np.asarray(customers, np.int64)
    out = np.minimum(c, 1).astype(np.float64)
    log_base, first = np.log(base), strength / discount + others
    logs = stirling(discount)
    small = np.flatnonzero((c > 1) & (c <= EXACT))
    small = small[np.argsort(c[small], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, np.diff(c[small]) > 0, True]) if len(small) else np.array([0])
    for i, j in zip(cuts, cuts[1:]):
        for k in range(i, j, 1 << 16):
            at = small[k:min(j, k + (1 << 16))]
            n = int(c[at[0]])
            opened = np.cumsum(np.log(first[at, None] + np.arange(n)) + (log_base[at] + np.log(discount))[:, None], axis=1)
            out[at] = _pick(opened + logs[n, 1:n + 1], rng) + 1
    large = np.flatnonzero(c > EXACT)
    for k in range(0, len(large), 1 << 10):
        at = large[k:k + (1 << 10)]
        n, f, b = c[at].astype(np.float64)[:, None], first[at, None], log_base[at, None] + np.log(discount)
        weight = lambda t: log_stirling(np.broadcast_to(n, t.shape), t, discount) + t * b + log_gamma(f + t) - log_gamma(f)  # noqa: E731, B023
        low, high = np.zeros_like(n), np.log(n - 1)
        for _ in range(18):  # weights rise to one number and fall beyond it
            third = (high - low) / 3
            left = weight(np.exp(low + third)) > weight(np.exp(high - third))
            low, high = np.where(left, low, low + third), np.where(left, high - third, high)
        mode = np.exp((low + high) / 2)
        low = np.floor(np.maximum(1, mode - 6 * np.sqrt(mode) - 4))
        step = np.maximum(1, (np.minimum(n - 1, mode + 6 * np.sqrt(mode) + 8) - low) / (_GRID - 1))
        t = low + step * np.arange(_GRID)
        inside = t <= n - 1
        value = np.where(inside, weight(np.minimum(t, n - 1)), -np.inf)
        chosen = np.take_along_axis(t, _pick(value, rng)[:, None], axis=1)
        wide = chosen + (rng.random(chosen.shape) - 0.5) * np.where(step > 1, step, 0)
        out[at] = np.clip(np.rint(wide), 1, n - 1)[:, 0]
    return out
