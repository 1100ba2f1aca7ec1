"""Tail probabilities with the standard library only."""

from __future__ import annotations

import math
from functools import cache


@cache
def _u_counts(n: int, m: int) -> tuple[int, ...]:
    """How many arrangements of n and m values have each U, from 0 on."""
    counts = [1] + [0] * (n * m)
    for i in range(1, n + 1):
        # Multiply by (1 - q^(m + i)) / (1 - q^i).
        for u in range(n * m, m + i - 1, -1):
            counts[u] -= counts[u - m - i]
        for u in range(i, n * m + 1):
            counts[u] += counts[u - i]
    return tuple(counts)


def mann_whitney(u: float, n: int, m: int, ties: float) -> float:
    """Two-sided. Exact for a group of up to 8 without ties, otherwise normal with corrections for ties and continuity.

    `ties`: the sum of t ** 3 - t over groups of equal values.
    """
    if not ties and min(n, m) <= 8:
        counts = _u_counts(n, m)
        tail = sum(counts[math.ceil(max(u, n * m - u)) :])
        return min(1.0, 2 * tail / math.comb(n + m, n))
    total = n + m
    spread = math.sqrt(n * m / 12 * (total + 1 - ties / (total * (total - 1))))
    if spread == 0:
        return 1.0
    return min(1.0, math.erfc((max(u, n * m - u) - n * m / 2 - 0.5) / spread / math.sqrt(2)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for k in range(1, 500):
        for step in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_t(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))
