"""Tail probabilities of reduced statistics, in plain Python: applied to a handful of rows on the driver or in reports."""

from __future__ import annotations

import math


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_tail(x: float, df: int) -> float:
    return gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, a: float, b: float) -> float:
    return beta_i(b / 2, a / 2, b / (b + a * f)) if f > 0 else 1.0


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def anderson_deviation(n: float, k: float, inverse_sizes: float) -> float:
    """Standard deviation of the k-sample Anderson-Darling statistic of n values; inverse_sizes: the sum of 1 / size over samples.

    The double sum in it is taken to its limit beyond a million values, where it differs by less than 1e-4.
    """
    import numpy as np

    m = int(min(n, 1_000_000))
    harmonic = np.cumsum(1.0 / np.arange(1, m))
    g = math.pi**2 / 6 if n > m else float(((harmonic[-1] - harmonic[: m - 2]) / (m - np.arange(1, m - 1))).sum())
    h = float(harmonic[-1]) if n <= m else math.log(n - 1) + 0.5772156649015329
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * inverse_sizes
    b = (2 * g - 4) * k * k + 8 * h * k + (2 * g - 14 * h - 4) * inverse_sizes - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k * k + (4 * h - 4 * g + 6) * k + (2 * h - 6) * inverse_sizes + 4 * h
    d = (2 * h + 6) * k * k - 4 * h * k
    return math.sqrt((a * n**3 + b * n**2 + c * n + d) / ((n - 1) * (n - 2) * (n - 3)))


def signed_rank_tail(ranks: list[float], w: float) -> float:
    """Two-sided probability of a signed-rank sum of w or less over all signs of the ranks, halves where there are ties."""
    ways = [1]
    for r in (round(2 * r) for r in ranks):
        ways = [a + b for a, b in zip([*ways, *[0] * r], [*[0] * r, *ways])]
    return min(1.0, 2 * sum(ways[: round(2 * w) + 1]) / 2 ** len(ranks))


def kolmogorov_tail(d: float, n: int, m: int) -> float:
    """Asymptotic two-sample probability."""
    x = d * math.sqrt(n * m / (n + m))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101)))) if x > 0.2 else 1.0
