"""Tests of a sample's mean and covariance, and the tails of the distributions they need."""

from __future__ import annotations

import math

import numpy as np


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function Q(a, x): a series below a + 1, else a continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, k: float) -> float:
    return gamma_tail(k / 2, x / 2)


def f_tail(x: float, m: float, n: float) -> float:
    return beta_part(n / 2, m / 2, n / (n + m * x)) if x > 0 else 1.0


def mean_test(n: float, mu: np.ndarray, s: np.ndarray, mean: np.ndarray) -> tuple[float, float]:
    """Hotelling's statistic of a sample (its size, mean and covariance) against a mean, and its p-value."""
    away, d = mu - mean, len(mu)
    t2 = float(away @ np.linalg.pinv(s) @ away * n)
    return t2, f_tail((n - d) * t2 / d / (n - 1), d, n - d)


def covariance_test(n: float, s: np.ndarray, sigma: np.ndarray) -> tuple[float, float]:
    """The statistic W of a sample's covariance against another one, and its p-value."""
    d = len(s)
    back = np.linalg.pinv(np.linalg.cholesky(sigma))
    y = back @ s @ back.T
    away = y - np.identity(d)
    w = float(np.trace(away @ away) / d - np.trace(y) ** 2 / n / d + d / n)
    return w, chi2_tail(w * n * d / 2, d * (d + 1) / 2)
