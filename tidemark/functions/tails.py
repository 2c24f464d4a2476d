"""Tail probabilities of test statistics, on NumPy and ``math`` only."""

from __future__ import annotations

import math

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + term / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1) if i else front


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    if not (math.isfinite(t) and df > 0):
        return math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_upper(x: float, df: int) -> float:
    """Upper tail of chi-square: the incomplete gamma function's series or its closed form for even df."""
    if df % 2 == 0:
        term = total = 1.0
        for k in range(1, df // 2):
            term *= x / 2 / k
            total += term
        return math.exp(-x / 2) * total
    z = math.sqrt(x)
    total, term = 0.0, z
    for k in range(1, df, 2):
        if k > 1:
            term *= x / k
        total += term
    return math.erfc(z / math.sqrt(2)) + math.sqrt(2 / math.pi) * math.exp(-x / 2) * (total if df > 1 else 0)


def midranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1; ties share their mean rank."""
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return (last - (count - 1) / 2)[inverse]


def mann_whitney(high: np.ndarray, low: np.ndarray) -> tuple[float, float]:
    """U of the first sample and its two-sided p: exact for at most 8 values in a sample without ties, else normal with corrections."""
    n, m = len(high), len(low)
    both = np.concatenate([high, low])
    u = midranks(both)[:n].sum() - n * (n + 1) / 2
    _, ties = np.unique(both, return_counts=True)
    if min(n, m) <= 8 and ties.max() == 1:
        ways = np.zeros(n * m + 1)
        ways[0] = 1
        for k in range(1, n + 1):  # Gaussian binomial coefficients: numbers of samples by U
            grown = ways.copy()
            grown[m + k :] -= ways[: len(ways) - m - k]
            for i in range(k, len(grown)):
                grown[i] += grown[i - k]
            ways = grown
        top = int(max(u, n * m - u))
        return float(u), float(min(1.0, 2 * ways[top:].sum() / ways.sum()))
    total = n + m
    var = n * m / 12 * (total + 1 - (ties**3 - ties).sum() / (total * (total - 1)))
    if var <= 0:
        return float(u), 1.0
    z = (max(u, n * m - u) - n * m / 2 - 0.5) / math.sqrt(var)
    return float(u), min(1.0, normal_two_sided(max(z, 0.0)))


def wilcoxon(d: np.ndarray) -> tuple[float, float, float]:
    """Signed-rank W (the smaller sum), its two-sided p, and (positive - negative) / non-zero counts; zeros are dropped."""
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0, 0.0
    rank = midranks(np.abs(d))
    plus, minus = rank[d > 0].sum(), rank[d < 0].sum()
    w, effect = min(plus, minus), ((d > 0).sum() - (d < 0).sum()) / n
    _, ties = np.unique(np.abs(d), return_counts=True)
    if n <= 50 and ties.max() == 1:
        ways = np.ones(1)
        for k in range(1, n + 1):
            ways = np.append(ways, np.zeros(k)) + np.append(np.zeros(k), ways)
        return float(w), float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n)), float(effect)
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    return float(w), min(1.0, normal_two_sided((w - n * (n + 1) / 4) / math.sqrt(var))), float(effect)


def kruskal(groups: list[np.ndarray]) -> tuple[float, float]:
    """Kruskal-Wallis H with tie correction, and p."""
    both = np.concatenate(groups)
    n, rank, at, total = len(both), midranks(both), 0, 0.0
    for g in groups:
        total += rank[at : at + len(g)].sum() ** 2 / len(g)
        at += len(g)
    _, ties = np.unique(both, return_counts=True)
    correction = 1 - (ties**3 - ties).sum() / (n**3 - n)
    if correction == 0:
        return math.nan, math.nan
    h = (12 / (n * (n + 1)) * total - 3 * (n + 1)) / correction
    return float(h), chi2_upper(max(h, 0.0), len(groups) - 1)
