"""Tail probabilities in plain Python, and as columns over small aggregated results (Arrow batches)."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_TINY = 1e-300


def norm_sf(z: float) -> float:
    """P(Z > z) of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Upper regularized incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * lead)
    b, c = x + 1 - a, 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta by continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return 1.0 if df <= 0 else beta_i(df / 2, 0.5, df / (df + t * t))


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def ks_sf(d: float, n: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov tail, ``n`` the effective size."""
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


def _over(fn: Callable[..., float], *cols: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(*series: pd.Series) -> pd.Series:
        rows = zip(*series)
        return pd.Series([None if any(v is None or v != v for v in r) else fn(*map(float, r)) for r in rows], dtype="float64")

    return run(*[c.cast("double") for c in cols])


def p_normal(z: Column) -> Column:
    """Two-sided p of a normal score; null for null."""
    return _over(lambda x: 2 * norm_sf(abs(x)), z)


def p_t(t: Column, df: Column) -> Column:
    return _over(t_two_sided, t, df)


def p_chi2(x: Column, df: Column) -> Column:
    return _over(chi2_sf, x, df)


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _over(f_sf, f, d1, d2)


def p_ks(d: Column, n: Column) -> Column:
    return _over(ks_sf, d, n)
