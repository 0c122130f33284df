"""Distribution functions in numpy, and as pandas functions for columns.

The incomplete beta function comes from its continued fraction (modified Lentz), the
incomplete gamma function from series or continued fraction, quantiles from bisection on the
distribution function, which is monotone and so always converges.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

TINY = 1e-300


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if not (x == x and a > 0 and b > 0):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) / a
    c, d = 1.0, 1 / max(TINY, abs(1 - (a + b) * x / (a + 1))) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 5000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > TINY else TINY)
            c = 1 + top / (c if abs(c) > TINY else TINY)
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if not (x == x and a > 0):
        return math.nan
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    b, c = x + 1 - a, 1 / TINY
    d = 1 / b
    h = d
    for i in range(1, 5000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def t_cdf(t: float, df: float) -> float:
    if not (t == t and df > 0):
        return math.nan
    if t * t < df:
        # Near the middle the distance from one half is the accurate figure.
        return 0.5 + math.copysign(beta_inc(0.5, df / 2, t * t / (df + t * t)) / 2, t)
    tail = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_sf(t: float, df: float) -> float:
    return t_cdf(-t, df)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f == f and f >= 0 else math.nan


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_inc(df / 2, x / 2)


def norm_cdf(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def _quantile(cdf, p: float) -> float:
    if not 0 <= p <= 1:
        return math.nan
    if p in (0, 1):
        return math.copysign(math.inf, p - 0.5)
    low, high = -1.0, 1.0
    while cdf(low) > p:
        low *= 2
    while cdf(high) < p:
        high *= 2
    while (mid := (low + high) / 2) not in (low, high):
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return mid


def t_ppf(p: float, df: float) -> float:
    return _quantile(lambda x: t_cdf(x, df), p) if df > 0 else math.nan


def norm_ppf(p: float) -> float:
    return _quantile(norm_cdf, p)


def _column(function):
    """A pandas function of columns; null or impossible arguments give null."""

    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*(c.astype(float).to_numpy() for c in columns))
        out = np.array([function(*r) if all(x == x for x in r) else math.nan for r in rows], float)
        return pd.Series(out).where(~np.isnan(out))

    return run


@pandas_udf(DoubleType())
def t_cdf_column(t: pd.Series, df: pd.Series) -> pd.Series:
    return _column(t_cdf)(t, df)


@pandas_udf(DoubleType())
def t_p_column(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value."""
    return _column(lambda x, d: 2 * t_sf(abs(x), d))(t, df)


@pandas_udf(DoubleType())
def t_ppf_column(p: pd.Series, df: pd.Series) -> pd.Series:
    known: dict = {}
    return _column(lambda q, d: known[q, d] if (q, d) in known else known.setdefault((q, d), t_ppf(q, d)))(p, df)


@pandas_udf(DoubleType())
def f_sf_column(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _column(f_sf)(f, d1, d2)


@pandas_udf(DoubleType())
def chi2_sf_column(x: pd.Series, df: pd.Series) -> pd.Series:
    return _column(chi2_sf)(x, df)


@pandas_udf(DoubleType())
def norm_ppf_column(p: pd.Series) -> pd.Series:
    return _column(norm_ppf)(p)
