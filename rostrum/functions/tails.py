"""Tail probabilities of the normal, chi-square and t distributions.

They are needed on result tables with one row per feature only. The formulas are
the textbook ones: complementary error function, and the continued fractions of
the incomplete beta and gamma functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
EPS = 1e-15


def _fraction(a_of, b_of, start: float) -> float:
    """Continued fraction ``start + a1/(b1 + a2/(b2 + …))`` by Lentz's method."""
    f = start if start else TINY
    c, d = f, 0.0
    for m in range(1, 2000):
        a, b = a_of(m), b_of(m)
        d = b + a * d or TINY
        c = b + a / c or TINY
        d = 1.0 / d
        f *= c * d
        if abs(c * d - 1.0) < EPS:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)

    def coefficient(n):
        if n == 1:
            return 1.0
        n -= 1
        m = n // 2
        if n % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    return front * _fraction(coefficient, lambda m: 1.0, 0.0)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * EPS:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    return front * _fraction(
        lambda m: 1.0 if m == 1 else -(m - 1) * (m - 1 - a),
        lambda m: x + 2 * m - 1 - a,
        0.0,
    )


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def chi2_critical(p: float, df: float = 1.0) -> float:
    """Statistic whose tail probability is ``p``."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if chi2_tail(mid, df) > p else (lo, mid)
    return (lo + hi) / 2.0


def _apply(fn, *series: pd.Series) -> pd.Series:
    def one(*values):
        if any(v is None or not np.isfinite(v) for v in values):
            return None
        return float(fn(*values))

    columns = [s.astype("float64") for s in series]
    return pd.Series([one(*v) for v in zip(*columns)], dtype="float64")


def normal_p(z: Column) -> Column:
    """Two-sided p value of a z score."""

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return _apply(normal_two_sided, z)

    return p(z)


def chi2_p(x: Column, df=1.0) -> Column:
    @F.pandas_udf("double")
    def p(x: pd.Series, df: pd.Series) -> pd.Series:
        return _apply(chi2_tail, x, df)

    return p(x, F.lit(float(df)) if isinstance(df, (int, float)) else df)


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p value of a t statistic."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return _apply(t_two_sided, t, df)

    return p(t, df)
