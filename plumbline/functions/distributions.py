"""Two-sided p-values for single statistics. Spark has no such functions.

They run on the few rows an aggregation leaves, one per compared measure.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, modified Lentz method.

    NaN if it does not settle.
    """
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            change = c * d
            value *= change
        if abs(change - 1.0) < 1e-15:
            return value
    return math.nan


def _half_step(a: float) -> float:
    """log of gamma(a + 1/2) / gamma(a), without the difference of two large numbers."""
    if a < 50:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    # asymptotic series in 1/a
    u = 1.0 / a
    return 0.5 * math.log(a) - u / 8 + u**3 / 192 - u**5 / 640 + 17 * u**7 / 14336


def student_two_sided(t: float, freedom: float) -> float:
    """P(|T| >= |t|) of Student's distribution; one formula for all degrees of freedom.

    The incomplete beta function at freedom / (freedom + t**2), by its continued
    fraction on the side where that converges fast.
    """
    if math.isnan(t) or math.isnan(freedom):
        return math.nan
    if math.isinf(t):
        return 0.0
    a, square = freedom / 2.0, t * t
    if square == 0.0:
        return 1.0
    x, complement = freedom / (freedom + square), square / (freedom + square)
    # x**a and complement**(1/2) / beta(a, 1/2), in logarithms
    power = -a * math.log1p(square / freedom) + 0.5 * math.log(complement)
    front = math.exp(power + _half_step(a) - math.lgamma(0.5))
    if x < (a + 1.0) / (a + 2.5):
        return front * _beta_fraction(a, 0.5, x) / a
    return 1.0 - front * _beta_fraction(0.5, a, complement) / 0.5


def _over(function, *values: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if any(pd.isna(v) for v in row) else function(*row)
            for row in zip(*values)
        ],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _over(normal_two_sided, z)


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return _over(student_two_sided, t, freedom)
