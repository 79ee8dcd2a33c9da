"""Tail probabilities of small result tables (one value per test)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * scale


@F.pandas_udf(T.DoubleType())
def _chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([
        _upper_gamma(k / 2.0, v / 2.0) if pd.notna(v) and pd.notna(k) and k > 0 else None
        for v, k in zip(x, df)
    ], dtype="float64")


def chi2_tail(statistic: Column, degrees: Column) -> Column:
    """P(chi-square with ``degrees`` > statistic)."""
    return _chi2_tail(statistic.cast("double"), degrees.cast("double"))
