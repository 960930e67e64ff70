"""Tails and quantiles of distributions, applied to result rows (numbers of tests, not of measurements)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

Z90, Z95, Z99 = 1.6448536269514722, 1.959963984540054, 2.5758293035489004


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - s, 1e300
    d = 1 / b
    h = d
    for i in range(1, 400):
        an = -i * (i - s)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_p(t: float | None, df: float | None) -> float | None:
    """Two-sided p of Student's t."""
    return None if t is None or df is None or df <= 0 or math.isnan(t) else beta_inc(df / 2, 0.5, df / (df + t * t))


def f_p(f: float | None, d1: float | None, d2: float | None) -> float | None:
    return None if None in (f, d1, d2) or d1 <= 0 or d2 <= 0 or math.isnan(f) else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_p(x: float | None, df: float | None) -> float | None:
    return None if x is None or df is None or df <= 0 or math.isnan(x) else gamma_upper(df / 2, x / 2)


def t_quantile(p: float, df: float) -> float:
    """By bisection; p above one half."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_p(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def _typed2(fn):
    @F.arrow_udf("double")
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([fn(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return two


def _typed3(fn):
    @F.arrow_udf("double")
    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array([fn(x, y, z) for x, y, z in zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), strict=True)], pa.float64())

    return three


def t_pvalue(t, df):
    return _typed2(t_p)(t.cast("double"), df.cast("double"))


def f_pvalue(f, d1, d2):
    return _typed3(f_p)(f.cast("double"), d1.cast("double"), d2.cast("double"))


def chi2_pvalue(x, df):
    return _typed2(chi2_p)(x.cast("double"), df.cast("double"))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]
