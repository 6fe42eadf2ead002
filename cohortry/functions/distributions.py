"""Distribution functions that Spark has no expression for, over Arrow batches of numbers; null and NaN give null."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
_ERFC = np.vectorize(math.erfc, otypes=[float])


def normal_below(x: np.ndarray) -> np.ndarray:
    """P(X <= x) of the standard normal."""
    return 0.5 * _ERFC(-np.asarray(x, float) / math.sqrt(2))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, rounds + 1):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
    return out


def beta_below(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        out = np.where(low, front * _beta_fraction(a, b, np.where(low, x, 0.0)) / a, 1 - front * _beta_fraction(b, a, np.where(low, 0.0, 1 - x)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_below(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T <= t) of Student's t with df degrees of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    half = 0.5 * beta_below(df / 2, 0.5, df / (df + t * t))
    return np.where(t > 0, 1 - half, half)


def t_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The t below which share p lies, by bisection of the distribution function."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    low, high = np.full(p.shape, -1.0), np.full(p.shape, 1.0)
    for _ in range(60):
        low, high = np.where(t_below(low, df) > p, low * 2, low), np.where(t_below(high, df) < p, high * 2, high)
        if (t_below(low, df) <= p).all() and (t_below(high, df) >= p).all():
            break
    for _ in range(80):
        mid = (low + high) / 2
        below = t_below(mid, df) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def chi2_below(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X <= x) of chi-squared with df degrees of freedom: the series of the incomplete gamma function below df + 2, its continued fraction above."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    a, z = df / 2, np.maximum(x, 0) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(z) - z - _LGAMMA(a))
        term = total = 1 / a
        inner = np.where(z < a + 1, z, 0.0)
        for k in range(1, 400):
            term = term * inner / (a + k)
            total = total + term
        tiny, far = 1e-300, np.where(z < a + 1, a + 1, z)
        b = far + 1 - a
        c, d = np.full_like(b, 1 / tiny), 1 / b
        h = d.copy()
        for k in range(1, 400):
            step = -k * (k - a)
            b = b + 2
            d = step * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        out = np.where(z < a + 1, front * total, 1 - front * h)
    return np.where(z <= 0, 0.0, out)


def _column(function):
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        known = (x.notna() & df.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[known] = function(x.to_numpy(float)[known], df.to_numpy(float)[known])
        return pd.Series(out).where(known, None)

    return F.pandas_udf(run, "double")


def pnorm(x):
    return F.pandas_udf(lambda x: pd.Series(normal_below(x.to_numpy(float))).where(x.notna().to_numpy(), None), "double")(F.col(x) if isinstance(x, str) else x)


def pt(t, df):
    return _column(t_below)(t, df)


def qt(p, df):
    return _column(t_quantile)(p, df)


def pchisq(x, df):
    return _column(chi2_below)(x, df)
