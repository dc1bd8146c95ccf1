"""Student-t probabilities for the few result rows of an inferential query.

No statistics library ships with Spark; these helpers run on aggregated results only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz iteration), all elements at once."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    result = d.copy()
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / away(1.0 + term * d)
            c = away(1.0 + term / c)
            result = result * c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    return result


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Evaluated once per distinct argument."""
    values, where = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in values])[where]


def incomplete_beta(a, b, x) -> np.ndarray:
    a, b, x = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1.0, 1.0, 0.0)
    inside = (x > 0.0) & (x < 1.0)
    a, b, x = a[inside], b[inside], x[inside]
    if len(x):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1.0) / (a + b + 2.0)
        # The fraction converges fast on one side; the other side is its complement.
        p, q, y = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1.0 - x)
        part = front * _beta_fraction(p, q, y) / p
        out[inside] = np.where(low, part, 1.0 - part)
    return out


def two_sided_p(t, df) -> np.ndarray:
    """P(|T| >= |t|) for Student's t; not a number where either is missing or df is not positive."""
    t, df = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(t, df))
    known = ~np.isnan(t) & (df > 0)
    n, s = np.where(known, df, 1.0), np.where(known & np.isfinite(t), t, 0.0)
    p = incomplete_beta(n / 2.0, 0.5, n / (n + s * s))
    return np.where(known, np.where(np.isinf(t), 0.0, p), np.nan)


def t_quantile(confidence, df) -> np.ndarray:
    """Half width of the central interval in standard errors, by bisection, once per distinct pair."""
    pairs, where = np.unique(np.stack(np.broadcast_arrays(np.atleast_1d(confidence), np.atleast_1d(df))).astype(float), axis=1, return_inverse=True)
    level, n = pairs
    low, high = np.zeros_like(n), np.ones_like(n)
    while (wide := two_sided_p(high, n) > 1.0 - level).any():
        high = np.where(wide, high * 2.0, high)
    for _ in range(80):
        middle = (low + high) / 2.0
        above = two_sided_p(middle, n) > 1.0 - level
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return np.where(n > 0, (low + high) / 2.0, np.nan)[where.ravel()]


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(two_sided_p(t.to_numpy(float), df.to_numpy(float)) if len(t) else [], dtype=float)


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation from n matched observations."""
    x, size = r.to_numpy(float), n.to_numpy(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(1.0 - x * x <= 0.0, np.inf, x * np.sqrt((size - 2.0) / ((1.0 - x) * (1.0 + x))))
    p = two_sided_p(np.where(np.isnan(x), np.nan, t), size - 2.0) if len(x) else []
    return pd.Series(p, dtype=float)


@F.pandas_udf(T.DoubleType())
def t_half_width(confidence: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_quantile(confidence.to_numpy(float), df.to_numpy(float)) if len(df) else [], dtype=float)
