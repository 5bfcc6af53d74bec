"""Two-sided p-values of Student's t and Pearson's r, by the regularised incomplete beta function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The incomplete beta function's continued fraction, by the modified Lentz method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    log_gamma = np.frompyfunc(math.lgamma, 1, 1)
    gamma = lambda v: np.asarray(log_gamma(v), float)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    near = inside < (a + 1) / (a + b + 2)
    direct = front * _fraction(np.where(near, a, b), np.where(near, b, a), np.where(near, inside, 1 - inside)) / np.where(near, a, b)
    out = np.where(near, direct, 1 - direct)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_p_value(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(t) & (df > 0)
    safe = np.where(ok, t, 0.0)
    d = np.where(ok, df, 1.0)
    return np.where(ok, incomplete_beta(d / 2, 0.5, d / (d + safe * safe)), np.where(np.isinf(t), 0.0, np.nan))


def t_to_p(t: Column, df: Column) -> Column:
    """Two-sided p of ``t`` with ``df`` degrees of freedom; null where either is."""

    @F.pandas_udf("double")
    def work(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_p_value(t.to_numpy(float), df.to_numpy(float)))

    return F.when(t.isNotNull() & df.isNotNull(), F.nanvl(work(t.cast("double"), df.cast("double")), F.lit(None).cast("double")))


def r_to_p(r: Column, n: Column) -> Column:
    """Two-sided p of Pearson's ``r`` over ``n`` pairs."""
    df = n - 2
    t = F.when(F.abs(r) < 1, r * F.sqrt(df / (1 - r * r))).otherwise(F.lit(float("inf")))
    return t_to_p(t, df)
