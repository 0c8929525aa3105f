"""Fitting the power transform from a histogram: one pass over the data, then a search over few numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.agg import histogram


def _loss(lam: float, x: np.ndarray, n: np.ndarray) -> float:
    pos = x >= 0
    t = np.empty_like(x)
    t[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else ((x[pos] + 1) ** lam - 1) / lam
    t[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-12 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    mean = np.average(t, weights=n)
    var = np.average((t - mean) ** 2, weights=n)
    return n.sum() / 2 * math.log(max(var, 1e-300)) - (lam - 1) * float((np.sign(x) * np.log1p(np.abs(x)) * n).sum())


def _minimum(x: np.ndarray, n: np.ndarray, low: float = -2.0, high: float = 4.0, steps: int = 60) -> float:
    """Golden section."""
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    for _ in range(steps):
        if _loss(c, x, n) < _loss(d, x, n):
            b, d = d, c
            c = b - g * (b - a)
        else:
            a, c = c, d
            d = a + g * (b - a)
    return (a + b) / 2


def fit_yeo_johnson(df: DataFrame, key: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(key, lam): the maximum-likelihood parameter of each key's values, from bin centres scaled by ``high``.

    ``bins`` counts a key come to the driver; keys are bands, a few.
    """
    counts = histogram(df, key, F.col(value).cast("double"), low, high, bins).collect()
    by: dict = {}
    for k, b, n in counts:
        by.setdefault(k, []).append(((low + (b + 0.5) * (high - low) / bins) / high, n))
    rows = [(k, round(_minimum(*np.array(v, float).T), 4)) for k, v in sorted(by.items())]
    return df.sparkSession.createDataFrame(rows, f"{key} {dict(df.dtypes)[key]}, lam double")
