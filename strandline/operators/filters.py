"""Image filters on tiles held as flat arrays: separable convolution with mirrored borders, and what is scored by it.

A tile stays one row; each pass is an array expression over it. Borders are mirrored without repeating
the edge pixel. Null pixels make null where a kernel meets them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the filters: smoothing and derivative of the Sobel operator, and the second difference.
SMOOTH, SLOPE, SECOND = (1.0, 2.0, 1.0), (-1.0, 0.0, 1.0), (1.0, -2.0, 1.0)


def gaussian(size: int, sigma: float) -> tuple[float, ...]:
    """Weights of a normalised Gaussian of an odd number of taps."""
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return tuple(x / sum(raw) for x in raw)


def _mirrored(i: int, n: int) -> int:
    while n > 1 and not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i if n > 1 else 0


def _pass(tile: Column, height: int, width: int, kernel: tuple[float, ...], across: bool) -> Column:
    """One pass along rows (``across``) or columns. ``tile`` should be a plain column: it is looked into at every pixel."""
    terms = []
    for k, weight in enumerate(kernel):
        d = k - len(kernel) // 2
        spots = [y * width + _mirrored(x + d, width) if across else _mirrored(y + d, height) * width + x for y in range(height) for x in range(width)]
        if weight:
            terms.append((float(weight), F.array(*map(F.lit, spots))))
    return F.transform(tile, lambda _, i: reduce(lambda a, b: a + b, (F.lit(w) * F.get(tile, F.get(spots, i)) for w, spots in terms)))


def convolved(df: DataFrame, tile: str, into: str, height: int, width: int, kernel_y: tuple[float, ...], kernel_x: tuple[float, ...]) -> DataFrame:
    """df with ``into``: the tile convolved with the product of both kernels (of odd length; (1.0,) leaves an axis alone)."""
    half = df.withColumn("_half", _pass(F.col(tile), height, width, kernel_x, True))
    return half.withColumn(into, _pass(F.col("_half"), height, width, kernel_y, False)).drop("_half")


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def median(ordered: Column) -> Column:
    """Of a sorted array without nulls."""
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def robust_spread(df: DataFrame, values: str, into: str) -> DataFrame:
    """1.4826 times the median distance from the median of each row's array."""
    d = df.withColumn("_m", median(F.sort_array(values)))
    d = d.withColumn("_d", F.sort_array(F.transform(values, lambda x: F.abs(x - F.col("_m")))))
    return d.withColumn(into, 1.4826 * median(F.col("_d"))).drop("_m", "_d")


def quality_scores(df: DataFrame, tile: str, height: int, width: int) -> DataFrame:
    """df with ``sharpness`` (variance of the Laplacian of the 5x5 Gaussian of sigma 1), ``noise`` (robust spread of what that blur
    takes away), ``gradient`` (mean Sobel magnitude), ``spread`` (robust, of the tile) and ``denoised`` (5x5 Gaussian of sigma 0.8)."""
    d = df.withColumn("_t", F.transform(tile, lambda x: x.cast("double")))
    d = convolved(d, "_t", "_b", height, width, gaussian(5, 1.0), gaussian(5, 1.0))
    d = convolved(convolved(d, "_b", "_lx", height, width, (1.0,), SECOND), "_b", "_ly", height, width, SECOND, (1.0,))
    d = convolved(convolved(d, "_t", "_gx", height, width, SMOOTH, SLOPE), "_t", "_gy", height, width, SLOPE, SMOOTH)
    d = convolved(d, "_t", "denoised", height, width, gaussian(5, 0.8), gaussian(5, 0.8))
    d = d.withColumns({"_l": F.zip_with("_lx", "_ly", lambda a, b: a + b), "_r": F.zip_with("_t", "_b", lambda a, b: a - b), "gradient": mean(F.zip_with("_gx", "_gy", lambda a, b: F.sqrt(a * a + b * b)))})
    d = d.withColumn("_m", mean(F.col("_l"))).withColumn("sharpness", mean(F.transform("_l", lambda x: (x - F.col("_m")) * (x - F.col("_m")))))
    d = robust_spread(robust_spread(d, "_r", "noise"), "_t", "spread")
    return d.drop("_t", "_b", "_lx", "_ly", "_gx", "_gy", "_l", "_r", "_m")
