"""Bands of multispectral pixels: order, selection, indices and composites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Positions from 0 of blue, green, red and near infrared among eight bands: fixed values.
FOUR_OF_EIGHT = (1, 3, 5, 7)
#: Weights of red, green and blue in brightness: fixed values.
BROAD = (1 / 3, 1 / 3, 1 / 3)


def select(bands: Column, order: tuple[int, ...]) -> Column:
    """The array's elements at the given positions; null beyond its end."""
    return F.array(*[F.get(bands, F.lit(i)) for i in order])


def scatter(bands: Column, order: tuple[int, ...], size: int) -> Column:
    """An array of ``size`` elements with the given ones at the given positions and zero elsewhere."""
    place = {at: i for i, at in enumerate(order)}
    return F.array(*[F.get(bands, F.lit(place[i])).cast("double") if i in place else F.lit(0.0) for i in range(size)])


def four(bands: Column) -> Column:
    """Blue, green, red and near infrared of pixels with four or eight bands; null for any other number."""
    return F.when(F.size(bands) == 4, bands).when(F.size(bands) == 8, select(bands, FOUR_OF_EIGHT))


def water_extraction(green: Column, near: Column, short1: Column, short2: Column) -> Column:
    """The automated water extraction index without shadows."""
    return 4 * (green - short1) - (0.25 * near - 2.75 * short2)


def weighted(bands: Column, weights: tuple[float, ...]) -> Column:
    """Sum of the bands times their weights."""
    return F.aggregate(F.zip_with(bands, F.array(*map(F.lit, weights)), lambda b, w: b.cast("double") * w), F.lit(0.0), lambda s, v: s + v)


def log_scaled(x: Column) -> Column:
    """log10(1 + x)."""
    return F.log10(1 + x)
