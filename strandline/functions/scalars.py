"""Scalar functions of strings, numbers, geometry and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def path_part(path: Column, from_end: int) -> Column:
    """A component of a path, counted from the file's name (0) upwards; null beyond the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > from_end, F.element_at(parts, F.lit(-1 - from_end)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def missing(x: Column) -> Column:
    """NaN as null, so that both kinds of missing behave alike."""
    return F.when(~F.isnan(x), x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def yeo_johnson(x: Column, lam: float) -> Column:
    """The power transform, all four branches."""
    pos = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def tone(x: Column, k: float) -> Column:
    """A tanh curve to 0..255, truncated."""
    return (F.tanh(k * x) / math.tanh(k) * 255).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(a: Column) -> Column:
    """The array's exponentials over their sum, less the maximum first."""
    top = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.flatten(F.transform(F.array(total), lambda t: F.transform(a, lambda x: F.exp(x - top) / t)))


def argmax(a: Column) -> Column:
    """Position from 0 of the largest element, the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def normalised_difference(a: Column, b: Column) -> Column:
    return (a - b) / F.greatest(a + b, F.lit(1.0))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2989 * r + 0.587 * g + 0.114 * b


def sinusoidal(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Sinusoidal projection in metres."""
    return EARTH_M * F.radians(lon) * F.cos(F.radians(lat)), EARTH_M * F.radians(lat)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """The EPSG code of the UTM zone."""
    zone = (F.floor((lon + 180) / 6) + 1).cast("int")
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def unit_circle(lon: Column, lat: Column) -> list[Column]:
    return [f(F.radians(c)).alias(f"{n}_{k}") for n, c in (("lon", lon), ("lat", lat)) for k, f in (("sin", F.sin), ("cos", F.cos))]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column, eps: float = 1e-8) -> Column:
    """The vector over its length (plus eps), as doubles. The length is computed once a vector."""
    length = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"), lambda s: F.sqrt(s) + eps)
    return F.flatten(F.transform(F.array(length), lambda n: F.transform(a, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def snapped(west: Column, south: Column, east: Column, north: Column, cell: float) -> list[Column]:
    """The box grown outwards to the grid of the given cell size."""
    down, up = (lambda c: F.floor(c / cell) * cell), (lambda c: F.ceil(c / cell) * cell)
    return [down(west).alias("west"), down(south).alias("south"), up(east).alias("east"), up(north).alias("north")]


def inverted(m: Column) -> Column:
    """The map from each element of the values, which are arrays, to its key; elements must be distinct."""
    return F.map_from_entries(F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda v: F.struct(v.alias("key"), e["key"].alias("value"))))))


def plain_spaces(text: Column) -> Column:
    """Without zero-width spaces, narrow no-break spaces as plain ones, and trimmed."""
    return F.trim(F.translate(F.replace(text, F.lit("\u200b"), F.lit("")), "\u202f", " "))


def base64_line(text: Column) -> Column:
    """Base64 of the text's UTF-8 on one line; Spark breaks lines after 76 characters."""
    return F.translate(F.base64(text.cast("binary")), "\r\n", "")


def reshaped(a: Column, width: int) -> Column:
    """The flat array as rows of ``width`` elements; the last row may be shorter, an empty array has none."""
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i, width))
