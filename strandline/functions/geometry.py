"""Small geometry on columns: circles about rings, boxes in degrees, centres and corners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.scalars import EARTH_M


def mean_point(ring: Column) -> Column:
    """struct<x, y>: the mean of the vertices of array<struct<x, y>>."""
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, v: s + v[c].cast("double")) / F.size(ring)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def centroid(ring: Column) -> Column:
    """struct<x, y>: the centroid of the area of a ring array<struct<x, y>>, not closed; of no area, the mean of its vertices."""
    n, o = F.size(ring), F.element_at(ring, 1)  # relative to a vertex, for the differences of large coordinates

    def part(v: Column, i: Column) -> Column:
        w = F.element_at(ring, ((i + 1) % n + 1).cast("int"))
        ax, ay, bx, by = v["x"] - o["x"], v["y"] - o["y"], w["x"] - o["x"], w["y"] - o["y"]
        cross = ax * by - bx * ay
        return F.struct(cross.alias("a"), ((ax + bx) * cross).alias("x"), ((ay + by) * cross).alias("y"))

    names = ("a", "x", "y")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in names])
    sums = F.aggregate(F.transform(ring, part), zero, lambda s, p: F.struct(*[(s[c] + p[c]).alias(c) for c in names]))
    # Bound by a lambda, so that the sums are made once.
    middle = lambda s: F.when(s["a"] == 0, mean_point(ring)).otherwise(F.struct((o["x"] + s["x"] / (3 * s["a"])).alias("x"), (o["y"] + s["y"] / (3 * s["a"])).alias("y")))
    return F.get(F.transform(F.array(sums), middle), F.lit(0))


def radius(ring: Column, centre: Column) -> Column:
    """The largest distance of a vertex from the centre."""
    return F.array_max(F.transform(ring, lambda v: F.hypot(v["x"] - centre["x"], v["y"] - centre["y"])))


def square(centre: Column, half: Column) -> Column:
    """array<struct<x, y>>: the corners of the square about the centre, from the lower left one around."""
    corner = lambda a, b: F.struct((centre["x"] + a * half).alias("x"), (centre["y"] + b * half).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def box_around(lon: Column, lat: Column, width_m: float, height_m: float) -> Column:
    """struct<west, south, east, north> in degrees of a box of metres, on a local equirectangular projection."""
    dy = F.degrees(F.lit(height_m / 2 / EARTH_M))
    dx = F.degrees(F.lit(width_m / 2 / EARTH_M)) / F.cos(F.radians(lat))
    return F.struct((lon - dx).alias("west"), (lat - dy).alias("south"), (lon + dx).alias("east"), (lat + dy).alias("north"))


def bounds(points: Column) -> Column:
    """struct<west, south, east, north> of array<struct<x, y>>, such as the four projected corners of a box."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def centre_of(box: Column) -> Column:
    """struct<x, y>: the middle of a box."""
    return F.struct(((box["west"] + box["east"]) / 2).alias("x"), ((box["south"] + box["north"]) / 2).alias("y"))
