"""Map projections of the WGS84 ellipsoid as expressions: transverse Mercator by Krüger's series, both ways, and sinusoidal.

Angles are degrees, lengths metres. Every function is written once over a small set of operators, so the same
series gives Spark columns or SQL texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the conventions of UTM.
A, INVERSE_FLATTENING = 6378137.0, 298.257223563
SCALE, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0

_f = 1 / INVERSE_FLATTENING
N = _f / (2 - _f)
E2 = _f * (2 - _f)
#: The radius of the circle as long as a meridian.
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)

# The series in the third flattening, to its fourth power (the next terms are below a micrometre).
FORWARD = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
INVERSE = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
LATITUDE = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)
MERIDIAN = (-3 * N / 2 + 9 * N**3 / 16, 15 * N**2 / 16 - 15 * N**4 / 32, -35 * N**3 / 48, 315 * N**4 / 512)


@dataclass(frozen=True)
class Sql:
    """A SQL text with the operators that the series need."""

    text: str

    def _with(self, op: str, other: Sql | float, turned: bool = False) -> Sql:
        a, b = self.text, other.text if isinstance(other, Sql) else f"({float(other)!r}::double)"
        return Sql(f"({b} {op} {a})" if turned else f"({a} {op} {b})")

    def __add__(self, o): return self._with("+", o)  # noqa: E704
    def __radd__(self, o): return self._with("+", o, True)  # noqa: E704
    def __sub__(self, o): return self._with("-", o)  # noqa: E704
    def __rsub__(self, o): return self._with("-", o, True)  # noqa: E704
    def __mul__(self, o): return self._with("*", o)  # noqa: E704
    def __rmul__(self, o): return self._with("*", o, True)  # noqa: E704
    def __truediv__(self, o): return self._with("/", o)  # noqa: E704


Number = Column | Sql


def _call(name: str, *args: Number) -> Number:
    if isinstance(args[0], Sql):
        return Sql(f"{name}({', '.join(a.text for a in args)})")
    return getattr(F, name)(*args)


def zone_of(lon: Column) -> Column:
    """The UTM zone, 1 to 60, of a longitude in [-180, 180]."""
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def central(zone: Number) -> Number:
    """The central meridian of a UTM zone."""
    return zone * 6.0 - 183.0


def _turned(lon: Number, lat: Number, lon0: Number) -> tuple[Number, Number]:
    """The tangent of the conformal latitude and the angle from the central meridian."""
    s, d = _call("sin", _call("radians", lat)), _call("radians", lon - lon0)
    c = 2 * sqrt(N) / (1 + N)
    return _call("sinh", _call("atanh", s) - _call("atanh", s * c) * c), d


def _sphere(t: Number, d: Number) -> tuple[Number, Number]:
    return _call("atan2", t, _call("cos", d)), _call("atanh", _call("sin", d) / _call("sqrt", t * t + 1.0))


def _plane(xi: Number, eta: Number) -> tuple[Number, Number]:
    east, north = eta, xi
    for j, a in enumerate(FORWARD, 1):
        u, v = xi * (2.0 * j), eta * (2.0 * j)
        east = east + _call("cos", u) * _call("sinh", v) * a
        north = north + _call("sin", u) * _call("cosh", v) * a
    return east * (SCALE * RECTIFYING) + FALSE_EAST, north * (SCALE * RECTIFYING)


def utm(lon: Number, lat: Number, lon0: Number) -> tuple[Number, Number]:
    """(east, north) on the zone about lon0; north runs on below zero in the south, see FALSE_NORTH."""
    return _plane(*_sphere(*_turned(lon, lat, lon0)))


def from_utm(east: Number, north: Number, lon0: Number) -> tuple[Number, Number]:
    """(lon, lat) of a place on the zone about lon0, north below zero in the south."""
    xi, eta = north / (SCALE * RECTIFYING), (east - FALSE_EAST) / (SCALE * RECTIFYING)
    x, e = xi, eta
    for j, b in enumerate(INVERSE, 1):
        u, v = xi * (2.0 * j), eta * (2.0 * j)
        x = x - _call("sin", u) * _call("cosh", v) * b
        e = e - _call("cos", u) * _call("sinh", v) * b
    chi = _call("asin", _call("sin", x) / _call("cosh", e))
    lat = chi
    for j, c in enumerate(LATITUDE, 1):
        lat = lat + _call("sin", chi * (2.0 * j)) * c
    return lon0 + _call("degrees", _call("atan2", _call("sinh", e), _call("cos", x))), _call("degrees", lat)


def sinusoidal(lon: Number, lat: Number) -> tuple[Number, Number]:
    """(x, y) on the equal-area sinusoidal projection of the ellipsoid about the meridian 0."""
    p = _call("radians", lat)
    s = _call("sin", p)
    y = p
    for j, c in enumerate(MERIDIAN, 1):
        y = y + _call("sin", p * (2.0 * j)) * c
    return _call("radians", lon) * _call("cos", p) * A / _call("sqrt", 1.0 - s * s * E2), y * RECTIFYING


def as_points(ring: Column, lon0: Column) -> Column:
    """array<struct<x, y>> of metres from an array<struct<x, y>> of degrees.

    Inside a lambda Spark evaluates what stands several times as often, so each step is a pass of its own.
    """
    pair = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    turned = F.transform(ring, lambda v: pair(_turned(v["x"], v["y"], lon0)))
    sphere = F.transform(turned, lambda v: pair(_sphere(v["x"], v["y"])))
    return F.transform(sphere, lambda v: pair(_plane(v["x"], v["y"])))


def corners(box: Column, lon0: Column) -> Column:
    """array<struct<x, y>> of degrees: the four corners of a box struct<west, south, east, north> of metres."""
    def place(x: str, y: str) -> Column:
        lon, lat = from_utm(box[x], box[y], lon0)
        return F.struct(lon.alias("x"), lat.alias("y"))

    return F.array(place("west", "south"), place("east", "south"), place("east", "north"), place("west", "north"))
