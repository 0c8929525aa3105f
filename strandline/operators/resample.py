"""Resampling of array tiles between grids, as expressions over one tile, and counts of many tiles merged on one grid.

A grid is an affine map struct<a, b, c, d, e, f>: the corner of column i and row j lies at x = a i + b j + c,
y = d i + e j + f. Tiles are arrays by row; null elements are nodata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f), strict=True)])


def north_up(x0: Column, y0: Column, dx: Column, dy: Column) -> Column:
    """The grid with its upper left corner at (x0, y0), columns to the east and rows to the south."""
    return grid(dx, F.lit(0), x0, F.lit(0), -dy, y0)


def at(g: Column, i: Column, j: Column) -> tuple[Column, Column]:
    """Where a grid has the column i and row j, which may be fractions."""
    return g["a"] * i + g["b"] * j + g["c"], g["d"] * i + g["e"] * j + g["f"]


def back(g: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The column and row, in fractions, of a place."""
    u, v, det = x - g["c"], y - g["f"], g["a"] * g["e"] - g["b"] * g["d"]
    return (g["e"] * u - g["b"] * v) / det, (g["a"] * v - g["d"] * u) / det


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _place(src: Column, x: Column, y: Column) -> Column:
    u, v = back(src, x, y)
    return F.struct(u.alias("u"), v.alias("v"))


def _within(u: Column, v: Column, width: int, height: int) -> Column:
    return (u >= 0) & (v >= 0) & (u < width) & (v < height)


def _pixel(tile: Column, c: Column, r: Column, width: int, height: int) -> Column:
    """The element, null outside the tile."""
    inside = (c >= 0) & (r >= 0) & (c < width) & (r < height)
    return F.when(inside, F.get(tile, F.when(inside, r * width + c).cast("int")))


def _each(width: int, height: int, f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: f(k % width, F.floor(k / width)))


def nearest(tile: Column, size: tuple[int, int], src: Column, dst: Column, out: tuple[int, int]) -> Column:
    """array: for each cell of dst the pixel of src that holds its centre; null outside. Sizes are (width, height)."""
    def value(i: Column, j: Column) -> Column:
        return _let(_place(src, *at(dst, i + 0.5, j + 0.5)), lambda p: _pixel(tile, F.floor(p["u"]), F.floor(p["v"]), *size))

    return _each(*out, value)


def bilinear(tile: Column, size: tuple[int, int], src: Column, dst: Column, out: tuple[int, int]) -> Column:
    """array<double>: for each cell of dst the mean of the four pixels about its centre by nearness, over those that have data;
    null where the centre is outside the tile or none of them has."""
    def mean(p: Column) -> Column:
        u, v = p["u"], p["v"]
        c, r = F.floor(u - 0.5), F.floor(v - 0.5)
        near = []
        for di in (0, 1):
            for dj in (0, 1):
                w = (1 - F.abs(u - 0.5 - (c + di))) * (1 - F.abs(v - 0.5 - (r + dj)))
                near.append(F.struct(_pixel(tile, c + di, r + dj, *size).cast("double").alias("v"), w.alias("w")))
        known = F.filter(F.array(*near), lambda q: q["v"].isNotNull() & (q["w"] > 0))
        zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
        of = lambda s: F.when(s["w"] > 0, s["v"] / s["w"])
        add = lambda s, q: F.struct((s["v"] + q["v"] * q["w"]).alias("v"), (s["w"] + q["w"]).alias("w"))
        return F.when(_within(u, v, *size), F.aggregate(known, zero, add, of))

    return _each(*out, lambda i, j: _let(_place(src, *at(dst, i + 0.5, j + 0.5)), mean))


def _shares(tile: Column, size: tuple[int, int], src: Column, dst: Column, i: Column, j: Column) -> Column:
    """array<struct<v, w>>: the pixels with data that a cell of dst overlaps, with the share of each pixel inside it."""
    ends = F.struct(_place(src, *at(dst, i, j)).alias("p"), _place(src, *at(dst, i + 1, j + 1)).alias("q"))

    def spans(e: Column) -> Column:
        out = []
        for c, n in zip("uv", size, strict=True):
            p, q = e["p"][c], e["q"][c]
            out += [F.greatest(F.least(p, q), F.lit(0.0)).alias(f"{c}0"), F.least(F.greatest(p, q), F.lit(float(n))).alias(f"{c}1")]
        return F.struct(*out)

    def cells(s: Column) -> Column:
        pixels = lambda c: F.when(s[f"{c}1"] > s[f"{c}0"], F.sequence(F.floor(s[f"{c}0"]), F.ceil(s[f"{c}1"]) - 1)).otherwise(F.array().cast("array<bigint>"))
        part = lambda c, k: F.least(s[f"{c}1"], k + 1.0) - F.greatest(s[f"{c}0"], k.cast("double"))
        one = lambda c, r: F.struct(_pixel(tile, c, r, *size).cast("double").alias("v"), (part("u", c) * part("v", r)).alias("w"))
        return F.flatten(F.transform(pixels("v"), lambda r: F.transform(pixels("u"), lambda c: one(c, r))))

    return F.filter(_let(_let(ends, spans), cells), lambda p: p["v"].isNotNull() & (p["w"] > 0))


def by_area(tile: Column, size: tuple[int, int], src: Column, dst: Column, out: tuple[int, int]) -> Column:
    """array<struct<total, valid, mean, majority>>: for each cell of dst the sum of the pixels by the share of each inside it, how
    many pixels with data that is, their mean, and the value with the largest share (equal to nine places, the least).

    Both grids run along the same axes (b = d = 0). A cell without data has a total and valid of 0, and no mean or majority.
    """
    def scores(met: Column) -> Column:
        share = lambda v: F.aggregate(met, F.lit(0.0), lambda s, p: s + F.when(p["v"] == v, p["w"]).otherwise(0.0))
        ranked = F.transform(F.array_distinct(met["v"]), lambda v: F.struct(F.round(share(v), 9).alias("w"), (-v).alias("v")))
        zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
        sums = F.aggregate(met, zero, lambda s, p: F.struct((s["v"] + p["v"] * p["w"]).alias("v"), (s["w"] + p["w"]).alias("w")))
        mean = lambda s: F.struct(s["v"].alias("total"), s["w"].alias("valid"), F.when(s["w"] > 0, s["v"] / s["w"]).alias("mean"), (-F.array_max(ranked)["v"]).alias("majority"))
        return _let(sums, mean)

    return _each(*out, lambda i, j: _let(_shares(tile, size, src, dst, i, j), scores))


def footprint(src: Column, size: tuple[int, int]) -> Column:
    """struct<west, south, east, north> of a tile on its grid."""
    ends = [at(src, F.lit(i), F.lit(j)) for i in (0, size[0]) for j in (0, size[1])]
    xs, ys = [x for x, _ in ends], [y for _, y in ends]
    return F.struct(F.least(*xs).alias("west"), F.least(*ys).alias("south"), F.greatest(*xs).alias("east"), F.greatest(*ys).alias("north"))


def covering(box: Column, ref: Column) -> Column:
    """struct<col, row, width, height>: the cells of the north-up grid ``ref`` that cover a box, counted from its corner."""
    col, row = F.floor((box["west"] - ref["c"]) / ref["a"]), F.floor((box["north"] - ref["f"]) / ref["e"])
    width, height = F.ceil((box["east"] - ref["c"]) / ref["a"]) - col, F.ceil((box["south"] - ref["f"]) / ref["e"]) - row
    return F.struct(*[v.cast("long").alias(k) for k, v in dict(col=col, row=row, width=width, height=height).items()])


def union_grid(df: DataFrame, keys: list[str], box: str, ref: Column) -> DataFrame:
    """(keys, union): the cells of ``ref`` that cover all boxes of a key. ``ref`` is the same for all rows of a key."""
    b = F.struct(F.min(f"{box}.west").alias("west"), F.min(f"{box}.south").alias("south"), F.max(f"{box}.east").alias("east"), F.max(f"{box}.north").alias("north"))
    d = df.groupBy(*keys).agg(b.alias("_b"), F.any_value(ref).alias("_ref"))
    return d.select(*keys, covering(F.col("_b"), F.col("_ref")).alias("union"))


def merged(df: DataFrame, keys: list[str], tile: str, size: tuple[int, int], src: Column, ref: Column, value: int) -> DataFrame:
    """(keys, col, row, target, valid): for each cell of ``ref`` how many tiles show ``value`` there, and how many have data.

    A tile makes only the cells under its own footprint, by its nearest pixel, never the whole union; cells are added up
    before and after one shuffle.
    """
    d = df.select(*keys, F.col(tile).alias("_t"), src.alias("_s"), ref.alias("_r"))
    d = d.withColumn("_c", covering(footprint(F.col("_s"), size), F.col("_r")))
    c, s = F.col("_c"), F.col("_s")

    def cell(k: Column) -> Column:
        col, row = c["col"] + k % c["width"], c["row"] + F.floor(k / c["width"])
        v = _let(_place(s, *at(F.col("_r"), col + 0.5, row + 0.5)), lambda p: _pixel(F.col("_t"), F.floor(p["u"]), F.floor(p["v"]), *size))
        return F.struct(col.alias("col"), row.alias("row"), v.alias("v"))

    cells = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), c["width"] * c["height"] - 1), cell), lambda p: p["v"].isNotNull())
    flat = d.select(*keys, F.inline(cells))
    return flat.groupBy(*keys, "col", "row").agg(F.sum((F.col("v") == value).cast("long")).alias("target"), F.count(F.lit(1)).alias("valid"))
