"""Joins that Spark has no operator for: bands, nearest in time, nearest in space, precedence."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import ordered
from strandline.operators.metric import Cells, Nearest, least
from strandline.storage import Scratch


def band_join(left: DataFrame, right: DataFrame, key: str, l_us: str, r_us: str, tolerance_us: int, closed: bool = True) -> DataFrame:
    """Pairs with equal key and times at most (or, open, less than) the tolerance apart.

    The right side is put into time buckets as wide as the tolerance and the left side looks into its
    own and both neighbours, so the join is an equi-join whose key also holds the time.
    """
    t = max(1, tolerance_us)
    near = left.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col(l_us) / t) + k)))
    apart = F.abs(F.col(l_us) - F.col(r_us))
    within = apart <= tolerance_us if closed else apart < tolerance_us
    return near.join(right.withColumn("_bucket", F.floor(F.col(r_us) / t)), [key, "_bucket"]).where(within).drop("_bucket")


def asof_nearest(left: DataFrame, right: DataFrame, l_us: str, r_us: str, values: list[str], key: str, tolerance_us: int | None = None, width_us: int = ordered.WIDTH_US) -> DataFrame:
    """Every left row with ``values`` and time of the right row nearest in time, the earlier of two as near.

    Both sides are stacked and carried along in slices of a time range, so no pairs are formed and a key
    that holds most rows is many tasks. Of right rows at the same time, the one with the least values is taken.
    """
    carried = F.struct(F.col(r_us).alias("_at"), *values)
    kind = right.select(carried.alias("_r")).schema["_r"].dataType
    keys = [key]
    a = left.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(l_us).alias("_us"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(kind).alias("_r"))
    one = right.groupBy(*keys, r_us).agg(F.min(carried).alias("_r"))
    b = one.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(r_us).alias("_us"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("_l")).schema["_l"].dataType).alias("_l"), "_r")
    both = ordered.sliced(a.unionByName(b), "_us", width_us)
    both = ordered.running_last(both, f"_k_{key}", "_r", "_before", "_us", width_us)
    out = ordered.running_last(both, f"_k_{key}", "_r", "_after", "_us", width_us, backwards=True).where("_l is not null")
    d1, d2 = F.col("_us") - F.col("_before._at"), F.col("_after._at") - F.col("_us")
    pick = F.when(F.col("_after").isNull() | (d1 <= d2), F.col("_before")).otherwise(F.col("_after"))
    out = out.withColumn("_pick", pick)
    if tolerance_us is not None:
        out = out.withColumn("_pick", F.when(F.abs(F.col("_us") - F.col("_pick._at")) <= tolerance_us, F.col("_pick")))
    return out.select("_l.*", F.col("_pick._at").alias(r_us), *[F.col(f"_pick.{v}").alias(v) for v in values])


def nearest_points(left: DataFrame, right: DataFrame, distance: Column, cell: float, l_xy: tuple[str, str], r_xy: tuple[str, str], most: float) -> DataFrame:
    """All right points nearest to each left point (ties kept) within ``most``, by a grid of cells of at least that width.

    ``distance`` is an expression of both sides' coordinates in their unit or larger; null leaves a pair out. Only different
    places are compared; then every row is joined to what its place found, so points at one place cost their own rows.
    """
    around = F.explode(F.expr("flatten(transform(array(-1,0,1), i -> transform(array(-1,0,1), j -> struct(i as i, j as j))))"))
    a = left.select(*l_xy).distinct().withColumn("_o", around)
    a = a.withColumns({"_cx": F.floor(F.col(l_xy[0]) / cell) + F.col("_o.i"), "_cy": F.floor(F.col(l_xy[1]) / cell) + F.col("_o.j")}).drop("_o")
    b = right.select(*r_xy).distinct().withColumns({"_cx": F.floor(F.col(r_xy[0]) / cell), "_cy": F.floor(F.col(r_xy[1]) / cell)})
    met = a.join(b, ["_cx", "_cy"]).withColumn("distance", distance).where(F.col("distance") <= most)
    near = met.withColumn("_rank", F.rank().over(Window.partitionBy(*l_xy).orderBy("distance"))).where("_rank = 1").drop("_rank", "_cx", "_cy")
    # Both sides by place: a broadcast left would leave all output to the few tasks of the places.
    return left.join(near.join(right, list(r_xy)).hint("merge"), list(l_xy))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ``order``, of plain columns or their ascending expressions, should be total. Tasks take the least
    rows of their own before any are shuffled."""
    least = F.min_by(F.struct(*df.columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(least.alias("_row")).select("_row.*")


def with_precedence(frames: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Union by name in which earlier frames win; ``source_rank`` tells which one a row came from."""
    tagged = [f.withColumn("source_rank", F.lit(k)) for k, f in enumerate(frames)]
    both = tagged[0]
    for f in tagged[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    return first_by(both, keys, [F.col("source_rank"), *order])


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, cell: float) -> DataFrame:
    """Pairs of points and polygons (array<struct<x, y>>, not closed) that hold them, by ray casting.

    Polygons are laid out over the grid cells of their bounding box, so the join is on the cell.
    """
    ends = {f"_{f}{c}": getattr(F, f"array_{f}")(F.transform(ring, lambda v: v[c])) for c in "xy" for f in ("min", "max")}  # noqa: B023
    span = lambda c: F.sequence(F.floor(F.col(f"_min{c}") / cell), F.floor(F.col(f"_max{c}") / cell))
    g = polygons.withColumns(ends).withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))
    p = points.withColumns({"_px": F.col(x).cast("double"), "_py": F.col(y).cast("double")}).withColumns({"_cx": F.floor(F.col("_px") / cell), "_cy": F.floor(F.col("_py") / cell)})
    n = F.size(ring)

    def crosses(v: Column, i: Column) -> Column:
        w = F.get(ring, (i + 1) % n)
        spans = (v["y"] > F.col("_py")) != (w["y"] > F.col("_py"))
        return F.when(spans & (F.col("_px") < (w["x"] - v["x"]) * (F.col("_py") - v["y"]) / F.when(w["y"] != v["y"], w["y"] - v["y"]) + v["x"]), 1).otherwise(0)

    odd = F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1
    return p.join(g, ["_cx", "_cy"]).where(odd).drop("_cx", "_cy", "_px", "_py", *ends)


def first_existing(df: DataFrame, candidates: list[Column], files: DataFrame, path: str) -> DataFrame:
    """df with the first of its candidate paths that the catalog holds; rows without any are dropped."""
    names = [f"_c{k}" for k in range(len(candidates))]
    out = df.withColumns(dict(zip(names, candidates, strict=True)))
    known = files.select(path).distinct()
    for n in names:
        out = out.join(known.withColumnRenamed(path, f"{n}_found"), F.col(n) == F.col(f"{n}_found"), "left")
    return out.withColumn(path, F.coalesce(*[f"{n}_found" for n in names])).where(F.col(path).isNotNull()).drop(*names, *[f"{n}_found" for n in names])


def knn_index(df: DataFrame, key: str, vector: str, value: str, k: int, block: int, scratch: Scratch) -> tuple[Cells, DataFrame]:
    """The cells of the rows (id, v, y), and the rows with ``reach``, a distance that their k nearest other rows are within."""
    # Floats stay floats where rows are written and shuffled, which halves them; as doubles they are the same numbers.
    v = F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.transform(vector, lambda x: x.cast("double"))
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), v.alias("v"), F.col(value).cast("double").alias("y"))
    cells = Cells(rows, scratch, block)
    bound = cells.within(k + 1)

    def reach(b: pd.DataFrame) -> pd.DataFrame:
        """From the cells' counts, and from the row's own block where that holds k others."""
        far, ids, v = bound(b.v), b.id.to_numpy(), np.stack(b.v.to_numpy()).astype(float)
        for q, d, _ in least(v, v, k, ids, ids):
            if len(d) == k:
                far[q] = min(far[q], d[-1])
        return b.assign(reach=far)

    kind, vectors = (dict(rows.dtypes)[c] for c in ("id", "v"))
    return cells, scratch.write(cells.rows.groupBy("blk").applyInPandas(reach, f"id {kind}, v {vectors}, y double, blk bigint, reach double"))


def knn_mean(df: DataFrame, key: str, vector: str, value: str, k: int, block: int = 4096) -> DataFrame:
    """(key, mean, found): for each row the inverse-distance mean of the value of its k nearest other rows by whole vector.

    Exact, without a radius: equal distances go by the least key, and neighbours at distance 0 count alone.
    ``key`` identifies a row. Each row asks only the blocks of pivot cells that the triangle inequality
    doesn't rule out; blocks are read, not shuffled, and a call returns k rows for each row and partition
    of blocks. How much is ruled out depends on the vectors: clustered ones ask few cells, evenly spread ones of many elements nearly all.
    Rows without a vector are left out.
    """
    scratch = Scratch(df.sparkSession)
    cells, rows = knn_index(df, key, vector, value, k, block, scratch)

    def found(state: Nearest, a: SimpleNamespace) -> tuple:
        own = np.repeat(a.id, [len(x) for x in state.found])
        flat = [x for f in state.found for x in f]
        return own, *([x[c] for x in flat] for c in range(3))

    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, d double, other {kind}, y double"
    met = cells.meet(rows.select("id", "v", "blk", "reach"), cells.rows, F.col("reach"), lambda a: Nearest(a, k), Nearest.add, found, schema)
    near = met.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))).where(F.col("_n") <= k)
    same, w = F.when(F.col("d") == 0, 1), F.when(F.col("d") > 0, 1 / F.col("d"))
    mean = F.when(F.count(same) > 0, F.avg(F.when(F.col("d") == 0, F.col("y")))).otherwise(F.sum(w * F.col("y")) / F.sum(w))
    out = scratch.write(near.groupBy(F.col("id").alias(key)).agg(F.round(mean, 6).alias("mean"), F.count(F.lit(1)).alias("found")))
    scratch.clear(but=out)
    return out
