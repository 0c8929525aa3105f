"""Scene statistics of small tiles in long form: one row for each scene, band and pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels(df: DataFrame, scene: str, data: str, bands: int, side: int) -> DataFrame:
    """(scene, y, x, b0..): the tile's bands beside each other, from a flat array in band, row, column order."""
    size = side * side
    at = df.select(scene, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_p"), data)
    cols = [F.get(data, F.col("_p") + b * size).cast("double").alias(f"b{b}") for b in range(bands)]
    return at.select(scene, F.floor(F.col("_p") / side).cast("int").alias("y"), (F.col("_p") % side).alias("x"), *cols)


def scene_stats(px: DataFrame, scene: str) -> DataFrame:
    """Brightness, texture and spectral statistics of scenes with bands b0, b1, b2 (visible) and b3 (infrared).

    Borders of the Laplacian are mirrored without repeating the edge.
    """
    vis = (F.col("b0") + F.col("b1") + F.col("b2")) / 3
    spread = F.sqrt((F.pow(F.col("b0") - vis, 2) + F.pow(F.col("b1") - vis, 2) + F.pow(F.col("b2") - vis, 2)) / 3)
    # Dealt by scene once: windows over its rows and columns need no other partitioning.
    p = px.repartition(scene).withColumns({"_vis": vis, "_sd": spread})
    row, col = Window.partitionBy(scene, "y").orderBy("x"), Window.partitionBy(scene, "x").orderBy("y")
    step = lambda w: F.coalesce(F.lag("_vis").over(w), F.lead("_vis").over(w)) + F.coalesce(F.lead("_vis").over(w), F.lag("_vis").over(w))
    p = p.withColumn("_lap", step(row) + step(col) - 4 * F.col("_vis"))
    over = Window.partitionBy(scene)
    p = p.withColumns({"_m": F.avg("_vis").over(over), "_s": F.stddev_pop("_vis").over(over), "_t": F.avg("_sd").over(over)})
    share = lambda c: F.avg(c.cast("int"))
    bands = [f(F.col(f"b{b}")).alias(f"tif_{n}_{b + 1}") for n, f in (("mean", F.avg), ("std", F.stddev_pop)) for b in range(4)]
    return p.groupBy(scene).agg(
        *bands,
        F.percentile("_vis", F.lit(0.9)).alias("p90_vis"),
        F.percentile("_vis", F.lit(0.95)).alias("p95_vis"),
        share(F.col("_vis") > F.col("_m") + F.col("_s")).alias("bright_frac"),
        share(F.col("_sd") < 0.5 * F.col("_t")).alias("low_tex_frac"),
        (F.avg("b3") / (F.avg("_vis") + 1e-6)).alias("nir_ratio"),
        F.avg("_vis").alias("mean_brightness"),
        F.stddev_pop("_vis").alias("std_texture"),
        F.var_pop("_lap").alias("lap_var"),
        ((F.corr("b0", "b1") + F.corr("b2", "b1")) / 2).alias("spec_consistency"),
    )


def contrast_stretch(px: DataFrame, scene: str, band: str, low: float | None = 0.02, high: float = 0.98, valid: Column | None = None, eps: float = 0.0) -> DataFrame:
    """The band between its scene's two percentiles, mapped to 0..1 and clipped.

    Only ``valid`` pixels make the percentiles; without ``low`` the range starts at 0. ``eps`` is added to its width.
    """
    v = F.col(band) if valid is None else F.when(valid, F.col(band))
    cuts = px.groupBy(scene).agg((F.lit(0.0) if low is None else F.percentile(v, F.lit(low))).alias("_a"), F.percentile(v, F.lit(high)).alias("_b"))
    v = F.try_divide(F.col(band) - F.col("_a"), F.col("_b") - F.col("_a") + eps)
    return px.join(cuts, scene).select(scene, "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias("stretched"))


def sharpness(px: DataFrame, scene: str, band: str) -> DataFrame:
    """(scene, gradient, sharpness, noise) of one band: mean gradient by central differences, variance of the
    Laplacian, and 1.4826 times the median absolute residual from the mean of the four neighbours; mirrored borders."""
    row, col = Window.partitionBy(scene, "y").orderBy("x"), Window.partitionBy(scene, "x").orderBy("y")
    v = F.col(band)
    lag = lambda w: F.coalesce(F.lag(band).over(w), F.lead(band).over(w))
    lead = lambda w: F.coalesce(F.lead(band).over(w), F.lag(band).over(w))
    p = px.repartition(scene).withColumns({"_gx": (lead(row) - lag(row)) / 2, "_gy": (lead(col) - lag(col)) / 2, "_four": lag(row) + lead(row) + lag(col) + lead(col)})
    return p.groupBy(scene).agg(
        F.round(F.avg(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))), 6).alias("gradient"),
        F.round(F.var_pop(F.col("_four") - 4 * v), 6).alias("sharpness"),
        F.round(1.4826 * F.median(F.abs(v - F.col("_four") / 4)), 6).alias("noise"),
    )
