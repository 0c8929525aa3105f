"""Projections: published places, round trips, meridian arcs by integration."""

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import geometry, projection


def test_known_place(spark):
    """43.642567 N, 79.387139 W is 630084 m east and 4833439 m north in zone 17, to the metre."""
    east, north = projection.utm(F.lit(-79.387139), F.lit(43.642567), F.lit(-81.0))
    r = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    assert abs(r.e - 630084) < 1 and abs(r.n - 4833439) < 1


def test_there_and_back(spark):
    at = spark.range(20_000).select((F.rand(1) * 360 - 180).alias("lon"), (F.rand(2) * 168 - 84).alias("lat"))
    at = at.withColumn("lon0", projection.central(projection.zone_of(F.col("lon"))).cast("double"))
    e, n = projection.utm(F.col("lon"), F.col("lat"), F.col("lon0"))
    lon, lat = projection.from_utm(F.col("e"), F.col("n"), F.col("lon0"))
    off = at.withColumns({"e": e, "n": n}).withColumns({"a": lon, "b": lat})
    metres = F.hypot((F.col("a") - F.col("lon")) * F.cos(F.radians("lat")), F.col("b") - F.col("lat")) * 111_320
    assert off.agg(F.max(metres)).first()[0] < 1e-5


def arc(lat):
    p = np.linspace(0, np.radians(lat), 200_001)
    m = projection.A * (1 - projection.E2) / (1 - projection.E2 * np.sin(p) ** 2) ** 1.5
    return float(((m[1:] + m[:-1]) / 2 * np.diff(p)).sum())


def test_meridian_and_parallel(spark):
    """On the central meridian north is the arc times the scale; on the sinusoidal map y is the arc and x the parallel's length."""
    for lat in (-71.5, 10.0, 48.25):
        n = projection.utm(F.lit(9.0), F.lit(lat), F.lit(9.0))[1]
        x, y = projection.sinusoidal(F.lit(2.0), F.lit(lat))
        r = spark.range(1).select(n.alias("n"), x.alias("x"), y.alias("y")).first()
        s = np.sin(np.radians(lat))
        assert abs(r.n - projection.SCALE * arc(lat)) < 1e-3 and abs(r.y - arc(lat)) < 1e-3
        assert abs(r.x - np.radians(2) * projection.A * np.cos(np.radians(lat)) / np.sqrt(1 - projection.E2 * s * s)) < 1e-6


def test_centroid(spark):
    ring = [(1e6, 5e6), (1e6 + 4, 5e6), (1e6 + 4, 5e6 + 1), (1e6 + 1, 5e6 + 1), (1e6 + 1, 5e6 + 3), (1e6, 5e6 + 3)]
    df = spark.createDataFrame([(ring,), ([(2.0, 2.0), (4.0, 4.0)],)], "r array<struct<x: double, y: double>>")
    got = [x.c for x in df.select(geometry.centroid(F.col("r")).alias("c")).collect()]
    want = ((4 * 2 + 2 * 0.5) / 6, (4 * 0.5 + 2 * 2) / 6)
    assert np.allclose((got[0].x - 1e6, got[0].y - 5e6), want) and (got[1].x, got[1].y) == (3.0, 3.0)


def test_small_file_is_many_tasks(spark):
    from strandline.plans import map_queries

    got = map_queries.circle_squares(spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
