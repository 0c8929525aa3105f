"""Sliced scans: the width of a slice changes nothing, and a hot key is many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.timeparts import DAY_US, HOUR_US
from strandline.operators import joins, ordered, series

rng = random.Random(11)
WHOLE = 10**6 * DAY_US
H = HOUR_US


@pytest.fixture(scope="module")
def rows(spark):
    """Site 1 holds most rows; site 2 has few, far apart, from before 1970 on; site 3 one; a null site is one too. p has gaps and NaN."""
    made = []
    for site, n, step, start in ((1, 700, 5 * H, 0), (2, 60, 400 * H, -9000 * H), (3, 1, H, 0), (None, 40, 30 * H, 77)):
        t = start
        for _ in range(n):
            t += rng.randrange(1, 2 * step)
            made.append((site, t, rng.choice([None, float("nan"), *[round(rng.random(), 2) for _ in range(8)]]), rng.choice("aab"), {"k": t}))
    return spark.createDataFrame(made, "site int, us long, p double, s string, extra map<string,long>").cache()


def same(make, rows, widths=(2 * H, 3 * DAY_US, 40 * DAY_US)):
    norm = lambda df: sorted(str([None if x is None else x for x in r]) for r in df.select(*[c for c in df.columns if c != "extra"]).collect())
    want = norm(make(rows, WHOLE))
    for w in widths:
        assert norm(make(rows, w)) == want, w
    return want


@pytest.mark.parametrize("run", [1, 2, 4])
def test_hysteresis(rows, run):
    same(lambda df, w: series.hysteresis(df, "p", 0.6, 0.4, run, 60 * H, width_us=w), rows)


def test_changes(rows):
    for mid in ("anchor", "previous"):
        same(lambda df, w, m=mid: series.change_events(df, "s", 6 * H, midpoint=m, width_us=w), rows)
    same(lambda df, w: series.change_deltas(df, "s", width_us=w), rows)
    same(lambda df, w: series.state_changes(df, "s", include_first=False, width_us=w), rows)
    same(lambda df, w: series.deltas(df, width_us=w), rows)


def test_segments_and_gaps(rows):
    same(lambda df, w: series.segments(df, 7 * H, width_us=w), rows)
    same(lambda df, w: series.longest_segment(df, 9 * H, 20 * H, width_us=w), rows)
    same(lambda df, w: series.gaps(df, 8 * H, H, 0, 5000 * H, width_us=w), rows)
    assert series.segments(rows, 7 * H, width_us=DAY_US).select("extra").first().extra  # columns that can't be ordered go along


def test_smoothing_equals_whole_windows(rows):
    """Against the window over the whole series; sums may differ in their last bits."""
    for w in (HOUR_US, 3 * DAY_US):
        for sliced, whole in (
            (series.smoothed_guarded(rows, "p", "x", 2, width_us=w), rows.withColumn("x", series.smooth_guarded("p", 2))),
            (series.smoothed_centred(rows, "p", "x", 3, width_us=w), rows.withColumn("x", series.smooth_centred("p", 3))),
        ):
            get = lambda df: {(r.site, r.us): r.x for r in df.select("site", "us", F.round("x", 10).alias("x")).collect()}
            assert get(sliced) == get(whole)


def test_asof(rows):
    right = rows.where("s = 'b'").select("site", F.col("us").alias("at"), F.col("p").alias("q")).union(rows.where("us % 3 = 0").select("site", "us", F.lit(5.0)))
    left = rows.withColumn("t", F.col("us") + 3 * H)
    for most in (None, 9 * H):
        same(lambda df, w, m=most: joins.asof_nearest(df, right, "t", "at", ["q"], "site", m, w), left)


def test_brute_force_nearest(rows):
    right = rows.where("s = 'b' and site is not null").select("site", F.col("us").alias("at"))
    times = {}
    for r in right.collect():
        times.setdefault(r.site, []).append(r["at"])
    for r in joins.asof_nearest(rows.where("site is not null"), right, "us", "at", [], "site", width_us=2 * DAY_US).collect():
        want = min(times.get(r.site, [None]), key=lambda x: (abs(x - r.us), x) if x is not None else 0)
        assert r["at"] == want


def test_empty(rows):
    none = rows.limit(0)
    assert series.hysteresis(none, "p", 0.6, 0.4, 2, H).count() == 0 == series.segments(none, H).count() == joins.asof_nearest(none, none.withColumnRenamed("us", "at"), "us", "at", [], "site").count()


def test_hot_site_is_many_tasks(spark):
    """A site with a third of all rows: no partition of any shuffle of rows holds much of it."""
    hot = spark.range(20_000).select(F.lit(1).alias("site"), (F.col("id") * H).alias("us"), (F.col("id") % 7 / 7).alias("p"))
    rest = spark.range(40_000).select((F.col("id") % 400 + 2).cast("int").alias("site"), (F.col("id") * H).alias("us"), F.lit(0.5).alias("p"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = hot.union(rest)
        right = df.select("site", F.col("us").alias("at"))
        for out in (
            series.hysteresis(df, "p", 0.6, 0.4, 2, 5 * H), series.segments(df, 5 * H), series.deltas(df), series.smoothed_guarded(df, "p", "x"), joins.asof_nearest(df, right, "us", "at", [], "site"),
        ):
            assert out.groupBy(F.spark_partition_id().alias("k")).agg(F.sum((F.col("site") == 1).cast("int")).alias("n"), F.max(out.columns[-1]).alias("m")).agg(F.max("n"), F.max("m")).first()[0] < 2500
        # What is ordered over a whole key is a few rows a slice.
        ends = ordered._ends(ordered.sliced(df), "site", "us", 3, True)
        assert ends.where("site = 1").count() <= 20_000 * H // ordered.WIDTH_US + 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
