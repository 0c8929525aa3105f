"""Hand-worked cases of the ordered operators."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandline.functions.timeparts import DAY_US, HOUR_US, date_chunks, from_stem, to_utc
from strandline.operators import events, joins, series

H = HOUR_US


def frame(spark, hours, p, name="p"):
    return spark.createDataFrame([(1, int(h * H), None if v is None else float(v)) for h, v in zip(hours, p)], f"site int, us long, {name} double")


def states(df):
    return [r.state for r in df.orderBy("us").collect()]


T = [0, 24, 48, 72, 96, 120, 144, 168, 192, 216, 400, 424]
P = [0.1, 0.8, 0.2, 0.8, 0.9, 0.5, 0.2, 0.8, 0.1, 0.2, 0.75, 0.2]


def test_hysteresis_by_hand(spark):
    got = states(series.hysteresis(frame(spark, T, P), "p", 0.7, 0.3, 2, 96 * H))
    assert got == [0, 0, 0, 1, 1, 1, 1, 1, 0, 0, 1, 0]
    assert states(series.hysteresis(frame(spark, [0, 24, 200], [0.1, 0.8, 0.9]), "p", 0.7, 0.3, 2, 96 * H)) == [0, 0, 1]
    assert states(series.hysteresis(frame(spark, [0], [None]), "p", 0.7, 0.3, 2, 96 * H)) == [0]


def stepwise(t, p, high, low, run, gap):
    out = []
    for i in range(len(p)):
        if i == 0 or t[i] - t[i - 1] > gap:
            out.append(int(p[i] is not None and p[i] >= high))
            continue
        j = range(i, min(i + run, len(p)))
        whole = all(p[k] is not None for k in j) and all(t[k] - t[k - 1] <= gap for k in j if k > i)
        if whole and all(p[k] >= high for k in j):
            out.append(1)
        elif whole and all(p[k] <= low for k in j):
            out.append(0)
        else:
            out.append(out[-1])
    return out


def test_hysteresis_matches_step_by_step(spark):
    rng = random.Random(4)
    for run in (1, 2, 3):
        t = np.cumsum([rng.choice([10, 30, 60, 120]) for _ in range(120)]).tolist()
        p = [rng.choice([None, 0.1, 0.2, 0.5, 0.8, 0.9]) for _ in t]
        assert states(series.hysteresis(frame(spark, t, p), "p", 0.7, 0.3, run, 96 * H)) == stepwise(t, p, 0.7, 0.3, run, 96)


def test_change_events_and_midpoints(spark):
    s = series.hysteresis(frame(spark, T, P), "p", 0.7, 0.3, 2, 96 * H)
    at = lambda m: [(r.event_us / H, r.new_state) for r in series.change_events(s, "state", 96 * H, midpoint=m).orderBy("event_us").collect()]
    assert at("anchor") == [(72, 1), (192, 0), (296, 1), (424, 0)]
    assert at("previous") == [(72, 1), (192, 0), (308, 1), (424, 0)]


def test_state_change_rows(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([0, 0, 1, 1, 0])], "site int, us long, s int")
    rows = lambda first: [r.us for r in series.state_changes(df, "s", include_first=first).orderBy("us").collect()]
    assert rows(True) == [0, 2, 4] and rows(False) == [2, 4]


def test_matching(spark):
    day = DAY_US
    gt = spark.createDataFrame([(1, 10 * day, 1), (1, 12 * day, 1), (2, 5 * day, 1)], "site int, event_us long, new_state int")
    pr = spark.createDataFrame([(1, 8 * day, 1), (1, int(11.5 * day), 1), (2, 5 * day, 0)], "site int, event_us long, new_state int")
    g = {r.site: r for r in events.match_events(gt, pr, 2 * day).collect()}
    assert (g[1].tp, g[1].fp, g[1].fn, g[1].mae_days) == (1, 1, 1, 1.5) and (g[2].tp, g[2].mae_days) == (0, None)
    o = {r.site: r for r in events.match_events(gt, pr, 2 * day, optimal=True).collect()}
    assert (o[1].tp, o[1].fp, o[1].fn) == (2, 0, 0)


def test_optimal_matching_is_no_worse():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = np.sort(rng.integers(0, 50, rng.integers(0, 7))), np.sort(rng.integers(0, 50, rng.integers(0, 7)))
        assert events.match_optimal(a, b, 5)[0] >= events.match_greedy(a, b, 5)[0]


def test_smoothing(spark):
    g = frame(spark, [0, 24, 76, 128], [0, 1, 0.5, 0.9]).withColumn("s", series.smooth_guarded("p", 2)).orderBy("us").collect()
    assert [r.s for r in g] == [0, 0.5, 0.5, 0.9]
    c = frame(spark, [24 * i for i in range(5)], [1, 2, 4, 8, 16]).withColumn("s", series.smooth_centred("p", 2)).orderBy("us").collect()
    assert [r.s for r in c] == [1.5, 3, 6, 12, 16]


def test_longest_segment(spark):
    df = frame(spark, [0, 3, 6, *range(20, 221, 4)], [0.0] * 54)
    got = [r.us // H for r in series.longest_segment(df, 4 * H, 7 * DAY_US).orderBy("us").collect()]
    assert got == [20, 24, 28, 32, 36, 40, 44, 48]
    assert series.longest_segment(frame(spark, [0, 10, 20], [0, 0, 0]), 4 * H, 0).count() == 0


def test_gaps(spark):
    d = DAY_US
    df = frame(spark, [0, 24, 144, 168], [0] * 4)
    got = sorted((r.gap_start / d, r.gap_end / d) for r in series.gaps(df, int(4.5 * d), 12 * H, -5 * d, 12 * d).collect())
    assert got == [(-5, -0.5), (1.5, 5.5), (7.5, 12)]
    assert [(r.gap_start / d, r.gap_end / d) for r in series.gaps(df, int(2.5 * d), 6 * H, share=10).collect()] == [(1.25, 5.75)]


def test_nearest_in_time_takes_the_earlier(spark):
    left = spark.createDataFrame([(1, 2)], "k int, t long")
    right = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c")], "k int, u long, v string")
    assert joins.asof_nearest(left, right, "t", "u", ["v"], "k").first().v == "a"


def test_band_is_closed(spark):
    a = spark.createDataFrame([(1, 0)], "site int, a long")
    b = spark.createDataFrame([(1, 14 * H), (1, 14 * H + 1)], "site int, b long")
    assert joins.band_join(a, b, "site", "a", "b", 14 * H).count() == 1
    assert joins.band_join(a, b, "site", "a", "b", 14 * H, closed=False).count() == 0


def test_times(spark):
    one = spark.range(1)
    assert [tuple(map(str, c)) for c in one.select(date_chunks("2017-01-01", "2017-03-31", 45)).first()[0]] == [("2017-01-01", "2017-02-14"), ("2017-02-15", "2017-03-31")]
    assert str(one.select(from_stem(F.lit("a/20230901_182511_53_2486_3B_x.tif"))).first()[0]) == "2023-09-01 18:25:11"
    assert one.select(from_stem(F.lit("bad.tif"))).first()[0] is None
    clock = F.lit("2022-02-01 10:00:00").cast("timestamp_ntz")
    assert [str(one.select(to_utc(clock, F.lit(z))).first()[0])[11:13] for z in ("PST", "PDT", "UTC", "?")] == ["18", "17", "10", "10"]
