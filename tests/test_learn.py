"""Clusters, ranks, quantiles and splits against plain Python; missing scores in metrics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import agg, learn, metrics


def by_hand(points, eps, least):
    near = {i: [j for j, q in points.items() if math.dist(p, q) <= eps] for i, p in points.items()}
    core = {i for i in near if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in label:
                    label[j] = i
                    todo += [k for k in near[j] if k in core]
    for i in points:
        if i not in core:
            label[i] = min((label[j] for j in near[i] if j in core), default=-1)
    return label


@pytest.mark.parametrize("block", [7, 4096])
def test_dbscan(spark, block):
    r = random.Random(1)
    points = {i: [r.gauss(c, 0.4) for c in (i % 3 * 3, 0, i % 2)] for i in range(120)} | {200 + i: [9.0, 9.0, 9.0] for i in range(40)} | {300: [20.0, 0.0, 0.0]}
    df = spark.createDataFrame([*points.items(), (400, None)], "i long, v array<double>")
    got = {x.i: x.cluster for x in learn.dbscan(df, "i", "v", 0.5, 4, block).collect()}
    assert got == by_hand(points, 0.5, 4) | {400: -1}
    flat = spark.createDataFrame([(i, [x]) for i, x in enumerate([0.0, 0.1, 0.2, 5.0, 5.1, 5.2, 9.0])], "i long, v array<double>")
    assert {x.i: x.cluster for x in learn.dbscan(flat, "i", "v", 0.15, 2).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: -1}
    assert learn.dbscan(flat.limit(0), "i", "v", 0.1, 2).count() == 0


def test_ranks_and_quantiles(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, float("nan"), 1.0, r.random(), r.random()])) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, k string, v double")
    seen = {}
    for x in agg.ranked(df, ["k"], [F.col("i") % 7, F.col("i")], 16).collect():
        seen.setdefault(x.k, []).append((x["rank"], x.i, x.total))
    for k, got in seen.items():
        want = sorted((i for i, kk, _ in rows if kk == k), key=lambda i: (i % 7, i))
        assert [i for _, i, _ in sorted(got)] == want and all(t == len(want) for *_, t in got)
    for accuracy in (10_000, 100, 40):
        got = agg.quantiles(df, "k", "v", [0.0, 0.3, 0.5, 1.0], accuracy).collect()
        assert {x.k for x in got} == {"a", "b", None}
        for x in got:
            values = [v for _, k, v in rows if k == x.k and v is not None and not math.isnan(v)]
            assert np.allclose([x.q0, x.q1, x.q2, x.q3], np.quantile(values, [0, 0.3, 0.5, 1]))


def test_missing_scores_count_nowhere(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 0), (float("nan"), 1), (None, 0), (float("nan"), 0)]
    df = spark.createDataFrame(rows, "p double, y int")
    known = df.where("p is not null and not isnan(p)")
    for f in (metrics.threshold_sweep, metrics.pr_curve, metrics.auroc, metrics.average_precision, metrics.calibration_error):
        assert sorted(f(df, "p", "y").collect()) == sorted(f(known, "p", "y").collect())
    assert metrics.auroc(df, "p", "y").first()[0] == 0.75
    assert abs(metrics.average_precision(df, "p", "y").first()[0] - (1 / 1 + 2 / 3) / 2) < 1e-12
    assert metrics.auroc(df.limit(0), "p", "y").first()[0] is None


def test_balanced_split(spark):
    df = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(2000)] + [(5000, None)], "i long, y int")
    got = learn.balanced_split(df, "i", "y").collect()
    pos, neg = [x for x in got if x.y == 1], [x for x in got if x.y == 0]
    assert (len(pos), len(neg)) == (40, 400) and sum(x.train for x in pos) == 30 and sum(x.train for x in neg) == 300
    assert abs(sum(x.weight for x in pos) / sum(x.weight for x in got) - 40 / 2000) < 1e-9


def test_clusters_of_inliers_and_forest(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(i % 2 * 5, 0.3), 0.0], i % 2, i % 10 == 0 if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, v array<double>, y int, far boolean")
    got = learn.clusters_of_inliers(df, "v", "far", 2).collect()
    assert all((x.cluster == -1) == (x.far is not False) for x in got) and len({(x.y, x.cluster) for x in got if x.cluster >= 0}) == 2
    assert all((x.prob > 0.5) == (x.y == 1) for x in learn.forest(df.withColumn("y", F.col("y").cast("double")), "v", "y").collect())
    sweep = learn.cluster_sweep(df, "v", range(2, 4)).collect()
    assert [x.k for x in sweep] == [2, 3] and sweep[0].cost >= sweep[1].cost and sum(sweep[0].sizes) == 200


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "a array<double>")
    got = df.select(scalars.unit(F.col("a")), scalars.softmax(F.col("a")), scalars.argmax(F.col("a"))).collect()
    assert np.allclose(got[0][0], [0.6, 0.8]) and np.allclose(got[0][1], [1 / (1 + math.e), math.e / (1 + math.e)]) and [g[2] for g in got] == [1, 0]
