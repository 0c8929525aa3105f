"""Image filters, dynamic properties and balanced scores against plain numpy and Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import filters, metrics
from strandline.sources import properties

RNG = np.random.default_rng(4)


def by_hand(tile, ky, kx):
    h, w = tile.shape
    py, px = len(ky) // 2, len(kx) // 2
    big = np.pad(tile, ((py, py), (px, px)), mode="reflect")
    return sum(a * b * big[i : i + h, j : j + w] for i, a in enumerate(ky) for j, b in enumerate(kx))


@pytest.mark.parametrize("h,w", [(8, 8), (5, 9), (3, 4)])
def test_convolution(spark, h, w):
    tiles = RNG.normal(size=(6, h, w))
    df = spark.createDataFrame([(i, t.ravel().tolist()) for i, t in enumerate(tiles)], "id int, t array<double>")
    for ky, kx in ((filters.SMOOTH, filters.SLOPE), (filters.gaussian(5, 1.0), filters.gaussian(3, 0.8)), ((1.0,), filters.SECOND)):
        for r in filters.convolved(df, "t", "c", h, w, ky, kx).collect():
            assert np.allclose(np.reshape(r.c, (h, w)), by_hand(tiles[r.id], ky, kx))
    for r in filters.quality_scores(df, "t", h, w).collect():
        t, g = tiles[r.id], filters.gaussian(5, 1.0)
        blur = by_hand(t, g, g)
        lap = by_hand(blur, (1.0,), filters.SECOND) + by_hand(blur, filters.SECOND, (1.0,))
        mad = lambda x: 1.4826 * np.median(np.abs(x - np.median(x)))
        slope = np.hypot(by_hand(t, filters.SMOOTH, filters.SLOPE), by_hand(t, filters.SLOPE, filters.SMOOTH))
        assert np.allclose([r.sharpness, r.noise, r.gradient, r.spread], [lap.var(), mad(t - blur), slope.mean(), mad(t)])


def test_null_pixels(spark):
    df = spark.createDataFrame([([1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0],)], "t array<double>")
    assert filters.convolved(df, "t", "c", 3, 3, (1.0,), filters.SECOND).first().c[:3] == [None, None, None]


def test_properties(spark):
    rows = ['{"a": 1, "b c": "x", "n": {"z": [1]}}', '{"a": 2.5, "t": true, "u": null}', "not json", None, "[1]", '{"a": 3, "n": 4, "it\'s": 1}', "{}"]
    got = properties.flattened(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, j string"), "j", "p_").orderBy("id").collect()
    assert got[0].__fields__ == ["id", "p_a", "p_b c", "p_it's", "p_n", "p_t", "p_u"]
    assert [None if r.p_a is None else float(r.p_a) for r in got] == [1, 2.5, None, None, None, 3, None]
    assert json.loads(got[0].p_n) == {"z": [1]} and got[5].p_n == "4" and got[1].p_t is True and got[5]["p_it's"] == 1
    assert properties.flattened(spark.createDataFrame([(1, "x")], "id int, j string"), "j").columns == ["id"]
    with pytest.raises(ValueError):
        properties.flattened(spark.createDataFrame([(1, '{"ID": 2}')], "id int, j string"), "j")


def test_fields():
    assert properties.fields_of("OBJECT<a: BIGINT, `b, c`: ARRAY<OBJECT<d: DECIMAL(3,1), e: STRING>>, `f``g`: OBJECT<>>") == {"a": "BIGINT", "b, c": "ARRAY<OBJECT<d: DECIMAL(3,1), e: STRING>>", "f`g": "OBJECT<>"}
    assert properties.fields_of("VOID") == {} == properties.fields_of("OBJECT<>")


def test_scores(spark):
    rng = random.Random(8)
    rows = [(rng.choice("xy"), rng.choice(["a", "b", "c", None]), rng.choice(["a", "b", "d", None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, t string, p string")
    for keys, pick in (([], lambda g: True), (["g"], lambda g: g == "x")):
        known = [(t, p) for g, t, p in rows if t and p and pick(g)]
        recall = {c: np.mean([p == c for t, p in known if t == c]) for c in "abc"}
        said = {c: [t == c for t, p in known if p == c] for c in "abcd"}
        pr = {c: np.mean(v) if v else 0 for c, v in said.items()}
        rc = recall | {"d": 0}
        f1 = {c: 2 * pr[c] * rc[c] / (pr[c] + rc[c]) if pr[c] + rc[c] else 0 for c in "abcd"}
        counts = metrics.class_counts(df, "t", "p", keys)
        m = metrics.macro(counts, keys).where("g = 'x'" if keys else "true").first()
        assert np.allclose([m.macro_precision, m.macro_recall, m.macro_f1, m.balanced_accuracy], [np.mean(list(pr.values())), np.mean(list(rc.values())), np.mean(list(f1.values())), np.mean(list(recall.values()))])
        b = metrics.balanced_accuracy(counts, keys).where("g = 'x'" if keys else "true").first()
        assert np.isclose(b.balanced_accuracy, m.balanced_accuracy) and b.n == len(known) and b.classes == 3
    assert metrics.macro(metrics.class_counts(df.limit(0), "t", "p")).first().macro_f1 is None
    assert df.where(F.col("t").isNull()).count() > 0
