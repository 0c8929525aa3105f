"""Nearest neighbours on whole vectors against brute force."""

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import joins
from strandline.plans import more_queries
from strandline.storage import Scratch

SF = "/root/testdata/sf0.001"


def by_hand(ids, v, y, k):
    want = {}
    for q in range(len(ids)):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        near = sorted((d[m], ids[m], y[m]) for m in range(len(ids)) if m != q)[:k]
        same = [n[2] for n in near if n[0] == 0]
        w = [1 / n[0] for n in near if n[0] > 0]
        want[ids[q]] = (np.mean(same) if same else sum(a * n[2] for a, n in zip(w, near, strict=True)) / sum(w), len(near))
    return want


def same(df, want):
    got = {r.vec_id: (r.mean, r.found) for r in df.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i][0] - want[i][0]) < 2e-6 and got[i][1] == want[i][1] for i in want)


def test_every_row_has_its_nearest(spark):
    r = np.random.default_rng(2)
    v = np.concatenate([r.normal(size=(90, 7)), np.full((12, 7), 0.5), [[50.0] * 7]])
    ids, y = list(range(len(v))), list(map(float, r.integers(0, 9, len(v))))
    df = spark.createDataFrame([(i, list(map(float, x)), z) for i, x, z in zip(ids, v, y, strict=True)], "vec_id long, embedding array<double>, label double")
    want = by_hand(ids, v, y, 5)
    same(joins.knn_mean(df, "vec_id", "embedding", "label", 5, block=20), want)
    same(joins.knn_mean(df, "vec_id", "embedding", "label", 5), want)
    assert {r.found for r in joins.knn_mean(df.limit(3), "vec_id", "embedding", "label", 5).collect()} == {2}


def test_knn_regression_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    same(more_queries.knn_regression(spark, SF), by_hand([r.vec_id for r in rows], np.array([r.embedding for r in rows], float), [r.label for r in rows], 5))


def test_cells_rule_out_most_pairs(spark):
    """Clustered rows: every row is compared with a small part of the others, and a third of equal rows is in several blocks."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16)) * 20
    v = np.concatenate([c + r.normal(size=(50, 16)) * 0.2 for c in centres] + [np.full((1000, 16), 3.0)])
    df = spark.createDataFrame([(i, list(map(float, x)), float(i % 5)) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label double")
    cells, rows = joins.knn_index(df, "vec_id", "embedding", "label", 5, 200, Scratch(spark))
    got = cells.compared(cells.asks(rows, F.col("reach"))).first()
    assert got.pairs < 0.45 * len(v) ** 2
    spread = cells.compared(cells.asks(rows.where("id < 2000"), F.col("reach"))).first()
    assert spread.pairs < 0.15 * 2000 * len(v)
    assert cells.rows.groupBy("blk").count().agg(F.max("count")).first()[0] < 400
    same(joins.knn_mean(df.where("vec_id % 3 = 0"), "vec_id", "embedding", "label", 5, block=100), by_hand(list(range(0, len(v), 3)), v[::3], np.arange(len(v))[::3] % 5.0, 5))
