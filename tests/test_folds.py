"""Stratified group folds against a plain greedy deal; the table function on columns of other types."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import tables
from strandline.operators import learn


def greedy(counts, k):
    """Every group by itself, in the order of the spread of its counts."""
    total = counts.sum(0)
    folds, out = np.zeros((k, counts.shape[1])), []
    for v in sorted(map(tuple, counts), key=lambda v: (-np.std(v), tuple(-x for x in v))):
        def spread(f):
            trial = folds.copy()
            trial[f] += v
            return (trial / total).std(0).mean()
        scores = [spread(f) for f in range(k)]
        best = [f for f in range(k) if np.isclose(scores[f], min(scores), rtol=1e-9, atol=1e-15)]
        f = min(best, key=lambda f: (folds[f].sum(), f))
        folds[f] += v
        out.append((v, f))
    return folds, sorted(out)


def test_folds_equal_greedy(spark):
    r = random.Random(8)
    rows = [(g, r.choice("aab")) for g in range(60) for _ in range(r.choice([1, 2, 3]))] + [(g, c) for g in range(100, 300) for c in "ab"]
    rows += [(900, "a")] * 300 + [(901, "b")] * 120 + [(None, "a"), (5, None)]
    df = spark.createDataFrame(rows, "g int, y string")
    got = {x.g: x.fold for x in learn.stratified_group_folds(df, "g", "y", 4).collect()}
    groups = sorted({g for g, y in rows if g is not None and y})
    counts = {g: [sum(1 for a, y in rows if a == g and y == c) for c in "ab"] for g in groups}
    folds, want = greedy(np.array([counts[g] for g in groups]), 4)
    assert got.keys() == set(groups) and sorted((tuple(counts[g]), f) for g, f in got.items()) == want
    dealt = {x.g: x.fold for x in learn.group_folds(df.where("y is not null"), "g", "y", 4).collect()}
    shares = lambda deal: (np.array([[sum(counts[g][c] for g in groups if deal[g] == f) for c in (0, 1)] for f in range(4)]) / folds.sum(0)).std(0).mean()
    assert shares(got) <= shares(dealt)
    assert learn.stratified_group_folds(df.limit(0), "g", "y", 4).count() == 0


def test_table_function(spark):
    tables.register(spark)
    rows = [(1, "x", 2.0, None, True), (1, None, float("nan"), None, False), (1, "z", 4.0, 7, None), (2, "q", None, None, None), (None, "n", 1.0, 1, True)]
    spark.createDataFrame(rows, "k int, s string, a double, b long, c boolean").createOrReplaceTempView("mixed")
    got = {r.k: r for r in spark.sql("select * from column_statistics(TABLE(mixed) PARTITION BY k, key => 'k')").collect()}
    assert got[1].a_n == 2 and got[1].a_mean == 3.0 and got[1].a_std == 1.0 and (got[1].b_n, got[1].b_most) == (1, 7.0) and got[1].c_mean == 0.5
    assert got[2].a_n == 0 and got[2].a_mean is None and got[None].b_mean == 1.0 and not hasattr(got[1], "s_n")
