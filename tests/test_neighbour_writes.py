"""What exact neighbours write doesn't grow with the pairs of blocks that are compared."""

import numpy as np
import pytest

from strandline.operators import joins, learn
from strandline.storage import Scratch


@pytest.mark.parametrize("query", [lambda df: joins.knn_mean(df, "i", "v", "y", 3, block=20), lambda df: learn.dbscan(df, "i", "v", 2.0, 3, block=20)])
def test_rows_written(spark, monkeypatch, query):
    """Evenly spread vectors in some twenty blocks, where nearly every row asks all of them."""
    r, n, wrote, write = np.random.default_rng(4), 400, [], Scratch.write
    df = spark.createDataFrame([(i, list(map(float, x)), float(i % 3)) for i, x in enumerate(r.normal(size=(n, 12)))], "i long, v array<double>, y double")

    def counted(self, df):
        out = write(self, df)
        wrote.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    query(df).collect()
    assert max(wrote) <= 10 * n
