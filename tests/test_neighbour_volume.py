"""What exact neighbours write for a row depends neither on the partitions of blocks nor on wider numbers than given."""

import numpy as np

from strandline.operators import joins
from strandline.storage import Scratch


def test_k_rows_for_a_row(spark, monkeypatch):
    r, n, wrote, write = np.random.default_rng(4), 400, [], Scratch.write
    df = spark.createDataFrame([(i, list(map(float, x)), float(i % 3)) for i, x in enumerate(r.normal(size=(n, 12)))], "i long, v array<float>, y double")

    def counted(self, df):
        out = write(self, df)
        wrote.append((out.count(), dict(out.dtypes)))
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joins.knn_mean(df, "i", "v", "y", 3, block=20).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(rows for rows, _ in wrote) <= 3 * n
    assert not any(types.get("v") == "array<double>" for _, types in wrote)
