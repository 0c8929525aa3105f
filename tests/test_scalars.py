"""Scalar expressions on values that the smallest tables lack."""

import base64

from pyspark.sql import functions as F

from strandline.functions import scalars


def test_base64_is_one_line(spark):
    texts = ["", "a" * 57, "a" * 58, "é" * 100, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.base64_line(F.col("t")).alias("b")).collect()
    assert [r.b for r in got] == [t if t is None else base64.b64encode(t.encode()).decode() for t in texts]
