"""Nearest places: only different places are compared, every row is joined to what its place found."""

from pyspark.sql import functions as F

from strandline.operators import joins


def sides(spark, n):
    a = spark.range(n).select(F.col("id").alias("a"), F.lit(0.5).alias("ax"), (F.col("id") % 2).cast("double").alias("ay"))
    b = spark.range(n).select(F.col("id").alias("b"), F.lit(0.5).alias("bx"), (F.col("id") % 2 * 3).cast("double").alias("by"))
    return a, b


def test_copies_of_a_place_are_compared_once(spark):
    a, b = sides(spark, 300)
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def apart(x, y):
        asked.add(1)
        return abs(x - y)

    near = joins.nearest_points(a, b, apart("ay", "by"), 4.0, ("ax", "ay"), ("bx", "by"), 1.5)
    got = near.groupBy("ay", "by", "distance").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a", "b").alias("pairs")).collect()
    assert {(r.ay, r.by, r.distance, r.n, r.pairs) for r in got} == {(0.0, 0.0, 0.0, 22500, 22500), (1.0, 0.0, 1.0, 22500, 22500)}
    assert 0 < asked.value <= 16  # four pairs of places


def test_rows_are_shuffled_by_place(spark):
    """Neither the rows nor what their places found is broadcast: the output is dealt over the places' partitions."""
    a, b = sides(spark, 300)
    near = joins.nearest_points(a, b, F.abs(F.col("ay") - F.col("by")), 4.0, ("ax", "ay"), ("bx", "by"), 1.5)
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan.splitlines()[1]
