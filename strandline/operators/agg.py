"""Aggregations: filled counts, shares, pivots, histograms, robust spread, data-driven column choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import finite, missing
from strandline.storage import materialise


def monthly_counts(df: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, month, n) for every month from a key's first to its last, zero where nothing was."""
    counts = df.groupBy(key, F.to_date(F.date_trunc("month", ts)).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy(key).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    every = span.select(key, F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias("month"))
    return every.join(counts, [key, "month"], "left").select(key, "month", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def filled_counts(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Counts for every member of the dimension, zero for those without rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return dimension.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shares(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n, share): each label's share of its key's rows; null labels don't count."""
    counts = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): N / (classes * n)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def histogram(df: DataFrame, key: str, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(key, bin, cnt) over equal bins; the last one is closed on the right, values outside don't count."""
    v = df.select(key, value.alias("_v")).where(F.col("_v").between(low, high))
    b = F.least(F.lit(bins - 1), F.floor((F.col("_v") - low) / ((high - low) / bins))).cast("int")
    return v.groupBy(key, b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def histogram_moments(hist: DataFrame, key: str, low: float, high: float, bins: int) -> DataFrame:
    """Mean and population standard deviation of each key from the bins' centres."""
    x = F.lit(low) + (F.col("bin") + 0.5) * ((high - low) / bins)
    s = hist.groupBy(key).agg(F.sum("cnt").alias("_n"), F.sum(x * F.col("cnt")).alias("_s"), F.sum(x * x * F.col("cnt")).alias("_q"))
    mean = F.col("_s") / F.col("_n")
    return s.select(key, mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean)).alias("std"))


def histogram_floor(hist: DataFrame, key: str, least: int) -> DataFrame:
    """Counts divided by the key's smallest positive count, or ``least`` if larger, and floored."""
    unit = F.greatest(F.lit(least), F.min(F.when(F.col("cnt") > 0, F.col("cnt"))).over(Window.partitionBy(key)))
    return hist.withColumn("cnt", F.floor(F.col("cnt") / unit))


def shuffles(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def ranked(df: DataFrame, keys: list[str], order: list[Column], slices: int | None = None) -> DataFrame:
    """df with ``rank`` (from 1) and ``total`` (rows) within its keys, by ascending order, which should be total.

    Rows are dealt to ranges of keys and order and written once; ranks within a range are lifted by the
    ranges before it, so a key that holds most rows is still many tasks.
    """
    k, o = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))]
    named = [F.col(x).alias(n) for x, n in zip(keys, k, strict=True)] + [x.alias(n) for x, n in zip(order, o, strict=True)]
    dealt = materialise(df.select(F.struct(*df.columns).alias("row"), *named).repartitionByRange(slices or shuffles(df), *k, *o).withColumn("part", F.spark_partition_id()))
    per = dealt.groupBy(*k, "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range, and one more for each key
    w = Window.partitionBy(*k)
    lifts = per.select(*k, "part", (F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(w).alias("total"))
    numbered = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("part", *k).orderBy(*o)))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["part", *k]])
    return numbered.alias("a").join(lifts.alias("b"), same).select("a.row.*", (F.col("b.before") + F.col("a.inside")).alias("rank"), F.col("b.total").alias("total"))


def quantiles(df: DataFrame, key: str, value: str, q: list[float], accuracy: int = 10_000) -> DataFrame:
    """(key, q0, q1, ...): exact quantiles, linear between neighbours; null and NaN values don't count.

    A sketch of each key, merged map-side, brackets every quantile; the second pass counts what is below
    a bracket and takes only the values inside, about 5/accuracy of a key's rows. The sketch errs by no
    more than 1/accuracy of the rows, less than half of the bracket. Keys of up to ``accuracy`` rows take
    all their values.
    """
    v = df.select(F.col(key).alias("k"), missing(F.col(value).cast("double")).alias("v")).where("v is not null")
    margin = 2.5 / accuracy
    levels = F.array(*[F.lit(min(1.0, max(0.0, x + m))) for x in q for m in (-margin, margin)])
    sketch = v.groupBy("k").agg(F.percentile_approx("v", levels, accuracy).alias("b"), F.count(F.lit(1)).alias("total"))
    whole = F.col("total") <= accuracy
    ends = [F.struct(F.lit(i).alias("i"), F.when(whole, float("-inf")).otherwise(F.get("b", F.lit(2 * i))).alias("low"), F.when(whole, float("inf")).otherwise(F.get("b", F.lit(2 * i + 1))).alias("high")) for i in range(len(q))]
    brackets = sketch.select(F.col("k").alias("bk"), "total", F.array(*ends).alias("ends"))
    near = v.join(brackets, F.col("k").eqNullSafe(F.col("bk")))
    each = near.select("k", "total", "v", F.explode(F.filter("ends", lambda e: F.col("v") <= e["high"])).alias("e"))
    inside = F.col("v") >= F.col("e.low")
    # One row for what is below a bracket, with null for its value, and one for each value inside.
    counts = each.groupBy("k", "total", F.col("e.i").alias("i"), F.when(inside, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(Window.partitionBy("k", "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    upto = counts.withColumn("run", run)
    level = F.get(F.array(*map(F.lit, q)), F.col("i"))
    at = level * (F.col("total") - 1)
    covers = lambda p: F.max(F.when((F.col("run") - F.col("n") <= p) & (p < F.col("run")), F.col("v")))
    low, high, part = covers(F.floor(at)), covers(F.ceil(at)), F.max(at - F.floor(at))
    found = upto.groupBy("k", "i").agg((low + (high - low) * part).alias("x"))
    return found.groupBy("k").agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"q{i}") for i in range(len(q))]).withColumnRenamed("k", key)


def mad_sigma(df: DataFrame, key: str, value: str) -> DataFrame:
    """1.4826 times the median absolute deviation from the median; null and NaN values don't count."""
    med = quantiles(df, key, value, [0.5]).select(F.col(key).alias("_k"), F.col("q0").alias("_m"))
    apart = df.join(med, F.col(key).eqNullSafe(F.col("_k"))).select(key, F.abs(F.col(value) - F.col("_m")).alias("_d"))
    return quantiles(apart, key, "_d", [0.5]).select(key, (1.4826 * F.col("q0")).alias("sigma"))


def usable_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric) of the metrics that are finite in every row of a key and not constant, in one pass over the long form."""
    long = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "v")
    long = long.withColumn("v", F.when(finite(F.col("v")), F.col("v")))
    seen = long.groupBy(*keys, "metric").agg(F.count("v").alias("_n"), F.count(F.lit(1)).alias("_all"), F.min("v").alias("_a"), F.max("v").alias("_b"))
    return seen.where("_n = _all and _a < _b").select(*keys, "metric")


def z_score(value: str) -> Column:
    """(x - mean) / population standard deviation over all rows, given one-row means joined as _mean and _std."""
    return (F.col(value) - F.col("_mean")) / F.col("_std")


def with_moments(df: DataFrame, value: str) -> DataFrame:
    """Columns _mean and _std of the whole column, from an aggregate of one row rather than an unpartitioned window."""
    return df.crossJoin(F.broadcast(df.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))))
