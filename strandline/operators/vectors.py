"""Vector aggregates and prototypes on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import dot, unit


def mean_vector(df: DataFrame, key: str, vector: str, name: str = "mean") -> DataFrame:
    """(key, name): the elementwise mean of each key's vectors as array<double>."""
    long = df.select(key, F.posexplode(vector).alias("_pos", "_v"))
    means = long.groupBy(key, "_pos").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_m"))), lambda x: x["_m"])
    return means.groupBy(key).agg(ordered.alias(name))


def cosine_to(df: DataFrame, prototypes: DataFrame, key: str, vector: str, proto: str, name: str = "cosine") -> DataFrame:
    """Each row with the cosine of its vector to its key's prototype; lengths count with 1e-8 added."""
    return df.join(prototypes, key).withColumn(name, dot(unit(F.col(vector)), unit(F.col(proto)))).drop(proto)


def trimmed_prototypes(df: DataFrame, key: str, row: str, vector: str, trim: float, rounds: int = 2, digits: int = 9) -> DataFrame:
    """(key, proto, kept): mean of the unit vectors left after ``rounds`` of keeping the best (1-trim) share by cosine.

    Equal cosines (to ``digits`` digits) keep the smaller row id.
    """
    live = df.select(key, row, unit(F.col(vector)).alias("_u"))
    for _ in range(rounds):
        scored = cosine_to(live, mean_vector(live, key, "_u", "_p"), key, "_u", "_p", "_c")
        w = Window.partitionBy(key)
        keep = F.ceil((1 - trim) * F.count(F.lit(1)).over(w) - 1e-9)
        ranked = scored.withColumns({"_n": F.row_number().over(w.orderBy(F.desc(F.round("_c", digits)), row)), "_k": keep})
        live = ranked.where("_n <= _k").select(key, row, "_u")
    return mean_vector(live, key, "_u", "proto").join(live.groupBy(key).agg(F.count(F.lit(1)).alias("kept")), key)


def composite(p: Column, cosine: Column, cut: Column, alpha: float, beta: float, gamma: float) -> Column:
    return alpha * p + beta * cosine + gamma * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine - cut)))


def cluster_quality(df: DataFrame, label: str, vector: str) -> DataFrame:
    """One row: Calinski-Harabasz and Davies-Bouldin indices of labelled vectors."""
    v = df.select(F.col(label).alias("_l"), F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    cents = mean_vector(v, "_l", "_v", "_c")
    whole = mean_vector(v.withColumn("_a", F.lit(0)), "_a", "_v", "_g").select("_g")
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    near = v.join(cents, "_l").withColumn("_d", apart(F.col("_v"), F.col("_c")))
    per = near.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"), F.sum("_d").alias("_w"), F.avg(F.sqrt("_d")).alias("_s"), F.first("_c").alias("_c"))
    # Clusters are few: their pairs are laid side by side.
    per = per.crossJoin(F.broadcast(whole)).withColumn("_b", F.col("_n") * apart(F.col("_c"), F.col("_g")))
    other = per.select(F.col("_l").alias("_l2"), F.col("_s").alias("_s2"), F.col("_c").alias("_c2"))
    ratio = (F.col("_s") + F.col("_s2")) / F.sqrt(apart(F.col("_c"), F.col("_c2")))
    worst = per.join(F.broadcast(other), F.col("_l") != F.col("_l2")).groupBy("_l").agg(F.max(ratio).alias("_r"))
    db = worst.agg(F.avg("_r").alias("davies_bouldin"))
    ch = per.agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_k"), F.sum("_w").alias("_w"), F.sum("_b").alias("_b"))
    ch = ch.select(((F.col("_b") / (F.col("_k") - 1)) / (F.col("_w") / (F.col("_n") - F.col("_k")))).alias("calinski_harabasz"))
    return ch.crossJoin(F.broadcast(db))
