"""Connected components by label propagation, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.storage import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the least node reachable over links (a, b); nodes without links are left out.

    Labels fall to the least neighbour's and then to their label's label, until no label changes. Null
    ends and loops don't count. The result is a table of ``scratch``.
    """
    edges = scratch.write(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    kind = dict(edges.dtypes)["a"]
    now = scratch.write(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")).withColumn("_old", F.lit(None).cast(kind)))
    while True:
        labels = now.select("node", "component")
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("component").alias("_near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("component").alias("_jump"))
        last, now = now, scratch.write(lower.join(jump, "_new", "left").select("node", F.coalesce(F.least("_new", "_jump"), "_new").alias("component"), "_old"))
        scratch.drop(last)
        if not now.where("_old <> component").limit(1).count():
            scratch.drop(edges)
            return now.select("node", "component")
