"""How the provided tables stand in for observations; shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.timeparts import micros

#: The same base in SQL.
E = """with e as (
  select user_id as site, ts, epoch_us(ts) as us, event_id, event_type, value, props,
         least(value / 100.0, 1.0) as p, case when event_type in ('purchase', 'signup') then 1 else 0 end as y
  from events where user_id is not null)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, ts, us, event_id, event_type, value, props, p (probability), y (truth)."""
    return table(spark, sf_dir, "events").where("user_id is not null").select(
        F.col("user_id").alias("site"), "ts", micros(F.col("ts")).alias("us"), "event_id", "event_type", "value", "props",
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("p"), F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("y"),
    )
