"""Writers: partitioned archives, GeoJSON, incremental appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gauge_archive(df: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """Parquet by site, parameter and month; rows of a directory are brought together first."""
    keys = ["site_no", "parameter_cd", "year_month"]
    df.repartition(*keys).write.mode(mode).partitionBy(*keys).parquet(root)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def missing_only(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not stored yet: what an incremental write appends."""
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")


def feature_lines(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """One GeoJSON feature a row as text, newline-delimited so that writing stays distributed."""
    props = [c for c in df.columns if c not in (lon, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry"))).alias("value"))


def feature_collection(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """One row with a whole FeatureCollection as text, for small tables that other tools read as one document."""
    features = feature_lines(df, lon, lat).agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("_f"))
    return features.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "_f", F.lit("]}")).alias("value"))


def site_metadata(df: DataFrame, path: str, columns: list[str]) -> None:
    """The distinct combinations of the columns as JSON lines."""
    df.select(*columns).distinct().write.mode("overwrite").json(path)


def task_lines(df: DataFrame, path: str, image: str, meta: list[str]) -> None:
    """One labelling task a line: {"data": {"image": ..., "meta": {...}}}."""
    df.select(F.to_json(F.struct(F.struct(F.col(image).alias("image"), F.struct(*meta).alias("meta")).alias("data"))).alias("value")).write.mode("overwrite").text(path)


def per_key_csv(df: DataFrame, path: str, keys: list[str]) -> None:
    """CSV files in a directory for each combination of the keys; rows of a directory are brought together first."""
    df.repartition(*keys).write.mode("overwrite").option("header", True).partitionBy(*keys).csv(path)
