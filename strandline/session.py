"""Session settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "strandline", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, skew joins and Arrow; ``conf`` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(name)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
