"""Registry of the analytic queries: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        REGISTRY[name] = (f, sql)
        return f

    return put


def _load() -> None:
    """Import the modules that register queries."""
    from strandline.plans import catalog_queries, event_queries, image_queries, map_queries, more_queries, series_queries, table_queries, value_queries  # noqa: F401


_load()
