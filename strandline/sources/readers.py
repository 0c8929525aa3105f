"""Readers for label tables, gauge archives, GeoJSON, nested payloads and file catalogs."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "region int, source_tif string, label string, acquired timestamp_ntz, instrument string"
GAUGE = "station_nm string, datetime timestamp, value double, qualifier string, site_no string, parameter_cd string, year_month string"
_VALUE = "array<struct<value:string,dateTime:string,qualifiers:array<string>>>"
PAYLOAD = (
    "value struct<timeSeries:array<struct<"
    "sourceInfo:struct<siteName:string,siteCode:array<struct<value:string>>>,"
    "variable:struct<variableCode:array<struct<value:string>>,noDataValue:double>,"
    f"values:array<struct<value:{_VALUE}>>>>>"
)
GEOJSON = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
TASKS = "annotations array<struct<result:array<struct<value:struct<choices:array<string>>>>>>, data struct<meta:map<string,string>>"


def labels_csv(spark: SparkSession, path: str, schema: str = LABELS) -> DataFrame:
    """A label table with a declared schema; rows without a valid time are dropped later, not here."""
    return spark.read.schema(schema).option("header", True).csv(path)


def gauge_series(spark: SparkSession, root: str, site: str | None = None, parameter: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The partitioned gauge archive; site and parameter prune directories, times push down. Corrupt files are skipped."""
    df = spark.read.schema(GAUGE).option("basePath", root).option("ignoreCorruptFiles", True).parquet(root)
    if site is not None:
        df = df.where(F.col("site_no") == site)
    if parameter is not None:
        df = df.where(F.col("parameter_cd") == parameter)
    return between(df, "datetime", start, end)


def between(df: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    """Rows within inclusive bounds, either of which may be open."""
    kind = dict(df.dtypes)[ts]
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast(kind))
    return df


def gauge_rows(df: DataFrame, payload: str) -> DataFrame:
    """Tidy rows of gauge payloads in a JSON string column: one per reading.

    Series without values give nothing; a reading equal to its series' no-data value, or no number, is NaN.
    """
    doc = df.select(F.from_json(payload, PAYLOAD).alias("d"))
    s = doc.select(F.explode("d.value.timeSeries").alias("s"))
    r = s.select(
        F.get("s.sourceInfo.siteCode", F.lit(0))["value"].alias("site_no"),
        F.col("s.sourceInfo.siteName").alias("station_nm"),
        F.get("s.variable.variableCode", F.lit(0))["value"].alias("parameter_cd"),
        F.col("s.variable.noDataValue").alias("_none"),
        F.explode(F.get("s.values", F.lit(0))["value"]).alias("v"),
    )
    number = F.col("v.value").try_cast("double")
    at = F.col("v.dateTime").try_cast("timestamp")
    return r.select(
        "site_no", "station_nm", "parameter_cd", at.alias("datetime"),
        F.coalesce(F.when(~number.eqNullSafe(F.col("_none")), number), F.lit(float("nan"))).alias("value"),
        F.array_join("v.qualifiers", ",").alias("qualifier"),
        F.date_format(at, "yyyy-MM").alias("year_month"),
    ).where("datetime is not null")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature: properties, geometry type, coordinates as JSON, and the file's stem as key."""
    doc = spark.read.schema(GEOJSON).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return doc.select(stem.alias("stem"), F.explode("features").alias("f")).select("stem", "f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))


def first_choice(spark: SparkSession, path: str) -> DataFrame:
    """(region, source_tif, label): the first choice of the first annotation that has one."""
    t = spark.read.schema(TASKS).option("multiLine", True).json(path)
    results = F.filter(F.flatten(F.transform("annotations", lambda a: F.coalesce(a["result"], F.array()))), lambda r: F.size(r["value"]["choices"]) > 0)
    label = F.get(F.get(results, F.lit(0))["value"]["choices"], F.lit(0))
    return t.select(F.col("data.meta")["region"].alias("region"), F.col("data.meta")["source_tif"].alias("source_tif"), label.alias("label")).where("label is not null")


def catalog(spark: SparkSession, roots: list[str], pattern: str = "*_SR_clip.tif") -> DataFrame:
    """(path, region, acquired) of the files below the roots that match, each once; contents are not read."""
    from strandline.functions.timeparts import from_stem

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(roots)
    p = files.select("path").distinct()
    return p.select("path", F.element_at(F.split("path", "/"), -3).alias("region"), from_stem(F.col("path")).alias("acquired"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank ids: lines of a text file, or the column ``site_no`` (else the first) of a CSV file."""
    if path.endswith(".csv"):
        table = spark.read.option("header", True).csv(path)
        values = table.select(F.trim("site_no" if "site_no" in table.columns else table.columns[0]).alias("id"))
    else:
        values = spark.read.text(path).select(F.trim("value").alias("id"))
    return values.where("id <> ''").distinct()


def acquired(columns: list[str], path: str = "source_tif") -> Column:
    """The acquisition time: its own column where present and valid, else parsed from the path."""
    from strandline.functions.timeparts import from_stem

    own = F.col("acquired").cast("string").try_cast("timestamp_ntz")
    return F.coalesce(own, from_stem(F.col(path))) if "acquired" in columns else from_stem(F.col(path))


def with_acquired(df: DataFrame, path: str = "source_tif") -> tuple[DataFrame, int]:
    """df with a valid ``acquired``, and how many rows had none and were dropped."""
    timed = df.withColumn("acquired", acquired(df.columns, path))
    return timed.where("acquired is not null"), timed.where("acquired is null").count()


def profile(spark: SparkSession, path: str, keys: list[str]) -> Column:
    """map<string, string> literal of the given keys of a YAML file, which the driver reads as one small text."""
    import yaml

    found = yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) or {}
    kept = {k: str(v) for k, v in found.items() if k in keys}
    return F.create_map(*[F.lit(x) for pair in sorted(kept.items()) for x in pair]).cast("map<string,string>")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(stem, values): one flat array of doubles for each .npy file, named by the file's stem."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def flat(content: pd.Series) -> pd.Series:
        return content.map(lambda b: np.load(io.BytesIO(b), allow_pickle=False).astype(float).ravel())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\.npy$", 1).alias("stem"), flat("content").alias("values"))
