"""Columns from properties that are only known when the data is read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"`((?:[^`]|``)*)`|([^`<>,: ]+)"


def fields_of(schema: str) -> dict[str, str]:
    """Name -> type of the outermost fields of ``OBJECT<a: BIGINT, b: OBJECT<...>>``, as Spark describes a VARIANT."""
    out, at, end = {}, len("OBJECT<"), len(schema) - 1
    if not schema.startswith("OBJECT<"):
        return out
    while at < end:
        name = re.compile(_NAME).match(schema, at)
        start = name.end() + 2
        depth, at = 0, start
        while at < end and not (schema[at] == "," and depth == 0):
            depth += (schema[at] in "<(") - (schema[at] in ">)")
            at += 1
        out[name[1].replace("``", "`") if name[1] is not None else name[2]] = schema[start:at]
        at += 2
    return out


def _typed(props: Column, name: str, kind: str) -> Column:
    kind = "string" if re.match(r"OBJECT|ARRAY|VARIANT|VOID", kind) else kind
    if "'" not in name and "\\" not in name:
        return F.try_variant_get(props, f"$['{name}']", kind)
    # A path can't hold these; such names are looked up in a map of the fields.
    return F.try_variant_get(F.try_element_at(props.cast("map<string,variant>"), F.lit(name)), "$", kind)


def flattened(df: DataFrame, json: str, prefix: str = "") -> DataFrame:
    """df without ``json``, with a typed column for each property that any row has, in order of name.

    Types are the narrowest that hold all of a property's values: whole numbers and decimals meet in a
    decimal, other mixtures and nested values become their JSON text. Rows without a property, and
    texts that aren't JSON objects, have null. The names come from one aggregate over all rows, whose
    result is one string.
    """
    v = F.try_parse_json(json)
    d = df.withColumn("_v", F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))
    schema = d.where("_v is not null").agg(F.schema_of_variant_agg("_v")).first()[0] or ""
    found = fields_of(schema)
    clash = {c.lower() for c in df.columns if c != json} & {(prefix + n).lower() for n in found}
    if clash:
        raise ValueError(f"properties named like columns: {sorted(clash)}; give a prefix")
    return d.select(*[c for c in df.columns if c != json], *[_typed(F.col("_v"), n, found[n]).alias(prefix + n) for n in sorted(found)])
