"""Timestamps: parsing, zones, microsecond keys and cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
#: Hours to add to a clock reading of the zone to get UTC; others count as UTC: fixed values.
ZONE_HOURS = {"PST": 8, "PDT": 7}


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zoneless timestamp in UTC: the key of range frames."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def first_format(text: Column, *formats: str) -> Column:
    """The first format that parses the text, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def to_utc(ts: Column, zone: Column) -> Column:
    hours = F.lit(0)
    for code, h in ZONE_HOURS.items():
        hours = F.when(zone == code, h).otherwise(hours)
    return from_micros(micros(ts) + hours * F.lit(HOUR_US))


def from_stem(path: Column) -> Column:
    """The timestamp that opens a file's name, ``yyyyMMdd_HHmmss_...``; null where there is none."""
    stem = F.element_at(F.split(path, "/"), -1)
    return first_format(F.array_join(F.slice(F.split(stem, "_"), 1, 2), "_"), "yyyyMMdd_HHmmss")


def cyclic(ts: Column) -> list[Column]:
    """Sine and cosine of the ISO week over 52 and of the hour over 24."""
    week, hour = 2 * math.pi * F.weekofyear(ts) / 52, 2 * math.pi * F.hour(ts) / 24
    return [F.sin(week).alias("week_sin"), F.cos(week).alias("week_cos"), F.sin(hour).alias("hour_sin"), F.cos(hour).alias("hour_cos")]


def date_chunks(start: Column | str, end: Column | str, days: int) -> Column:
    """Array of inclusive, gapless (first, last) date ranges of at most ``days`` days."""
    firsts = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {days} days"))
    return F.transform(firsts, lambda d: F.struct(d.alias("first"), F.least(F.date_add(d, days - 1), F.lit(end).cast("date")).alias("last")))
