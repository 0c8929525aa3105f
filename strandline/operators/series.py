"""Ordered analytics over irregular series: gaps, segments, changes, smoothing and hysteresis.

Every function takes a frame with a key, a microsecond column ``us`` and what it works on, and reads it
in slices of a time range (``ordered``), so a key that holds most rows is as many tasks as it has slices.
``width_us`` is a slice's width; it has no influence on results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import missing
from strandline.functions.timeparts import DAY_US, HOUR_US
from strandline.operators import ordered
from strandline.operators.ordered import WIDTH_US, over


def by(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*(order or ("us",)))


def delta(key: str = "site") -> Column:
    """Microseconds since the series' previous sample."""
    return F.col("us") - F.lag("us").over(by(key))


def with_previous(df: DataFrame, columns: dict[str, str], key: str = "site", width_us: int = WIDTH_US) -> DataFrame:
    """Sliced own rows with the given columns of the row before, by new name; null in a series' first row."""
    d = ordered.with_halo(ordered.sliced(df, width_us=width_us), key, before=1)
    return ordered.own(d.withColumns({name: F.lag(c).over(over(key, "us")) for name, c in columns.items()}))


def deltas(df: DataFrame, key: str = "site", width_us: int = WIDTH_US) -> DataFrame:
    """df with ``delta_us``, microseconds since the series' previous sample."""
    return with_previous(df, {"delta_us": "us"}, key, width_us).withColumn("delta_us", F.col("us") - F.col("delta_us")).drop("_own", "_slice")


def state_changes(df: DataFrame, state: str, key: str = "site", include_first: bool = True, width_us: int = WIDTH_US) -> DataFrame:
    """Rows whose state differs from the one before; the first row counts if asked for."""
    first = F.col("_us").isNull()
    wanted = (first & F.lit(include_first)) | (~first & ~F.col(state).eqNullSafe(F.col("_before")))
    return with_previous(df, {"_before": state, "_us": "us"}, key, width_us).where(wanted).drop("_before", "_us", "_own", "_slice")


def segments(df: DataFrame, gap_us: int, key: str = "site", width_us: int = WIDTH_US) -> DataFrame:
    """Column ``segment``: 0, 1, ... with a new one after every gap of more than gap_us."""
    d = with_previous(df, {"_us": "us"}, key, width_us)
    d = d.withColumn("_gap", F.coalesce((F.col("us") - F.col("_us") > gap_us).cast("long"), F.lit(0).cast("long")))
    d = ordered.running_sum(d, key, "_gap", "segment", width_us=width_us)
    return d.drop("_gap", "_us", "_own", "_slice")


def longest_segment(df: DataFrame, gap_us: int, drop_us: int, key: str = "site", width_us: int = WIDTH_US) -> DataFrame:
    """Rows of each key's longest segment (the earliest of equals), without its last ``drop_us``.

    A key whose segments are all single samples gives nothing.
    """
    cut = segments(df, gap_us, key, width_us)
    spans = cut.groupBy(key, "segment").agg(F.min("us").alias("_a"), F.max("us").alias("_b")).where("_b > _a")
    best = spans.groupBy(key).agg(F.max_by(F.struct("segment", "_b"), F.struct(F.col("_b") - F.col("_a"), -F.col("segment"))).alias("_s"))
    best = best.select(key, F.col("_s.segment").alias("segment"), F.col("_s._b").alias("_b"))
    return cut.join(best, [key, "segment"]).where(F.col("us") < F.col("_b") - drop_us).drop("_b")


def gaps(df: DataFrame, min_gap_us: int, buffer_us: int, start_us: int | None = None, end_us: int | None = None, key: str = "site", share: int | None = None, width_us: int = WIDTH_US) -> DataFrame:
    """(key, gap_start, gap_end) in microseconds: stretches without samples longer than min_gap_us.

    Inner gaps are shrunk by the buffer on both sides, or by 1/share of the gap if that is less; with
    bounds, the stretches before the first and after the last sample count too and keep their outer end.
    """
    pad = F.lit(buffer_us) if share is None else F.least(F.lit(buffer_us), F.expr(f"(us - _before) div {share}"))
    inner = with_previous(df.select(key, "us"), {"_before": "us"}, key, width_us).where(F.col("us") - F.col("_before") > min_gap_us)
    out = inner.select(key, (F.col("_before") + pad).alias("gap_start"), (F.col("us") - pad).alias("gap_end"))
    if start_us is None and end_us is None:
        return out
    ends = df.groupBy(key).agg(F.min("us").alias("_a"), F.max("us").alias("_b"))
    if start_us is not None:
        out = out.unionByName(ends.where(F.col("_a") - start_us > min_gap_us).select(key, F.lit(start_us).cast("long").alias("gap_start"), (F.col("_a") - buffer_us).alias("gap_end")))
    if end_us is not None:
        out = out.unionByName(ends.where(F.lit(end_us) - F.col("_b") > min_gap_us).select(key, (F.col("_b") + buffer_us).alias("gap_start"), F.lit(end_us).cast("long").alias("gap_end")))
    return out


def smooth_guarded(value: str, days: int = 2, key: str = "site") -> Column:
    """As an expression over a whole series in one task, for short ones: the mean over the open window of 24*days+4 hours to both sides if it holds an earlier sample, else the value.

    Missing values, null or NaN, don't count in a mean.
    """
    half = (24 * days + 4) * HOUR_US - 1
    w = by(key)
    earlier = F.count(F.lit(1)).over(w.rangeBetween(-half, -1))
    v = missing(F.col(value).cast("double"))
    return F.when(earlier > 0, F.avg(v).over(w.rangeBetween(-half, half))).otherwise(v)


def smooth_centred(value: str, days: int, key: str = "site") -> Column:
    """As an expression over a whole series in one task, for short ones: the mean over (t - days/2, t + days/2]; missing values, null or NaN, don't count."""
    half = days * DAY_US // 2
    return F.avg(missing(F.col(value).cast("double"))).over(by(key).rangeBetween(-half + 1, half))


def smoothed_guarded(df: DataFrame, value: str, into: str, days: int = 2, key: str = "site", width_us: int = WIDTH_US) -> DataFrame:
    """Mean over the open window of 24*days+4 hours to both sides if it holds an earlier sample, else the value.

    Missing values, null or NaN, don't count in a mean.
    """
    half = (24 * days + 4) * HOUR_US - 1
    d = ordered.around(df.withColumn("_v", missing(F.col(value).cast("double"))), half, half, width_us=width_us)
    w = over(key, "us")
    earlier = F.count(F.lit(1)).over(w.rangeBetween(-half, -1))
    smooth = F.when(earlier > 0, F.avg("_v").over(w.rangeBetween(-half, half))).otherwise(F.col("_v"))
    return ordered.done(d.withColumn(into, smooth)).drop("_v")


def smoothed_centred(df: DataFrame, value: str, into: str, days: int, key: str = "site", width_us: int = WIDTH_US) -> DataFrame:
    """Mean over (t - days/2, t + days/2]; missing values, null or NaN, don't count."""
    half = days * DAY_US // 2
    d = ordered.around(df.withColumn("_v", missing(F.col(value).cast("double"))), half - 1, half, width_us=width_us)
    return ordered.done(d.withColumn(into, F.avg("_v").over(over(key, "us").rangeBetween(-half + 1, half)))).drop("_v")


def hysteresis(df: DataFrame, p: str, high: float, low: float, min_run: int, gap_us: int, key: str = "site", name: str = "state", width_us: int = WIDTH_US) -> DataFrame:
    """Column ``name``: 0 or 1 by hysteresis decoding of ``p``.

    The first sample and any after a gap start anew (1 if p >= high). Otherwise the state turns once
    ``min_run`` samples from here on (fewer at the end) are all >= high or all <= low, without a gap or
    a missing value (null or NaN) among them; else it holds.
    """
    df = ordered.sliced(df.withColumn("_p", missing(F.col(p).cast("double"))), width_us=width_us)
    p, w = "_p", over(key, "us")
    ahead, after = w.rowsBetween(0, min_run - 1), w.rowsBetween(1, max(1, min_run - 1))
    # Of the rows ahead, the first sees its gap to the row before it, which is in the slice or its halo.
    d = ordered.with_halo(df, key, before=1, after=max(1, min_run - 1))
    d = d.withColumn("_us", F.lag("us").over(w)).withColumn("_new", F.coalesce((F.col("us") - F.col("_us") > gap_us).cast("int"), F.lit(0)))
    whole = F.coalesce(F.sum("_new").over(after), F.lit(0)) == 0 if min_run > 1 else F.lit(True)
    whole = whole & (F.count(p).over(ahead) == F.count(F.lit(1)).over(ahead))
    start = F.col("_us").isNull() | (F.col("_new") == 1)
    turn = (
        F.when(start, F.when(F.col(p) >= high, 1).otherwise(0))
        .when(whole & (F.min(p).over(ahead) >= high), 1)
        .when(whole & (F.max(p).over(ahead) <= low), 0)
    )
    d = ordered.own(d.withColumn("_turn", turn)).drop("_new", "_us", "_p")
    return ordered.running_last(d, key, "_turn", name, width_us=width_us).withColumn(name, F.col(name).cast("int")).drop("_turn", "_own", "_slice")


def change_events(df: DataFrame, state: str, gap_us: int, key: str = "site", midpoint: str = "anchor", width_us: int = WIDTH_US) -> DataFrame:
    """(key, event_us, new_state) where the state changes; across a gap at the midpoint.

    The midpoint is taken from the last change, gap or first sample ('anchor') or from the previous
    sample ('previous').
    """
    d = with_previous(df, {"_before": state, "_us": "us"}, key, width_us)
    d = d.withColumns({"_gap": F.col("us") - F.col("_us") > gap_us, "_change": F.col(state) != F.col("_before")})
    mark = F.when(F.col("_us").isNull() | F.col("_gap") | F.col("_change"), F.col("us"))
    d = ordered.running_last(d.withColumn("_mark", mark), key, "_mark", "_anchor", width_us=width_us, strict=True)
    start = F.col("_anchor") if midpoint == "anchor" else F.col("_us")
    at = F.when(F.col("_gap"), start + F.expr("(us - _start) div 2")).otherwise(F.col("us"))
    return d.where("_change").withColumn("_start", start).select(key, at.alias("event_us"), F.col(state).alias("new_state"))


def change_deltas(df: DataFrame, state: str, key: str = "site", width_us: int = WIDTH_US) -> DataFrame:
    """(key, us, delta_us, new_state): each change with the time since the change or start before it."""
    rows = deltas(state_changes(df, state, key, True, width_us), key, width_us)
    return rows.where("delta_us is not null").select(key, "us", "delta_us", F.col(state).alias("new_state"))
