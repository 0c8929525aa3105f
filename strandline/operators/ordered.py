"""Ordered scans over (key, time range) slices with carried state.

A window over a whole key is one task however many rows the key has. Here a key's rows are cut into
slices of a fixed time range, and windows run over (key, slice). What a slice must know of the others
comes as added rows: the nearest rows of the slices around it (halo), or one row with the state that
all earlier or later slices leave (carry). Halo and carry are made of a few rows for each slice, the
only thing that is ever ordered over a whole key. Added rows have ``_own`` false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.timeparts import DAY_US
from strandline.storage import materialise

#: Width of a slice: at one sample a second 600,000 rows.
WIDTH_US = 7 * DAY_US


def _slice_of(us: Column, width_us: int) -> Column:
    return F.floor(us / width_us).cast("long")


def sliced(df: DataFrame, order: str = "us", width_us: int = WIDTH_US) -> DataFrame:
    """df with ``_slice``, the number of its time range, and ``_own``."""
    return df.withColumns({"_slice": _slice_of(F.col(order), width_us), "_own": F.lit(True)})


def over(key: str, *order: Column | str):
    return Window.partitionBy(key, "_slice").orderBy(*order)


def _ends(d: DataFrame, key: str, order: str, n: int, last: bool) -> DataFrame:
    """(key, _slice, rows): the first or last n rows of each slice, in order."""
    direction = F.desc(order) if last else F.asc(order)
    few = d.withColumn("_n", F.row_number().over(over(key, direction))).where(F.col("_n") <= n)
    row = F.struct((-F.col("_n") if last else F.col("_n")).alias("n"), F.struct(*[c for c in d.columns if c not in ("_slice", "_own", key)]).alias("row"))
    return few.groupBy(key, "_slice").agg(F.array_sort(F.collect_list(row), lambda a, b: a["n"] - b["n"]).alias("rows"))


def with_halo(d: DataFrame, key: str, before: int = 0, after: int = 0, order: str = "us") -> DataFrame:
    """d with the last ``before`` rows of earlier slices and the first ``after`` rows of later ones added to each slice.

    Every slice has a row, so the ``before`` slices in front hold as many rows or all there are.
    """
    out = d
    for n, last in ((before, True), (after, False)):
        if n:
            ends = _ends(d, key, order, n, last)
            frame = Window.partitionBy(key).orderBy("_slice").rowsBetween(*((-n, -1) if last else (1, n)))
            near = F.flatten(F.collect_list("rows").over(frame))
            kept = F.slice(near, F.greatest(F.size(near) - (n - 1), F.lit(1)), n) if last else F.slice(near, 1, n)
            # Picked where it stands: a filter pushed below would need the window twice.
            halo = ends.select(key, "_slice", kept.alias("_kept")).select(key, "_slice", F.explode("_kept").alias("_r"))
            out = out.unionByName(halo.select(key, "_slice", "_r.row.*").withColumn("_own", F.lit(False)))
    return out


def with_carry(d: DataFrame, key: str, value: str, summary: Column, chain: Callable[[Column], Column], order: str = "us", width_us: int = WIDTH_US, backwards: bool = False) -> DataFrame:
    """d with a row before the first (``backwards``: after the last) of each slice, whose ``value`` is the state left by all slices
    before (after) it: ``summary`` reduces a slice, ``chain`` the summaries, as a window function. Other columns are null."""
    d = materialise(d, few=False)  # read twice: what it is made of, windows and all, is computed once
    per = d.groupBy(key, "_slice").agg(summary.alias("_s"))
    frame = Window.partitionBy(key).orderBy(F.desc("_slice") if backwards else F.asc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    at = (F.col("_slice") + 1) * width_us if backwards else F.col("_slice") * width_us - 1
    state = per.select(key, "_slice", at.alias(order), chain(F.col("_s")).over(frame).alias(value)).where(F.col(value).isNotNull())
    return d.unionByName(state.withColumn("_own", F.lit(False)), allowMissingColumns=True)


def own(d: DataFrame) -> DataFrame:
    """The rows that were there before any were added."""
    return d.where("_own")


def done(d: DataFrame) -> DataFrame:
    return own(d).drop("_own", "_slice")


def running_last(d: DataFrame, key: str, value: str, into: str, order: str = "us", width_us: int = WIDTH_US, strict: bool = False, backwards: bool = False) -> DataFrame:
    """Own rows with ``into``: the last ``value`` that isn't null up to (``strict``: before) a row, over all slices of the key.

    Rows at one time see each other's values, unless ``strict``.
    """
    when = F.when(F.col(value).isNotNull(), F.col(order))
    best = F.min_by(value, when) if backwards else F.max_by(value, when)
    d = with_carry(d, key, value, best, lambda s: F.last(s, ignorenulls=True), order, width_us, backwards)
    w = over(key, F.desc(order) if backwards else F.asc(order))
    frame = w.rowsBetween(Window.unboundedPreceding, -1) if strict else w.rangeBetween(Window.unboundedPreceding, 0)
    return own(d.withColumn(into, F.last(value, ignorenulls=True).over(frame)))


def running_sum(d: DataFrame, key: str, value: str, into: str, order: str = "us", width_us: int = WIDTH_US) -> DataFrame:
    """Own rows with ``into``: the sum of ``value`` up to a row, over all slices of the key."""
    d = with_carry(d, key, value, F.sum(value), F.sum, order, width_us)
    return own(d.withColumn(into, F.sum(value).over(over(key, order).rowsBetween(Window.unboundedPreceding, 0))))


def around(df: DataFrame, before_us: int, after_us: int, order: str = "us", width_us: int = WIDTH_US) -> DataFrame:
    """Sliced rows, each also in every slice that holds a time whose window reaches it: windows of ``before_us`` back and
    ``after_us`` ahead are whole for own rows. A row is copied only where it is that near to a slice's edge."""
    t, width = F.col(order), max(width_us, before_us, after_us)
    every = F.sequence(_slice_of(t - after_us, width), _slice_of(t + before_us, width))
    return df.withColumn("_slice", F.explode(every)).withColumn("_own", F.col("_slice") == _slice_of(t, width))
