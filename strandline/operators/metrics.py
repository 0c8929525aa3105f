"""Classification metrics as aggregates: thresholds, curves, confusion, calibration, rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import missing
from strandline.operators.agg import shuffles
from strandline.storage import materialise


def known(c: str) -> Column:
    """Neither null nor NaN: only such scores count in a metric."""
    return missing(F.col(c).cast("double")).isNotNull()


def threshold_sweep(df: DataFrame, p: str, y: str, steps: int = 100) -> DataFrame:
    """(threshold, tp, fp, fn, tn) for thresholds k/steps; predicted positive at p >= threshold.

    Each row is counted once at the highest threshold it passes, and sums over the steps above give
    the counts; the input is aggregated before the thresholds are laid beside it.
    """
    k = F.greatest(F.lit(-1), F.least(F.lit(steps), F.floor(F.col(p) * steps + 1e-9))).cast("int")
    passed = df.where(known(p) & F.col(y).isNotNull()).groupBy(k.alias("_k")).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("_t"))
    at = F.col("_k") >= F.col("_t")
    laid = passed.crossJoin(F.broadcast(grid)).groupBy("_t")  # at most steps + 2 rows on the left
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return laid.agg(
        zero(F.when(at, F.col("_pos"))).alias("tp"),
        zero(F.when(at, F.col("_n") - F.col("_pos"))).alias("fp"),
        zero(F.when(~at, F.col("_pos"))).alias("fn"),
        zero(F.when(~at, F.col("_n") - F.col("_pos"))).alias("tn"),
    ).select((F.col("_t") / float(steps)).alias("threshold"), "tp", "fp", "fn", "tn")


def by_score(df: DataFrame, score: str, y: str) -> DataFrame:
    """Positives and rows for each distinct score: what curves and ranks need, aggregated first."""
    return df.where(known(score) & F.col(y).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))


def _curve(df: DataFrame, score: str, y: str, slices: int | None) -> DataFrame:
    """(score, pos, n, tp, k, all): running sums of positives and rows from the highest score down.

    Distinct scores are dealt to ranges of equal size, whatever their distribution; running sums within
    a range are lifted by the ranges' totals, so no task sorts all scores. The counts by score are
    written once, since ranges are drawn from them.
    """
    s = by_score(df, score, y).repartitionByRange(slices or shuffles(df), F.desc("score")).withColumn("_s", F.spark_partition_id())
    cut = materialise(s)
    above = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_s").agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))  # one row a range
    lifts = totals.select("_s", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"), F.sum("_p").over(Window.partitionBy()).alias("_all"))
    w = Window.partitionBy("_s").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.withColumns({"_rp": F.sum("pos").over(w), "_rn": F.sum("n").over(w)}).join(F.broadcast(lifts), "_s")
    return run.select("score", "pos", "n", (F.col("_p") + F.col("_rp")).alias("tp"), (F.col("_n") + F.col("_rn")).alias("k"), F.col("_all").alias("all"))


def pr_curve(df: DataFrame, score: str, y: str, slices: int | None = None) -> DataFrame:
    """(score, tp, fp, precision, recall) when everything at or above a score is positive."""
    tp, k = F.col("tp"), F.col("k")
    return _curve(df, score, y, slices).select("score", "tp", (k - tp).alias("fp"), (tp / k).alias("precision"), F.when(F.col("all") > 0, tp / F.col("all")).alias("recall"))


def auroc(df: DataFrame, score: str, y: str, slices: int | None = None) -> DataFrame:
    """One row: the area under the ROC curve, ties counting half; null where one class is missing."""
    neg = F.col("n") - F.col("pos")
    pairs = F.sum(neg * (F.col("tp") - F.col("pos")) + neg * F.col("pos") / 2)
    return _curve(df, score, y, slices).agg(F.try_divide(pairs, F.sum("pos") * F.sum(neg)).alias("auroc"))


def average_precision(df: DataFrame, score: str, y: str, slices: int | None = None) -> DataFrame:
    """One row: the sum over scores of the precision there times the recall that it adds; null without positives."""
    return _curve(df, score, y, slices).agg(F.try_divide(F.sum(F.col("tp") / F.col("k") * F.col("pos")), F.max("all")).alias("average_precision"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 15) -> DataFrame:
    """One row: the expected calibration error over equal bins."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins))
    g = df.where(known(p) & F.col(y).isNotNull()).groupBy(b.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col(y).cast("double")).alias("_acc"), F.avg(p).alias("_conf"))
    return g.agg((F.sum(F.col("_n") * F.abs(F.col("_acc") - F.col("_conf"))) / F.sum("_n")).alias("ece"))


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(conf: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, precision, recall, f1) of a confusion table (y, pred, n)."""
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    one = conf.select(F.explode(F.array_distinct(F.array("y", "pred"))).alias("class"), "y", "pred", "n")
    y, p = F.col("y") == F.col("class"), F.col("pred") == F.col("class")
    g = one.groupBy("class").agg(hit(y & p).alias("tp"), hit(~y & p).alias("fp"), hit(y & ~p).alias("fn"))
    from strandline.operators.events import with_scores

    return with_scores(g)


def kappa(conf: DataFrame) -> DataFrame:
    """One row: Cohen's kappa, from the table's margins."""
    rows = conf.groupBy(F.col("y").alias("_k")).agg(F.sum("n").alias("_r"))
    cols = conf.groupBy(F.col("pred").alias("_k")).agg(F.sum("n").alias("_c"))
    chance = rows.join(cols, "_k").agg(F.sum(F.col("_r").cast("double") * F.col("_c")).alias("_e"))
    seen = conf.agg(F.sum("n").alias("_n"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("_o"))
    e = F.coalesce(F.col("_e"), F.lit(0.0)) / (F.col("_n").cast("double") * F.col("_n"))
    return seen.crossJoin(F.broadcast(chance)).select(((F.col("_o") / F.col("_n") - e) / (1 - e)).alias("kappa"))


def precision_threshold(df: DataFrame, score: str, y: str, precision: float) -> DataFrame:
    """One row: the least score at which the precision is reached, else the one of the best precision times recall."""
    c = pr_curve(df, score, y)
    least = F.min(F.when(F.col("precision") >= precision, F.col("score")))
    return c.agg(F.coalesce(least, F.max_by("score", F.col("precision") * F.col("recall"))).alias("threshold"))


def class_counts(df: DataFrame, truth: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, class, tp, pos, said): how often a class was right, true and said; rows with a null on either side don't count."""
    keys = keys or []
    pairs = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys, F.col(truth).alias("_t"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    one = lambda c, t, s: F.struct(F.col(c).alias("class"), F.lit(t).alias("t"), F.lit(s).alias("s"))
    sides = pairs.select(*keys, "_n", (F.col("_t") == F.col("_p")).alias("_same"), F.explode(F.array(one("_t", 1, 0), one("_p", 0, 1))).alias("_x"))
    return sides.groupBy(*keys, F.col("_x.class").alias("class")).agg(
        F.sum(F.when(F.col("_same"), F.col("_n") * F.col("_x.t")).otherwise(0)).alias("tp"), F.sum(F.col("_n") * F.col("_x.t")).alias("pos"), F.sum(F.col("_n") * F.col("_x.s")).alias("said")
    )


def balanced_accuracy(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, balanced_accuracy, n, classes): the mean recall of the classes that are true somewhere."""
    seen = counts.where(F.col("pos") > 0)
    return seen.groupBy(*(keys or [])).agg(F.avg(F.col("tp") / F.col("pos")).alias("balanced_accuracy"), F.sum("pos").alias("n"), F.count(F.lit(1)).alias("classes"))


def macro(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, macro_precision, macro_recall, macro_f1, weighted_f1, balanced_accuracy) over all classes true or said; a score without
    a denominator is 0."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    s = counts.withColumns({"_p": share(F.col("tp"), F.col("said")), "_r": share(F.col("tp"), F.col("pos"))})
    s = s.withColumn("_f", share(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")))
    return s.groupBy(*(keys or [])).agg(
        F.avg("_p").alias("macro_precision"), F.avg("_r").alias("macro_recall"), F.avg("_f").alias("macro_f1"),
        F.try_divide(F.sum(F.col("pos") * F.col("_f")), F.sum("pos")).alias("weighted_f1"), F.avg(F.when(F.col("pos") > 0, F.col("_r"))).alias("balanced_accuracy"),
    )
