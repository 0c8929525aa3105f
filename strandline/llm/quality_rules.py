"""Learned quality rules: an ordered list of interpretable threshold conjunctions.

Sequential covering on labelled statistics: a rule is grown condition by condition while the
information gain on the growing rows is positive, then pruned backwards on the other rows; rows it
covers are taken out and the next rule is learned, until no rule is precise enough. The list is
emitted as one ordered Spark conditional expression, so filtering runs without any Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import labelled_sample
from strandline.llm.text_stats import RATIOS, with_stats

MIN_WORDS, MAX_REPEAT_SHARE = 50, 0.5


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v > self.cut if self.above else v <= self.cut

    def column(self, stats: str) -> Column:
        v = F.col(f"{stats}.{self.name}")
        return v > F.lit(self.cut) if self.above else v <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x, names) for c in rule), np.ones(len(x), bool))


def _best_conditions(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: list[np.ndarray]) -> list[tuple[float, Condition]]:
    """For each statistic the condition of most information gain, if any gains; counts of all cuts come from one pass."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    out = []
    if not p0 or not n0:
        return out
    base = np.log2(p0 / (p0 + n0))
    for k, name in enumerate(names):
        if not len(cuts[k]):
            continue
        where = np.searchsorted(cuts[k], x[:, k], side="left")  # x > cuts[j] where j < where
        low_p, low_n = (np.cumsum(np.bincount(where[m], minlength=len(cuts[k]) + 1))[:-1] for m in (bad, ~bad))
        for above, p, n in ((True, p0 - low_p, n0 - low_n), (False, low_p, low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
            j = int(np.argmax(gain))
            if gain[j] > 1e-9:
                out.append((float(gain[j]), Condition(name, above, float(cuts[k][j]))))
    return sorted(out, key=lambda c: -c[0])


def _grow(first: Condition, x: np.ndarray, bad: np.ndarray, names: list[str], cuts: list[np.ndarray], most: int) -> Rule:
    rule = [first]
    live = first.holds(x, names)
    while len(rule) < most:
        found = _best_conditions(x[live], bad[live], names, cuts)
        if not found:
            break
        rule.append(found[0][1])
        live &= rule[-1].holds(x, names)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[Rule, float, int]:
    """The prefix of the rule with the best (p-n)/(p+n) on the pruning rows; its smoothed precision and cover."""
    best, worth, prec, cover = rule, -2.0, 0.0, 0
    for k in range(len(rule), 0, -1):
        hit = covers(rule[:k], x, names)
        p, n = int((bad & hit).sum()), int((~bad & hit).sum())
        value = (p - n) / max(p + n, 1)
        if value >= worth:
            best, worth, prec, cover = rule[:k], value, p / max(p + n, 1), p
    return best, prec, cover


def _between(all_: np.ndarray, bad: np.ndarray, grid: int) -> np.ndarray:
    """Cut points half-way between neighbouring quantiles of all rows and of the bad ones, so that a cut keeps clear of either side."""
    levels = np.linspace(0, 1, grid)
    values = np.unique(np.concatenate([np.quantile(all_, levels, method="nearest"), np.quantile(bad, levels, method="nearest")]))
    return (values[1:] + values[:-1]) / 2


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.97, min_cover: int = 3, grid: int = 48) -> list[Rule]:
    """The decision list for rows marked bad; empty where there is too little to learn from."""
    rules: list[Rule] = []
    turn = np.arange(len(x)) % 3 == 2  # every third row prunes; the sample comes in the order of the texts' hashes
    open_ = np.ones(len(x), bool)
    for _ in range(max_rules):
        grow, prune = open_ & ~turn, open_ & turn
        if (bad & grow).sum() < min_cover or not (~bad & grow).any():
            break
        cuts = [_between(x[grow, k], x[grow & bad, k], grid) for k in range(len(names))]
        # A rule is grown from the best condition of every statistic; the one that covers most and is precise enough stays.
        best: tuple[int, Rule] | None = None
        for _, first in _best_conditions(x[grow], bad[grow], names, cuts):
            rule, precision, cover = _prune(_grow(first, x[grow], bad[grow], names, cuts, max_conditions), x[prune], bad[prune], names)
            hit = covers(rule, x, names) & open_
            overall = (bad & hit).sum() / max(hit.sum(), 1)
            if cover >= min_cover and min(precision, overall) >= min_precision and (best is None or (bad & hit).sum() > best[0]):
                best = (int((bad & hit).sum()), rule)
        if best is None:
            break
        rule = best[1]
        hit = covers(rule, x, names) & open_
        rules.append(rule)
        open_ &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = 12_000, **options) -> list[Rule]:
    """Learn from at most ``rows`` labelled documents (quality 0 is bad), never from the held-out fold.

    Empty tables, or labels of one class only, give an empty list.
    """
    sample = with_stats(labelled_sample(docs, labels, "quality", rows), keep=["hash", "y"])
    got = sorted(sample.select("hash", "y", *[F.col(f"stats.{c}") for c in RATIOS]).collect())  # the same for any layout of the files
    if not got:
        return []
    data = np.array([tuple(r)[1:] for r in got], float)
    return learn(data[:, 1:], data[:, 0] == 0, RATIOS, **options)


def first_rule(rules: list[Rule], stats: str = "stats") -> Column:
    """1-based number of the first rule that fires, else null: one ordered conditional expression."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(reduce(lambda a, b: a & b, (c.column(stats) for c in rules[k - 1])), F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """Each document with its statistics, ``base_failed``, the number of the rule that fired, and ``kept``.

    Null and empty texts have no words and fail the base test; equal texts get equal verdicts.
    Columns of the input named like an output are replaced.
    """
    s = with_stats(docs, keep=[c for c in (docs.columns if keep is None else keep) if c not in ("stats", "base_failed", "rule", "kept")])
    n, repeated = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    out = s.withColumn("base_failed", (n < MIN_WORDS) | (100 * repeated > int(100 * MAX_REPEAT_SHARE) * n)).withColumn("rule", first_rule(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
