"""Quality classifier: Bradley-Terry scores from preference pairs.

A labelled good document is preferred to a labelled bad one. The score is linear in step features of
the text's statistics; its weights maximise the Bradley-Terry likelihood, that is the logistic
likelihood of score differences over preference pairs. A quantile of the labelled scores gives the
threshold, which is mapped to ``CUT`` so that scores read as 0 to 1. Scoring is one Spark expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import labelled_sample
from strandline.llm.text_stats import RATIOS, with_stats

#: Scores from here on are predicted good.
CUT = 0.3


@dataclass(frozen=True)
class Model:
    steps: tuple[tuple[str, float, float], ...]  # (statistic, cut, weight when above)
    shift: float


def _steps(x: np.ndarray, bins: int) -> list[tuple[int, float]]:
    out = []
    for k in range(x.shape[1]):
        out += [(k, float(c)) for c in np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[:-1]))]
    return out


def learn(x: np.ndarray, good: np.ndarray, names: list[str], pairs: int = 60_000, bins: int = 24, l2: float = 2e-4, rounds: int = 400, seed: int = 7) -> Model:
    """Weights by accelerated gradient descent over at most ``pairs`` good-bad pairs, fifty for each bad text; a neutral model for one class."""
    if good.all() or not good.any():
        return Model((), 0.0)
    pairs = min(pairs, max(2_000, 50 * int((~good).sum())))
    rng = np.random.default_rng(seed)
    # Junk is rare and varied: its own quantiles are cut points too.
    where = sorted(set(_steps(x, bins) + _steps(x[~good], bins)))
    f = np.stack([x[:, k] > c for k, c in where], 1).astype(np.float32)
    a, b = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    d = f[a] - f[b]
    w = v = np.zeros(f.shape[1], np.float32)
    rate = 4.0 / max(1.0, float((d * d).sum(1).mean()))
    for t in range(rounds):
        ahead = v + (t / (t + 3)) * (v - w)
        grad = -(d.T @ (1 / (1 + np.exp(np.clip(d @ ahead, -30, 30))))) / len(d) + l2 * ahead
        w, v = v, ahead - rate * grad
    s = f @ v
    share = float((~good).mean())
    # The threshold is a quantile of the scores: of the levels at which rejected bad texts less three times the rejected good ones are most, the middle one.
    levels = np.clip(np.linspace(0.2, 1.6, 141) * share, 0, 1)
    worth = [((~good) & (s < t)).sum() - 3 * (good & (s < t)).sum() for t in np.quantile(s, levels)]
    cut = float(np.quantile(s, np.median(levels[np.asarray(worth) == max(worth)])))
    return Model(tuple((names[k], c, float(u)) for (k, c), u in zip(where, v, strict=True) if u), math.log(CUT / (1 - CUT)) - cut)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 12_000, **options) -> Model:
    """Fit on at most ``rows`` documents with a quality label, none of them held out.

    Empty tables, or labels of one class only, give a neutral model with score 0.5 for every text.
    """
    sample = with_stats(labelled_sample(docs, labels, "quality", rows), keep=["hash", "y"])
    got = sorted(sample.select("hash", "y", *[F.col(f"stats.{c}") for c in RATIOS]).collect())  # the same for any layout of the files
    if not got:
        return Model((), 0.0)
    data = np.array([tuple(r)[1:] for r in got], float)
    return learn(data[:, 1:], data[:, 0] == 1, RATIOS, **options)


def score(model: Model, stats: str = "stats") -> Column:
    """0 to 1; higher means that the text is likelier good. Equal texts have equal scores."""
    by: dict[str, list[tuple[float, float]]] = {}
    for name, cut, weight in model.steps:
        by.setdefault(name, []).append((cut, weight))
    total = F.lit(model.shift)
    for name, steps in by.items():
        # One lookup per statistic: the running sum of the weights of all cuts below the value.
        steps.sort()
        sums, value = [0.0, *np.cumsum([w for _, w in steps]).tolist()], F.col(f"{stats}.{name}")
        total = total + _lookup(value, [c for c, _ in steps], sums)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def _lookup(value: Column, cuts: list[float], sums: list[float]) -> Column:
    """sums[number of cuts below value]; both lists are constants of the plan."""
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value))
    return F.get(F.array(*map(F.lit, sums)), below)


def classify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Each document with ``stats``, ``score`` and ``predicted`` (1 good); null texts count as empty.

    Columns of the input named like an output are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("stats", "score", "predicted")]
    return with_stats(docs, keep=keep).withColumn("score", score(model)).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
