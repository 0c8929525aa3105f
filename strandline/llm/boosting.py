"""Gradient-boosted trees fitted in numpy on a bounded sample, scored as one Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    value: float = 0.0


def _leaf(g: np.ndarray, h: np.ndarray, rate: float) -> Node:
    return Node(value=float(-rate * g.sum() / (h.sum() + 1.0)))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, m: np.ndarray, cuts: list[np.ndarray], depth: int, rate: float, least: int) -> Node:
    if not depth or m.sum() < 2 * least:
        return _leaf(g, h, rate)
    top, best = 1e-6, None
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for k, points in enumerate(cuts):
        if not len(points):
            continue
        where = np.searchsorted(points, x[:, k], side="left")  # x > points[j] from j+1 on
        size = len(points) + 1
        n, sg, sh = (np.cumsum(np.bincount(where, w, size))[:-1] for w in (m, g, h))
        gain = sg**2 / (sh + 1.0) + (g.sum() - sg) ** 2 / (h.sum() - sh + 1.0) - base
        gain[(n < least) | (m.sum() - n < least)] = -1
        j = int(np.argmax(gain))
        if gain[j] > top:
            top, best = gain[j], (k, float(points[j]))
    if best is None:
        return _leaf(g, h, rate)
    high = x[:, best[0]] > best[1]
    return Node(*best, _grow(x[~high], g[~high], h[~high], m[~high], cuts, depth - 1, rate, least), _grow(x[high], g[high], h[high], m[high], cuts, depth - 1, rate, least))


def _values(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] > node.cut, _values(node.high, x), _values(node.low, x))


@dataclass(frozen=True)
class Forest:
    start: float
    trees: tuple[Node, ...]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((_values(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        """The logit as nested conditionals over the feature columns."""
        total = F.lit(self.start)
        for t in self.trees:
            total = total + _column(t, features)
        return total


def _column(node: Node, features: list[Column]) -> Column:
    if node.low is None:
        return F.lit(node.value)
    return F.when(features[node.feature] > F.lit(node.cut), _column(node.high, features)).otherwise(_column(node.low, features))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, rate: float = 0.4, bins: int = 32, least: int = 4, weights: np.ndarray | None = None) -> Forest:
    """Newton boosting on the logistic loss; a row of weight n counts as n rows."""
    m = np.ones(len(y)) if weights is None else weights.astype(float)
    share = float(np.clip(np.average(y, weights=m), 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    cuts = []
    for k in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins), method="nearest"))
        cuts.append((values[1:] + values[:-1]) / 2)
    f, out = np.full(len(x), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        out.append(_grow(x, m * (p - y), m * p * (1 - p), m, cuts, depth, rate, least))
        f += _values(out[-1], x)
    return Forest(start, tuple(out))
