"""Gradient-boosted trees over small integer features, fitted on a contingency table.

The driver fits on counted feature combinations (a table bounded by the number of bins), and a
fitted model turns into a Column, so that scoring stays in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One cell: feature values, weight of all candidates, weight of the positives among them.
Cell = tuple[tuple[int, ...], float, float]


@dataclass
class Boosted:
    """Sum of small trees on the log-odds scale."""

    base: float = 0.0
    trees: list = field(default_factory=list)

    def margin(self, x: tuple[int, ...]) -> float:
        out = self.base
        for tree in self.trees:
            while isinstance(tree, tuple):
                f, cut, low, high = tree
                tree = low if x[f] <= cut else high
            out += tree
        return out

    def probability(self, x: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(x)))))

    def column(self, features: list[Column]) -> Column:
        """The margin as a Column over ``features``."""

        def walk(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, cut, low, high = tree
            return F.when(features[f] <= cut, walk(low)).otherwise(walk(high))

        out = F.lit(float(self.base))
        for tree in self.trees:
            out = out + walk(tree)
        return out


def _grow(cells: list[tuple[tuple[int, ...], float, float]], depth: int, rate: float):
    """One regression tree on (x, gradient, hessian) cells; a leaf is a number."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (1e-6, None)
    if depth:
        for f in range(len(cells[0][0])):
            by: dict[int, list[float]] = {}
            for x, cg, ch in cells:
                cell = by.setdefault(x[f], [0.0, 0.0])
                cell[0] += cg
                cell[1] += ch
            lg = lh = 0.0
            for cut in sorted(by)[:-1]:
                lg, lh = lg + by[cut][0], lh + by[cut][1]
                gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (f, cut))
    if best[1] is None:
        return rate * g / (h + 1)
    f, cut = best[1]
    low, high = [c for c in cells if c[0][f] <= cut], [c for c in cells if c[0][f] > cut]
    return f, cut, _grow(low, depth - 1, rate), _grow(high, depth - 1, rate)


def fit(cells: list[Cell], rounds: int = 30, depth: int = 3, rate: float = 0.3) -> Boosted:
    """Logistic boosting; an empty table gives a model that scores everything near zero."""
    total, positive = sum(c[1] for c in cells), sum(c[2] for c in cells)
    model = Boosted(math.log((positive + 0.5) / (total - positive + 0.5)) if cells else -30.0)
    for _ in range(rounds if cells else 0):
        work = []
        for x, n, y in cells:
            p = model.probability(x)
            work.append((x, y - n * p, n * p * (1 - p)))
        model.trees.append(_grow(work, depth, rate))
    return model
