"""Small gradient-boosted trees: fitted on the driver from a bounded table of numbers, applied as one SQL expression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    """Additive logistic model.  A tree is (feature, threshold, left, right) or a leaf's number; left takes values <= threshold."""

    names: list[str]
    base: float = 0.0
    trees: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.score(x)))

    def column(self, value) -> Column:
        """The log-odds of ``value(name)``, the Columns of the features."""

        def tree(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            at, threshold, left, right = t
            return F.when(value(self.names[at]) <= threshold, tree(left)).otherwise(tree(right))

        out = F.lit(self.base)
        for t in self.trees:
            out = out + tree(t)
        return out


    def sql(self, value) -> str:
        """The same as one SQL expression; ``value(name)``: a feature's SQL."""

        def tree(t) -> str:
            if not isinstance(t, tuple):
                return f"{float(t)!r}D"
            at, threshold, left, right = t
            return f"CASE WHEN {value(self.names[at])} <= {float(threshold)!r}D THEN {tree(left)} ELSE {tree(right)} END"

        return " + ".join([f"{float(self.base)!r}D", *map(tree, self.trees)])


def _apply(t, x: np.ndarray) -> np.ndarray:
    if not isinstance(t, tuple):
        return np.full(len(x), float(t))
    at, threshold, left, right = t
    return np.where(x[:, at] <= threshold, _apply(left, x), _apply(right, x))


def _grow(x, g, h, depth: int, rate: float):
    leaf = float(-rate * g.sum() / (h.sum() + 1.0))
    if not depth or len(g) < 8:
        return leaf
    best, cut = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for at in range(x.shape[1]):
        for threshold in np.unique(x[:, at])[:-1]:
            low = x[:, at] <= threshold
            a, b = h[low].sum(), h[~low].sum()
            gain = g[low].sum() ** 2 / (a + 1) + g[~low].sum() ** 2 / (b + 1) - whole
            if gain > best and min(a, b) > 0.5:
                best, cut = gain, (at, float(threshold), low)
    if cut is None:
        return leaf
    at, threshold, low = cut
    return at, threshold, _grow(x[low], g[low], h[low], depth - 1, rate), _grow(x[~low], g[~low], h[~low], depth - 1, rate)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 24, depth: int = 3, rate: float = 0.4) -> Boosted:
    """Newton boosting of the logistic loss; deterministic."""
    p = y.mean()
    model = Boosted(names, float(np.log(p / (1 - p))))
    score = np.full(len(y), model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        t = _grow(x, q - y, q * (1 - q), depth, rate)
        model.trees.append(t)
        score = score + _apply(t, x)
    return model


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Least score from which on, for every higher threshold too, held-out precision is reached; infinite if it never is."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(hits >= precision)
    ends = np.r_[score[order][1:] != score[order][:-1], True]  # equal scores stand together
    good = [k for k in good if ends[k]]
    return float(score[order][good[-1]]) if good else float("inf")
