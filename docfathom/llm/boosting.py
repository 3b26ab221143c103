"""Small gradient-boosted trees: fitted with numpy, evaluated as SQL columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # (feature, threshold, below, above) with numbers as leaves


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int) -> Tree | float:
    leaf = float(gradient.sum() / (hessian.sum() + 1.0))
    if depth == 0 or len(x) < 8:
        return leaf
    best, found = 1e-6, None
    whole = gradient.sum() ** 2 / (hessian.sum() + 1.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, g, h = x[order, j], np.cumsum(gradient[order]), np.cumsum(hessian[order])
        cut = np.flatnonzero(v[1:] != v[:-1])
        if len(cut):
            gain = g[cut] ** 2 / (h[cut] + 1.0) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + 1.0) - whole
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = float(gain[k]), (j, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if found is None:
        return leaf
    j, t = found
    low = x[:, j] < t
    return (j, t, _grow(x[low], gradient[low], hessian[low], depth - 1), _grow(x[~low], gradient[~low], hessian[~low], depth - 1))


def _value(tree: Tree | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, t, below, above = tree
    return np.where(x[:, j] < t, _value(below, x), _value(above, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3) -> list[Tree | float]:
    """Trees whose sum is the log-odds of y."""
    total, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        tree = _grow(x, y - p, p * (1 - p), depth)
        out.append(_scaled(tree, rate))
        total += _value(out[-1], x)
    return out


def _scaled(tree: Tree | float, rate: float) -> Tree | float:
    return (*tree[:2], _scaled(tree[2], rate), _scaled(tree[3], rate)) if isinstance(tree, tuple) else tree * rate


def log_odds(trees: list[Tree | float], x: np.ndarray) -> np.ndarray:
    return sum((_value(t, x) for t in trees), np.zeros(len(x)))


def log_odds_column(trees: list[Tree | float], features: list[Column]) -> Column:
    def of(tree: Tree | float) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(features[tree[0]] < tree[1], of(tree[2])).otherwise(of(tree[3]))

    total = F.lit(0.0)
    for tree in trees:
        total = total + of(tree)
    return total
