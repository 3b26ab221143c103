"""Bounded samples of labelled rows, and folds that keep rows out of learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def learnable(labels: DataFrame, key: str, label: str, kept_out: Column) -> DataFrame:
    """``key`` and ``y`` (0 or 1) of labelled rows that may be learnt from, one a key."""
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    return rows.filter(~kept_out).groupBy(key).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("y"))


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, by the order of the key's hash."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means of y by x that never fall (pool adjacent violators): knots and values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # first x, last x, sum of weights, weighted sum
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        if blocks and blocks[-1][1] == a:
            blocks[-1][2] += w
            blocks[-1][3] += w * b
        else:
            blocks.append([a, a, w, w * b])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1][1] = last[1]
            blocks[-1][2] += last[2]
            blocks[-1][3] += last[3]
    knots = np.array([v for b in blocks for v in b[:2]])
    return knots, np.repeat([b[3] / b[2] for b in blocks], 2)
