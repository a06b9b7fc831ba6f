"""Bounded samples of labelled documents for the two classifiers, and the step from a margin to a probability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``text`` and ``y`` of at most ``most`` labelled documents outside the held-out fold, one row for each.

    These are the labelled keys whose hashes are smallest, a fixed random choice. Null keys and labels are left out; a
    key with several labels takes the largest; of rows with one key one is taken. The keys are broadcast, which
    ``most`` bounds.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(key, folds) != held_out)).groupBy(key).agg(F.max(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(most)
    found = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), key)
    return found.dropDuplicates([key]).select("text", "y")


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of the logistic curve that fits labels ``y`` to margins ``x``, by Newton's steps.

    The targets are drawn in a little (Platt's correction), so that separable margins keep a finite slope.
    """
    ones, n = float(y.sum()), len(y)
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (n - ones + 2))
    w = np.array([0.0, np.log((ones + 1) / (n - ones + 1))])
    design = np.stack([x, np.ones(n)], axis=1)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(np.sum(np.logaddexp(0, z) - target * z) + ridge * w @ w)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        slope = design.T @ (p - target) + 2 * ridge * w
        bend = design.T @ (design * (p * (1 - p))[:, None]) + 2 * ridge * np.eye(2)
        step, size = np.linalg.solve(bend, slope), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def probability(margin: np.ndarray, slope: float, intercept: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * margin + intercept, -35, 35)))
