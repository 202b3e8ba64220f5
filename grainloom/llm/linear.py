"""Linear classifiers in numpy, and bounded samples to fit them on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def first_by_hash(ids: DataFrame, n: int, *keep: str) -> DataFrame:
    """n rows of a table of ids, the first by a hash of doc_id."""
    return ids.orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id").limit(n).select("doc_id", *keep)


def crc_mod(m: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(m))


class Adam:
    def __init__(self, n: int, rate: float):
        self.w, self.a, self.b, self.t, self.rate = np.zeros(n), np.zeros(n), np.zeros(n), 0, rate

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.a += 0.1 * (g - self.a)
        self.b += 0.001 * (g * g - self.b)
        self.w -= self.rate * (self.a / (1 - 0.9**self.t)) / (np.sqrt(self.b / (1 - 0.999**self.t)) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 300, rate: float = 0.05, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the bias last, of a logistic regression."""
    x1 = np.column_stack([x, np.ones(len(x))])
    fit = Adam(x1.shape[1], rate)
    total = weight.sum()
    for _ in range(epochs):
        g = x1.T @ ((sigmoid(x1 @ fit.w) - y) * weight) / total
        g[:-1] += ridge * fit.w[:-1]
        fit.step(g)
    return fit.w


def calibration(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make sigmoid(slope * logit + offset) fit y."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    w = logistic(logit[:, None], y, np.ones(len(y)), 400, 0.05, 0.0)
    return float(max(w[0], 1e-3)), float(w[1])
