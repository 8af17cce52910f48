"""Two-dimensional maps of records from their distances, for plots: the data only, rendering is left to others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from chronoloom.operators.distances import METRICS

#: Records of an exact map: its matrices are records x records, so this bounds the driver's memory (8 * ROWS^2 bytes a matrix).
ROWS = 2_000


def neighbour_probabilities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric probabilities whose rows have the perplexity, by bisection of each row's width (all rows at once)."""
    n = len(d)
    want = np.log(min(perplexity, max((n - 1) / 3, 1.0)))
    lo, hi, beta = np.zeros(n), np.full(n, np.inf), np.ones(n) / max(np.median(d), 1e-12)
    for _ in range(60):
        p = np.exp(-(d - np.where(np.eye(n, dtype=bool), np.inf, d).min(1, keepdims=True)) * beta[:, None])
        np.fill_diagonal(p, 0)
        total = np.maximum(p.sum(1), 1e-300)
        q = p / total[:, None]
        entropy = -(q * np.log(np.maximum(q, 1e-300))).sum(1)
        wide = entropy > want
        lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    return (q + q.T) / (2 * n)


def tsne_positions(d: np.ndarray, perplexity: float = 30.0, steps: int = 400, seed: int = 0) -> np.ndarray:
    """Positions by gradient descent with momentum and early exaggeration, from squared distances."""
    n = len(d)
    if n < 3:
        return np.arange(n)[:, None] * np.array([1.0, 0.0])
    p = neighbour_probabilities(d**2, perplexity)
    rng = np.random.default_rng(seed)
    y, speed, gain = 1e-4 * rng.standard_normal((n, 2)), np.zeros((n, 2)), np.ones((n, 2))
    rate = max(n / 12 / 4, 50)
    for step in range(steps):
        s = (y**2).sum(1)
        w = 1 / (1 + s[:, None] + s[None, :] - 2 * y @ y.T)
        np.fill_diagonal(w, 0)
        f = (p * (12 if step < 100 else 1) - w / w.sum()) * w
        grad = 4 * (f.sum(1)[:, None] * y - f @ y)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(speed), gain + 0.2, gain * 0.8), 0.01)
        speed = (0.5 if step < 100 else 0.8) * speed - rate * gain * grad
        y = y + speed
        y -= y.mean(0)
    return y


def tsne(rows: DataFrame, metric: str = "l1", **how: float) -> DataFrame:
    """id, x, y, both scaled to 0 .. 1. rows: id, vec, at most ROWS of them; more are refused rather than sampled."""
    got = rows.select("id", "vec").orderBy("id").limit(ROWS + 1).toPandas()
    if len(got) > ROWS:
        raise ValueError(f"more than {ROWS} records: map the first two components of an embedding instead")
    x = np.stack(got.vec.to_numpy()) if len(got) else np.zeros((0, 1))
    y = tsne_positions(METRICS[metric](x, x), **how)
    if len(y):
        y = (y - y.min(0)) / np.maximum(y.max(0) - y.min(0), 1e-300)
    return rows.sparkSession.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(got.id, y, strict=True)], "id long, x double, y double")
