"""Synthetic series: classes of piecewise Gaussian processes with sparse block-Toeplitz precision.

Each class has three regimes, each a third of the length. A regime's precision over LAGS stacked steps has a sparse random block on
the diagonal and identity-like lag blocks, shifted to be positive definite; a step is drawn from the Gaussian conditional on the
LAGS - 1 steps before it. Samples are independent: each has its own seeded generator, so they are made wherever they are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAGS, REGIMES, CLASSES, SPARSITY = 5, 3, 3, 0.2


def symmetric_block(d: int, rng: np.random.Generator, sparsity: float = SPARSITY, low: float = 0.3, high: float = 0.6) -> np.ndarray:
    """A symmetric matrix with floor(d (d - 1) * sparsity / 2) random pairs of entries of either sign between low and high."""
    out = np.zeros((d, d))
    i, j = np.triu_indices(d, 1)
    pick = rng.choice(len(i), int(d * (d - 1) * sparsity / 2), replace=False) if len(i) else np.zeros(0, int)
    out[i[pick], j[pick]] = rng.uniform(low, high, len(pick)) * rng.choice([-1, 1], len(pick))
    return out + out.T


def toeplitz_precision(d: int, rng: np.random.Generator, lags: int = LAGS) -> np.ndarray:
    """Positive definite block-Toeplitz precision of lags x d variables: the random block at lag 0, identities beyond."""
    blocks = [symmetric_block(d, rng), *(np.eye(d) for _ in range(lags - 1))]
    full = np.block([[blocks[abs(a - b)] if a <= b else blocks[abs(a - b)].T for b in range(lags)] for a in range(lags)])
    return full + (0.1 + abs(np.linalg.eigvalsh(full)[0])) * np.eye(lags * d)


def conditional(cov: np.ndarray, d: int, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Regression on `known` earlier steps and Cholesky factor of what remains, for the step after them."""
    n = known * d
    s11, s21, s22 = cov[:n, :n], cov[n : n + d, :n], cov[n : n + d, n : n + d]
    gain = np.linalg.solve(s11, s21.T).T if n else np.zeros((d, 0))
    rest = s22 - gain @ s21.T
    return gain, np.linalg.cholesky((rest + rest.T) / 2)


def processes(d: int, label: int, seed: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Per regime, the conditional for each number of known steps up to LAGS - 1."""
    out = []
    for regime in range(REGIMES):
        cov = np.linalg.inv(toeplitz_precision(d, np.random.default_rng([seed, label, regime])))
        out.append([conditional(cov, d, k) for k in range(LAGS)])
    return out


def one_series(length: int, d: int, regimes: list, rng: np.random.Generator) -> np.ndarray:
    x = np.zeros((length, d))
    part = max(length // REGIMES, 1)
    for t in range(length):
        known = min(t, LAGS - 1)
        gain, factor = regimes[min(t // part, REGIMES - 1)][known]
        x[t] = gain @ x[t - known : t].ravel() + factor @ rng.standard_normal(d)
    return x.T


def synthetic(spark: SparkSession, length: int, n: int, d: int, seed: int = 10) -> DataFrame:
    """sample_id, label (thirds), series of d channels with 3 * floor(length / 3) steps; n is rounded down to a multiple of 3."""
    length, third = length // REGIMES * REGIMES, n // CLASSES

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [processes(d, c, seed) for c in range(CLASSES)]
        for b in batches:
            ids = b.column("id").to_pylist()
            labels = [i // third for i in ids]
            rows = [one_series(length, d, known[c], np.random.default_rng([seed, 99, i])).tolist() for i, c in zip(ids, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.list_(pa.float64())))], ["sample_id", "label", "series"])

    return spark.range(third * CLASSES).mapInArrow(kernel, "sample_id long, label int, series array<array<double>>")


def named_set(spark: SparkSession, name: str) -> DataFrame:
    """Fake_<length>_<n>_<channels>."""
    length, n, d = (int(x) for x in name.split("_")[1:4])
    return synthetic(spark, length, n, d)


def as_samples(df: DataFrame, dataset: str) -> DataFrame:
    """A source's rows with the columns of the samples table."""
    have = {c: F.col(c) for c in df.columns}
    return df.select("sample_id", have.get("split", F.lit("train")).alias("split"), F.lit(dataset).alias("dataset"), "series", "label", F.lit("2000-01-01").cast("timestamp_ntz").alias("loaded_at"))


def flat_channels(spark: SparkSession, dataset: str, d: int, length: int) -> DataFrame:
    """Channel rows without bounds or missing codes, for sources that have none."""
    rows = [(dataset, k, "", None, None, None, length) for k in range(d)]
    return spark.createDataFrame(rows, "dataset string, var_id int, unit string, phys_lo double, phys_hi double, missing_code double, series_len int")
