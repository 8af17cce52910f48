"""Features of samples to embeddings: scaling per feature, covariance, energy-limited principal components, projection.

A feature column is a row of the table with an array. The components come from the smaller of two problems, whose figures alone go
to the driver: with at most MATRIX features, the covariance of the features, from sums over samples made batch by batch; with more
features but at most MATRIX samples, the products of all pairs of samples (the same energies, and components as sums of samples);
with more of both, the leading components by power iteration on a block of vectors, which is widened until it holds the energy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.distances import block_rows
from chronoloom.storage import materialize

MATRIX, FIRST_RANK, POWER_ROUNDS, SLICE = 2_000, 64, 8, 512


def norms(features: DataFrame) -> DataFrame:
    """dataset, norm: square roots of each feature's sum of squares over the samples."""
    long = features.select("dataset", F.posexplode("feature").alias("f", "v"))
    per = long.groupBy("dataset", "f").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return per.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("f", "n"))).alias("n")).select("dataset", F.col("n.n").alias("norm"))


def normalised(features: DataFrame) -> DataFrame:
    """Each feature over all samples of the dataset scaled to length 1; a feature that is 0 everywhere stays 0."""
    scaled = F.zip_with("feature", "norm", lambda v, n: F.when(n > 0, v / n).otherwise(F.lit(0.0)))
    return features.join(norms(features), "dataset").withColumn("feature", scaled).drop("norm")


def moments(features: DataFrame) -> DataFrame:
    """dataset, n, s (sums), p (products, row by row, of the upper triangle) in partial sums added up on the JVM."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], list] = {}  # one triangle per dataset, added up over the batches of the task
        for f in frames:
            for (name, d), g in f.groupby(["dataset", f.feature.str.len()], sort=False):
                x = np.stack(g.feature.to_numpy())
                at = held.setdefault((name, d), [0, np.zeros((d, d)), np.zeros(d)])
                at[0], at[1], at[2] = at[0] + len(x), at[1] + x.T @ x, at[2] + x.sum(0)
        for (name, d), (n, c, s) in held.items():
            i, j = np.triu_indices(d)
            yield pd.DataFrame({"dataset": name, "n": n, "i": i.astype(np.int32), "j": j.astype(np.int32), "p": c[i, j], "si": s[i], "sj": s[j]})

    part = features.select("dataset", "feature").mapInPandas(kernel, "dataset string, n long, i int, j int, p double, si double, sj double")
    return part.groupBy("dataset", "i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "p", "si", "sj")))


def covariance(features: DataFrame) -> DataFrame:
    """dataset, i, j, cov for i <= j (sample covariance of the features; null with one sample)."""
    return moments(features).select("dataset", "i", "j", F.when(F.col("n") > 1, (F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def energy_rank(values: np.ndarray, percent: float) -> int:
    """One more than the last place where the first components hold less than the percentage; all, if there is none."""
    held = 100 * np.cumsum(values) / values.sum() if values.sum() > 0 else np.full(len(values), 100.0)
    below = np.flatnonzero(held < percent)
    return int(below[-1]) + 2 if len(below) else len(values)


def fixed_sign(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)


def shapes_of(features: DataFrame) -> dict[str, tuple[int, int]]:
    """Samples and features of each dataset."""
    rows = features.groupBy("dataset").agg(F.count("*").alias("n"), F.max(F.size("feature")).alias("d")).collect()  # one row per dataset
    return {r.dataset: (r.n, r.d) for r in rows}


def _means(rows: DataFrame, d: int) -> np.ndarray:
    """Mean of each feature: d numbers."""
    got = rows.select(F.posexplode("feature").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("m")).toPandas()
    out = np.zeros(d)
    out[got.f] = got.m
    return out


def _products(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """sample_ids and the products of all pairs of samples, made in meetings of blocks; n x n numbers in all."""
    blocks = -(-n // block_rows(n, 512))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    placed = rows.select("sample_id", "feature", F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).alias("_own")).withColumn("_other", every)
    placed = placed.withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other")})

    def kernel(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("sample_id")
        first = f._own.to_numpy() == f._a.to_numpy()
        same = f._a.iloc[0] == f._b.iloc[0]
        x, y = f[first], f[first] if same else f[~first]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "m": []})
        m = np.stack(x.feature.to_numpy()) @ np.stack(y.feature.to_numpy()).T
        return pd.DataFrame({"a": [x.sample_id.to_numpy().tobytes()], "b": [y.sample_id.to_numpy().tobytes()], "m": [m.tobytes()]})

    ids = np.sort(rows.select("sample_id").toPandas().sample_id.to_numpy())  # at most MATRIX
    out = np.zeros((n, n))
    for r in placed.groupBy("_a", "_b").applyInPandas(kernel, "a binary, b binary, m binary").toLocalIterator():
        i, j = (np.searchsorted(ids, np.frombuffer(bytes(k), np.int64)) for k in (r.a, r.b))
        m = np.frombuffer(bytes(r.m)).reshape(len(i), len(j))
        out[np.ix_(i, j)], out[np.ix_(j, i)] = m, m.T
    return ids, out


def _weighted_sum(rows: DataFrame, ids: np.ndarray, weights: np.ndarray, d: int) -> np.ndarray:
    """Sum over samples of feature x weights (d x k): partial sums of each task are added by slices of features."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, weights))
    k = weights.shape[1]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, w = sent.value
        total = np.zeros((d, k))
        for f in frames:
            total += np.stack(f.feature.to_numpy()).T @ w[np.searchsorted(order, f.sample_id.to_numpy())] if len(f) else 0
        for a in range(0, d, SLICE):
            yield pd.DataFrame({"at": [a], "m": [total[a : a + SLICE].tobytes()]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [f["at"].iloc[0]], "m": [np.sum([np.frombuffer(m) for m in f.m], axis=0).tobytes()]})

    got = rows.select("sample_id", "feature").mapInPandas(partial, "at int, m binary").groupBy("at").applyInPandas(add, "at int, m binary")
    out = np.zeros((d, k))
    for r in got.toLocalIterator():
        m = np.frombuffer(bytes(r.m)).reshape(-1, k)
        out[r["at"] : r["at"] + len(m)] = m
    return out


def _by_samples(rows: DataFrame, n: int, d: int, percent: float) -> np.ndarray:
    """Components from the products of samples: eigenvectors of the centred products give weights of samples."""
    ids, k = _products(rows, n)
    centred = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    value, vector = np.linalg.eigh((centred + centred.T) / 2)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    held = value > 1e-12 * max(value[0], 1e-300)
    rank = min(energy_rank(np.append(value[held], np.zeros(max(d - held.sum(), 0))), percent), int(held.sum()))
    return _weighted_sum(rows, ids, vector[:, :rank] / np.sqrt(value[:rank]), d)


def _by_iteration(rows: DataFrame, d: int, percent: float) -> np.ndarray:
    """Leading components by power iteration on a block of vectors, twice as wide as long as it does not hold the energy."""
    mean = _means(rows, d)
    total = rows.select(F.aggregate("feature", F.lit(0.0), lambda s, x: s + x * x).alias("q")).agg(F.sum("q")).first()[0] - rows.count() * (mean**2).sum()
    rng, rank, spark = np.random.default_rng(5), min(FIRST_RANK, d), rows.sparkSession
    q = np.linalg.qr(rng.standard_normal((d, rank)))[0]

    def spread(q: np.ndarray) -> np.ndarray:
        """Centred products with q: sum over samples of (x - mean) ((x - mean) q)."""
        sent, k = spark.sparkContext.broadcast((q, mean)), q.shape[1]

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v, m = sent.value
            out = np.zeros((d, k))
            for f in frames:
                if len(f):
                    x = np.stack(f.feature.to_numpy()) - m
                    out += x.T @ (x @ v)
            for a in range(0, d, SLICE):
                yield pd.DataFrame({"at": [a], "m": [out[a : a + SLICE].tobytes()]})

        def add(f: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": [f["at"].iloc[0]], "m": [np.sum([np.frombuffer(m) for m in f.m], axis=0).tobytes()]})

        out = np.zeros((d, k))
        for r in rows.select("feature").mapInPandas(partial, "at int, m binary").groupBy("at").applyInPandas(add, "at int, m binary").toLocalIterator():
            m = np.frombuffer(bytes(r.m)).reshape(-1, k)
            out[r["at"] : r["at"] + len(m)] = m
        return out

    while True:
        for _ in range(POWER_ROUNDS):
            q = np.linalg.qr(spread(q))[0]
        value, turn = np.linalg.eigh(q.T @ spread(q))
        value, q = np.maximum(value[::-1], 0), q @ turn[:, ::-1]
        held = 100 * np.cumsum(value) / total if total > 0 else np.full(len(value), 100.0)
        below = np.flatnonzero(held < percent)
        need = int(below[-1]) + 2 if len(below) else len(value)
        if need <= len(value) or len(value) >= d:
            return q[:, : min(need, d)]
        q = np.linalg.qr(np.hstack([q, rng.standard_normal((d, min(len(value), d - len(value))))]))[0]


def projections(features: DataFrame, percent: dict[str, float], matrix: int = MATRIX) -> dict[str, np.ndarray]:
    """Per dataset the components (features x k) that hold the energy, in per cent."""
    sizes, out = shapes_of(features), {}
    small = [name for name, (_, d) in sizes.items() if d <= matrix]
    if small:
        found = covariance(features.filter(F.col("dataset").isin(small))).toPandas()  # at most matrix^2 / 2 rows per dataset
        for name, g in found.groupby("dataset"):
            d = int(g.j.max()) + 1
            m = np.zeros((d, d))
            m[g.i, g.j] = g["cov"].fillna(0)
            m[g.j, g.i] = g["cov"].fillna(0)
            value, vector = np.linalg.eigh(m)
            value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
            out[name] = vector[:, : energy_rank(value, percent[name])]
    for name, (n, d) in sizes.items():
        if d > matrix:
            rows = features.filter(F.col("dataset") == name)
            out[name] = _by_samples(rows, n, d, percent[name]) if n <= matrix else _by_iteration(rows, d, percent[name])
    return {name: fixed_sign(v) for name, v in out.items()}


def project(features: DataFrame, components: dict[str, np.ndarray], centre: dict[str, np.ndarray] | None = None) -> DataFrame:
    """sample_id, dataset, emb: features, less the centre if one is given, times components. Also for new samples (their own norms
    first). The components are broadcast: features x k numbers per dataset."""
    sent = features.sparkSession.sparkContext.broadcast((components, centre or {}))

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, middle = sent.value
        for f in frames:
            for name, g in f.groupby("dataset", sort=False):
                if name in parts:
                    yield pd.DataFrame({"sample_id": g.sample_id, "dataset": name, "emb": list((np.stack(g.feature.to_numpy()) - middle.get(name, 0.0)) @ parts[name])})

    return features.select("sample_id", "dataset", "feature").mapInPandas(kernel, "sample_id long, dataset string, emb array<double>")


class Embedder:
    """Components of a set of samples, to embed these and later ones. hyper: dataset, cumulativeenergysaving in per cent (and, if there,
    dimension_reduce: false leaves the scaled features as they are). components: a fixed number, whatever the energy; centred: means are taken off
    before the projection, as usual for principal components, while the plain form projects the scaled features themselves."""

    def __init__(self, hyper: DataFrame, components: int | None = None, centred: bool = False, matrix: int = MATRIX) -> None:
        cols = ["dataset", "cumulativeenergysaving", *(c for c in ("dimension_reduce",) if c in hyper.columns)]
        self.hyper = {r[0]: (float(r[1]), len(r) < 3 or r[2] is not False) for r in hyper.select(*cols).collect()}  # one row per dataset
        self.most, self.centred, self.matrix = components, centred, matrix
        self.components: dict[str, np.ndarray] = {}
        self.centre: dict[str, np.ndarray] = {}

    def fit(self, features: DataFrame) -> "Embedder":
        """features: sample_id, dataset, feature, not scaled yet."""
        scaled = materialize(normalised(features.filter(F.col("dataset").isin([k for k, (_, reduce) in self.hyper.items() if reduce]))), "scaled")
        percent = {k: 100.1 if self.most else p for k, (p, _) in self.hyper.items()}
        self.components = {k: v[:, : self.most] for k, v in projections(scaled, percent, self.matrix).items()}
        if self.centred:
            self.centre = {k: _means(scaled.filter(F.col("dataset") == k), len(v)) for k, v in self.components.items()}
        return self

    def transform(self, features: DataFrame) -> DataFrame:
        """sample_id, dataset, emb of these samples, which are scaled by their own norms."""
        scaled = normalised(features)
        whole = scaled.filter(F.col("dataset").isin([k for k, (_, reduce) in self.hyper.items() if not reduce]))
        return project(scaled, self.components, self.centre).unionByName(whole.select("sample_id", "dataset", F.col("feature").alias("emb")))

    def fit_transform(self, features: DataFrame) -> DataFrame:
        return self.fit(features).transform(features)


def embed(features: DataFrame, hyper: DataFrame, components: int | None = None, centred: bool = False) -> DataFrame:
    """sample_id, dataset, emb. Energy in per cent from hyper; components: keep at most so many, whatever the energy."""
    return Embedder(hyper.select("dataset", "cumulativeenergysaving"), components, centred).fit_transform(features)
