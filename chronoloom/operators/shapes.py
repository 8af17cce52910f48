"""Comparison methods on whole series: shape-based and warping distances, fuzzy memberships, covariance components, hidden Markov
models, and the clusterers built on them. Kernels are numpy on stacked arrays; records meet in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.distances import meet, stack
from chronoloom.operators.series import packed
from chronoloom.storage import materialize


def sbd(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 - largest normalised cross product over the lags 0 .. L - 2 of x ahead of y, for all rows of x and y (one-sided, so not
    symmetric); 1 where a row is zero."""
    n = x.shape[1]
    size = 1 << (2 * n - 1).bit_length()
    fx, fy = np.fft.rfft(x, size), np.fft.rfft(y, size)
    best = np.empty((len(x), len(y)))
    for i in range(len(x)):
        best[i] = np.fft.irfft(fx[i] * np.conj(fy), size)[:, : max(n - 1, 1)].max(1)
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
    return np.where(norm > 0, 1 - best / np.where(norm > 0, norm, 1), 1.0)


def dtw(x: np.ndarray, y: np.ndarray, measure: str = "euclidean") -> np.ndarray:
    """Exact warping cost of pairs: x, y are pairs x steps x channels. Cost of a step pair: euclidean or cosine distance."""
    if measure == "euclidean":
        cost = np.sqrt(((x[:, :, None, :] - y[:, None, :, :]) ** 2).sum(-1))
    elif measure == "cosine":
        norm = np.linalg.norm(x, axis=-1)[:, :, None] * np.linalg.norm(y, axis=-1)[:, None, :]
        cost = 1 - np.einsum("nid,njd->nij", x, y) / np.where(norm > 0, norm, 1)
    else:
        raise ValueError(f"unknown measure {measure}")
    n, a, b = cost.shape
    total = np.full((n, a + 1, b + 1), np.inf)
    total[:, 0, 0] = 0
    for s in range(2, a + b + 1):  # one anti-diagonal of all pairs at a time
        i = np.arange(max(1, s - b), min(a, s - 1) + 1)
        j = s - i
        total[:, i, j] = cost[:, i - 1, j - 1] + np.minimum(np.minimum(total[:, i - 1, j], total[:, i, j - 1]), total[:, i - 1, j - 1])
    return total[:, a, b]


def series_rows(cubes: pd.Series, depth: int) -> np.ndarray:
    """Flat vectors back to records x channels x steps."""
    x = stack(cubes)
    return x.reshape(len(x), depth, -1)


def sbd_table(queries: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """i, j, var_id, d for every query i (x) against every row j (y); rows: id, vec (channels end to end)."""

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = series_rows(x.vec, depth), series_rows(y.vec, depth)
        parts = [pd.DataFrame({"i": np.repeat(x.id.to_numpy(), len(y)), "j": np.tile(y.id.to_numpy(), len(x)), "var_id": v, "d": sbd(a[:, v], b[:, v]).ravel()}) for v in range(depth)]
        return pd.concat(parts)

    return meet(queries, rows, kernel, "i long, j long, var_id int, d double")


def sbd_cube(queries: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """The symmetric form of sbd_table: of each pair the record with the smaller id is ahead, and the value holds for both orders."""

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b, low = series_rows(x.vec, depth), series_rows(y.vec, depth), x.id.to_numpy()[:, None] <= y.id.to_numpy()[None, :]
        d = [np.where(low, sbd(a[:, v], b[:, v]), sbd(b[:, v], a[:, v]).T) for v in range(depth)]
        return pd.concat([pd.DataFrame({"i": np.repeat(x.id.to_numpy(), len(y)), "j": np.tile(y.id.to_numpy(), len(x)), "var_id": v, "d": m.ravel()}) for v, m in enumerate(d)])

    return meet(queries, rows, kernel, "i long, j long, var_id int, d double")


def dtw_table(queries: DataFrame, rows: DataFrame, depth: int, measure: str = "euclidean", root: bool = True) -> DataFrame:
    """i, j, d: (root of) the warping cost of every query against every row."""

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = series_rows(x.vec, depth).swapaxes(1, 2), series_rows(y.vec, depth).swapaxes(1, 2)
        i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
        step = max(1, 2_000_000 // (a.shape[1] * b.shape[1] * depth))
        d = np.concatenate([dtw(a[i[k : k + step]], b[j[k : k + step]], measure) for k in range(0, len(i), step)])
        return pd.DataFrame({"i": x.id.to_numpy()[i], "j": y.id.to_numpy()[j], "d": np.sqrt(d) if root else d})

    return meet(queries, rows, kernel, "i long, j long, d double", rows=256)


def range_weights(rows: DataFrame, depth: int) -> DataFrame:
    """var_id, weight: share of each channel's range over all records in the sum of ranges."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = series_rows(f.vec, depth)
            yield pd.DataFrame({"var_id": np.arange(depth), "lo": x.min((0, 2)), "hi": x.max((0, 2)), "one": 1})

    r = rows.select("vec").mapInPandas(kernel, "var_id int, lo double, hi double, one int").groupBy("var_id").agg((F.max("hi") - F.min("lo")).alias("r"))
    total = r.agg(F.sum("r")).first()[0]
    return r.select("var_id", (F.col("r") / F.lit(total)).alias("weight"))


def memberships(distances: DataFrame, group: list[str]) -> DataFrame:
    """i, j (centre), *group, u: 1 / (sqrt(d) * sum over centres of sqrt(1 / (d + 1e-12)) + 1e-12); a centre belongs to itself only."""
    total = distances.groupBy("i", *group).agg(F.sum(F.sqrt(1 / (F.col("d") + 1e-12))).alias("s"), F.max((F.col("i") == F.col("j")).cast("int")).alias("own"))
    u = 1 / (F.sqrt("d") * F.col("s") + 1e-12)
    return distances.join(total, ["i", *group]).select("i", "j", *group, F.when(F.col("own") == 1, (F.col("i") == F.col("j")).cast("double")).otherwise(u).alias("u"))


def fuzzy_shape_warp(rows: DataFrame, centers: DataFrame, depth: int) -> DataFrame:
    """i, j, u: mean of the warping membership and the range-weighted shape memberships of each record to each centre."""
    c = rows.join(centers.select("id"), "id", "left_semi")
    shape = memberships(sbd_table(rows, c, depth), ["var_id"]).join(range_weights(rows, depth), "var_id").groupBy("i", "j").agg(F.sum(F.col("u") * F.col("weight")).alias("shape"))
    warp = memberships(dtw_table(rows, c, depth), []).withColumnRenamed("u", "warp")
    return shape.join(warp, ["i", "j"]).select("i", "j", ((F.col("shape") + F.col("warp")) / 2).alias("u"))


# -- partition clusterers over (id, vec) --------------------------------------------------------------------------------------


def k_means(rows: DataFrame, k: int, seed: int = 5) -> DataFrame:
    """id, cluster by MLlib."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = rows.select("id", array_to_vector("vec").alias("features"))
    return KMeans(k=k, seed=seed).fit(v).transform(v).select("id", F.col("prediction").cast("long").alias("cluster"))


def _picked(rows: DataFrame, k: int) -> np.ndarray:
    return np.stack([np.array(r.vec) for r in rows.orderBy(F.xxhash64("id")).limit(k).collect()])


def fuzzy_c_means(rows: DataFrame, k: int = 3, m: float = 2.0, rounds: int = 50, tol: float = 1e-5) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, u), centres. Each round is one pass of partial sums; only k centres travel."""
    centre = _picked(rows, k)

    def weight(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2) + 1e-18
        w = d ** (-1 / (m - 1))
        return w / w.sum(1, keepdims=True)

    for _ in range(rounds):
        c = centre

        def partial(frames: Iterator[pd.DataFrame], c: np.ndarray = c) -> Iterator[pd.DataFrame]:
            for f in frames:
                x = stack(f.vec)
                u = weight(x, c) ** m
                s = u.T @ x
                yield pd.DataFrame({"k": np.repeat(np.arange(len(c)), x.shape[1]), "i": np.tile(np.arange(x.shape[1]), len(c)), "s": s.ravel(), "u": np.repeat(u.sum(0), x.shape[1])})

        got = rows.select("vec").mapInPandas(partial, "k int, i int, s double, u double").groupBy("k", "i").agg((F.sum("s") / F.sum("u")).alias("c")).toPandas()  # k x length
        centre = np.zeros_like(c)
        centre[got.k, got.i] = got.c
        if np.abs(centre - c).max() < tol:
            break
    last = centre

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            u = weight(stack(f.vec), last)
            yield pd.DataFrame({"id": f.id, "cluster": u.argmax(1), "u": list(u)})

    return rows.select("id", "vec").mapInPandas(place, "id long, cluster long, u array<double>"), last


def _two_sided(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape distance over all lags, and the best lag, of rows x (n x d x L) to centres c (k x d x L)."""
    n, length = len(x), x.shape[2]
    size = 1 << (2 * length - 1).bit_length()
    fx, fc = np.fft.rfft(x, size), np.fft.rfft(c, size)
    best, lag = np.empty((n, len(c))), np.empty((n, len(c)), int)
    for k in range(len(c)):
        cc = np.fft.irfft((fx * np.conj(fc[k])).sum(1), size)
        cc = np.concatenate([cc[:, -(length - 1) :], cc[:, :length]], axis=1)
        at = cc.argmax(1)
        best[:, k], lag[:, k] = cc[np.arange(n), at], at - (length - 1)
    norm = np.sqrt((x**2).sum((1, 2)))[:, None] * np.sqrt((c**2).sum((1, 2)))[None, :]
    return 1 - best / np.where(norm > 0, norm, 1), lag


def _shifted(x: np.ndarray, lag: np.ndarray) -> np.ndarray:
    length = x.shape[-1]
    at = np.arange(length)[None, :] + lag[:, None]
    ok = (at >= 0) & (at < length)
    return np.where(ok[:, None, :], np.take_along_axis(x, np.clip(at, 0, length - 1)[:, None, :].repeat(x.shape[1], 1), 2), 0)


def _z_scaled(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(2, keepdims=True)) / np.maximum(x.std(2, keepdims=True), 1e-12)


def k_shape(rows: DataFrame, k: int, depth: int, seed: int = 5, rounds: int = 12, starts: int = 6) -> DataFrame:
    """id, cluster: shape-based clusters of series, z-scaled per channel. Assignment by the best lag, centres as leading eigenvectors of
    the aligned members' products, which are summed over all members before one small matrix per cluster and channel is solved. All
    starts share a pass per round; the one of the least total shape distance is kept (ties to the first)."""
    rng = np.random.default_rng(seed)
    first = _z_scaled(series_rows(pd.Series(list(_picked(rows, k * starts))), depth))
    length = first.shape[2]
    pick = [np.arange(k * s, k * s + k) if k * s + k <= len(first) else rng.permutation(len(first))[:k] for s in range(starts)]
    centres = [first[p] + 1e-3 * rng.standard_normal((len(p), depth, length)) for p in pick]
    live = list(range(starts))
    for _ in range(rounds):
        now = {s: centres[s] for s in live}

        def partial(frames: Iterator[pd.DataFrame], now: dict[int, np.ndarray] = now) -> Iterator[pd.DataFrame]:
            for f in frames:
                x = _z_scaled(series_rows(f.vec, depth))
                for s, c in now.items():
                    d, lag = _two_sided(x, c)
                    own = d.argmin(1)
                    for j in np.unique(own):
                        a = _z_scaled(_shifted(x[own == j], lag[own == j, j]))
                        for v in range(depth):
                            yield pd.DataFrame({"s": s, "k": int(j), "v": v, "i": np.arange(length), "row": list(a[:, v].T @ a[:, v])})

        cols = F.array(*(F.sum(F.col("row")[i]) for i in range(length)))
        got = rows.select("vec").mapInPandas(partial, "s int, k int, v int, i int, row array<double>").groupBy("s", "k", "v", "i").agg(cols.alias("row")).toPandas()  # starts x k x channels x L x L
        q = np.eye(length) - 1 / length
        for s in live:
            centres[s] = now[s].copy()
        for (s, j, v), g in got.groupby(["s", "k", "v"]):
            m = np.stack(g.sort_values("i").row.to_numpy())
            w = np.linalg.eigh(q @ m @ q)[1][:, -1]
            centres[s][j, v] = w if w @ now[s][j, v] >= 0 else -w
        live = [s for s in live if np.abs(centres[s] - now[s]).max() >= 1e-4]
        if not live:
            break

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = _z_scaled(series_rows(f.vec, depth))
            yield pd.DataFrame({"s": np.arange(starts), "d": [_two_sided(x, c)[0].min(1).sum() for c in centres]})

    sums = rows.select("vec").mapInPandas(total, "s int, d double").groupBy("s").agg(F.sum("d").alias("d")).toPandas()  # starts
    last = centres[int(sums.sort_values(["d", "s"]).s.iloc[0]) if len(sums) else 0]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f.id, "cluster": _two_sided(_z_scaled(series_rows(f.vec, depth)), last)[0].argmin(1)})

    return rows.select("id", "vec").mapInPandas(place, "id long, cluster long")


def common_basis(sigma: np.ndarray, share: float) -> np.ndarray:
    """Leading components of a summed covariance, at least two, until they hold the share of its energy."""
    value, vector = np.linalg.eigh(sigma)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    p = 2
    while p < len(value) and value[:p].sum() < share * value.sum():
        p += 1
    return vector[:, :p]


def _errors(x: np.ndarray, bases: list[np.ndarray]) -> np.ndarray:
    """Sum of absolute reconstruction errors of records (n x channels x steps) in each basis."""
    return np.stack([np.abs(np.einsum("de,nel->ndl", b @ b.T, x) - x).sum((1, 2)) for b in bases], axis=1)


def common_component_predict(rows: DataFrame, bases: list[np.ndarray], depth: int) -> DataFrame:
    """id, cluster: the basis that reconstructs each record best."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f.id, "cluster": _errors(series_rows(f.vec, depth), bases).argmin(1)})

    return rows.select("id", "vec").mapInPandas(place, "id long, cluster long")


def farthest_members(rows: DataFrame, labels: DataFrame, bases: list[np.ndarray], depth: int, n: int = 8) -> DataFrame:
    """cluster, rank (from 1), id, error: the n members of each cluster that its basis reconstructs worst, ties to the smaller id. Each
    task keeps its own n of a cluster before they are ranked."""
    from pyspark.sql import Window

    def worst(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"cluster": [], "id": [], "error": []}).astype({"cluster": "int64", "id": "int64", "error": float})
        for f in frames:
            e = _errors(series_rows(f.vec, depth), bases)[np.arange(len(f)), f.cluster.to_numpy()]
            held = pd.concat([held, pd.DataFrame({"cluster": f.cluster, "id": f.id, "error": e})]).sort_values(["cluster", "error", "id"], ascending=[True, False, True]).groupby("cluster").head(n)
        yield held

    best = rows.select("id", "vec").join(labels.select("id", "cluster"), "id").select("id", "vec", "cluster").mapInPandas(worst, "cluster long, id long, error double")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("error"), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= n).select("cluster", "rank", "id", "error")


def common_component_clusters(rows: DataFrame, k: int, depth: int, rounds: int = 30, tol: float = 1e-8) -> DataFrame:
    """id, cluster of common_component_fit."""
    return common_component_fit(rows, k, depth, rounds, tol)[0]


def common_component_fit(rows: DataFrame, k: int, depth: int, rounds: int = 30, tol: float = 1e-8) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, cluster), bases: each cluster has a basis from its members' summed covariances, and takes the records it reconstructs best. The
    first clusters are contiguous ranges of id, cut by rank."""
    rows = materialize(rows.select("id", "vec"), "components")
    cuts = rows.approxQuantile("id", [i / k for i in range(1, k)], 0.0) if k > 1 else []
    first = F.lit(0)
    for c in cuts:
        first = first + (F.col("id") > F.lit(int(c))).cast("int")
    label, before = rows.select("id", "vec", first.cast("long").alias("cluster")), None
    bases: list[np.ndarray] = []

    def sums(df: DataFrame, share: float) -> list[np.ndarray]:
        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                x = series_rows(f.vec, depth)
                c = x - x.mean(2, keepdims=True)
                cov = np.einsum("nil,njl->nij", c, c) / max(x.shape[2] - 1, 1)
                for j, g in f.groupby("cluster"):
                    s = cov[f.index.get_indexer(g.index)].sum(0)
                    yield pd.DataFrame({"cluster": int(j), "p": np.arange(s.size), "v": s.ravel()})

        got = df.mapInPandas(partial, "cluster long, p int, v double").groupBy("cluster", "p").agg(F.sum("v").alias("v")).toPandas()  # k x channels^2
        out = [bases[j] if bases else np.eye(depth)[:, : min(2, depth)] for j in range(k)]
        for j, g in got.groupby("cluster"):
            s = np.zeros(depth * depth)
            s[g.p] = g.v
            out[int(j)] = common_basis(s.reshape(depth, depth), share)
        return out

    for turn in range(rounds):
        bases = sums(label, 0.5 if turn == 0 else 0.8)
        now = bases

        def place(frames: Iterator[pd.DataFrame], now: list[np.ndarray] = now) -> Iterator[pd.DataFrame]:
            for f in frames:
                e = _errors(series_rows(f.vec, depth), now)
                yield pd.DataFrame({"id": f.id, "vec": f.vec, "cluster": e.argmin(1), "error": e.min(1)})

        placed = materialize(rows.mapInPandas(place, "id long, vec array<double>, cluster long, error double"), "placed")
        error = placed.agg(F.sum("error")).first()[0] or 0.0
        label = placed.drop("error")
        if before is not None and abs(error - before) < tol * max(1.0, abs(before)):
            break
        before = error
    return label.select("id", "cluster"), bases


# -- covariance components --------------------------------------------------------------------------------------------------


def covariance_features(cube: np.ndarray, width: int | None = None, stride: int | None = None) -> np.ndarray:
    """Packed covariance of each whole record, or of its windows end to end."""
    from chronoloom.operators.series import window_covariances

    w = width or cube.shape[2]
    c = packed(window_covariances(cube, w, stride or w))
    return c.reshape(len(c), -1)


def component_sequences(rows: DataFrame, depth: int, width: int, stride: int, percent: float = 95.0) -> tuple[DataFrame, int]:
    """(id, vec), k: each record's windows as packed covariances, projected to k components of all windows, channel after channel of
    the projected sequence; a warping distance of these compares records whose windows are shifted against each other."""
    from chronoloom.operators.features import energy_rank, fixed_sign
    from chronoloom.operators.series import window_covariances

    def windows(f: pd.DataFrame) -> np.ndarray:
        return packed(window_covariances(series_rows(f.vec, depth), width, stride))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = windows(f).reshape(-1, depth * (depth + 1) // 2)
            c = np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]])
            yield pd.DataFrame({"k": np.arange(len(c)), "v": c})

    p = depth * (depth + 1) // 2
    got = rows.select("vec").mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k").v.to_numpy()  # channels^4
    if not len(got):
        return rows.select("id", "vec"), 1
    n, mean = got[-1], got[p * p : p * p + p] / got[-1]
    value, vector = np.linalg.eigh(got[: p * p].reshape(p, p) / n - np.outer(mean, mean))
    basis = fixed_sign(vector[:, ::-1][:, : energy_rank(np.maximum(value[::-1], 0), percent)])

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            y = (windows(f) @ basis).swapaxes(1, 2)
            yield pd.DataFrame({"id": f.id, "vec": list(y.reshape(len(y), -1))})

    return rows.select("id", "vec").mapInPandas(project, "id long, vec array<double>"), basis.shape[1]


# -- hidden Markov models ---------------------------------------------------------------------------------------------------


def _log_gauss(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    out = np.empty((len(x), len(mean)))
    for k in range(len(mean)):
        low = np.linalg.cholesky(cov[k])
        z = np.linalg.solve(low, (x - mean[k]).T)
        out[:, k] = -0.5 * (z**2).sum(0) - np.log(np.diag(low)).sum() - 0.5 * d * np.log(2 * np.pi)
    return out


def _forward(logb: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    alpha, scale = np.empty_like(logb), np.empty(len(logb))
    top = logb.max(1)
    b = np.exp(logb - top[:, None])
    a = start * b[0]
    for t in range(len(logb)):
        if t:
            a = (alpha[t - 1] @ move) * b[t]
        scale[t] = max(a.sum(), 1e-300)
        alpha[t] = a / scale[t]
    return alpha, scale, float((np.log(scale) + top).sum())


def _log_likelihoods(logb: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """What _forward gives as its last value, for many records of equal length (records x steps x states) at once."""
    top = logb.max(2)
    b = np.exp(logb - top[:, :, None])
    alpha, total = start * b[:, 0], top.sum(1)
    for t in range(logb.shape[1]):
        if t:
            alpha = (alpha @ move) * b[:, t]
        scale = np.maximum(alpha.sum(1), 1e-300)
        alpha /= scale[:, None]
        total += np.log(scale)
    return total


class GaussHMM:
    """Gaussian hidden Markov model of one series (steps x channels), full covariances, fitted by expectation maximisation."""

    def __init__(self, x: np.ndarray, states: int = 5, rounds: int = 100, tol: float = 1e-2, seed: int = 0) -> None:
        d, rng = x.shape[1], np.random.default_rng(seed)
        states = min(states, len(x))
        floor = 1e-3 * np.eye(d) * max(1.0, x.var())
        self.mean = x[np.sort(rng.choice(len(x), states, replace=False))]
        self.cov = np.tile(np.atleast_2d(np.cov(x.T)) + floor, (states, 1, 1))
        self.start, self.move = np.full(states, 1 / states), np.full((states, states), 1 / states)
        last = -np.inf
        for _ in range(rounds):
            logb = _log_gauss(x, self.mean, self.cov)
            alpha, scale, ll = _forward(logb, self.start, self.move)
            b = np.exp(logb - logb.max(1)[:, None])
            beta = np.ones_like(alpha)
            for t in range(len(x) - 2, -1, -1):
                beta[t] = self.move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
            g = alpha * beta
            g /= g.sum(1, keepdims=True)
            xi = np.einsum("ti,ij,tj->ij", alpha[:-1], self.move, b[1:] * beta[1:] / scale[1:, None])
            self.start = g[0]
            self.move = (xi + 1e-6) / (xi + 1e-6).sum(1, keepdims=True)
            weight = g.sum(0) + 1e-6
            self.mean = (g.T @ x) / weight[:, None]
            for k in range(states):
                c = x - self.mean[k]
                self.cov[k] = (g[:, k, None] * c).T @ c / weight[k] + floor
            if abs(ll - last) < tol:
                break
            last = ll

    def score(self, x: np.ndarray) -> float:
        return _forward(_log_gauss(x, self.mean, self.cov), self.start, self.move)[2]

    def score_all(self, x: np.ndarray) -> np.ndarray:
        """score of every record (records x steps x channels)."""
        logb = _log_gauss(x.reshape(-1, x.shape[2]), self.mean, self.cov).reshape(*x.shape[:2], -1)
        return _log_likelihoods(logb, self.start, self.move)


def hmm_likelihoods(rows: DataFrame, models: DataFrame, depth: int, states: int = 5, rounds: int = 100) -> DataFrame:
    """i (model of record i), j, ll: mean log-likelihood per step of record j under the model fitted to record i."""
    import pickle

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = series_rows(f.vec, depth).swapaxes(1, 2)
            yield pd.DataFrame({"id": f.id, "vec": [pickle.dumps(GaussHMM(s, states, rounds)) for s in x]})

    fitted = materialize(models.select("id", "vec").repartition("id").mapInPandas(fit, "id long, vec binary"), "models")

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        import pickle

        data = series_rows(y.vec, depth).swapaxes(1, 2)
        parts = []
        for i, m in zip(x.id, x.vec, strict=True):
            model = pickle.loads(m)  # noqa: S301
            parts.append(pd.DataFrame({"i": i, "j": y.id.to_numpy(), "ll": model.score_all(data) / data.shape[1]}))
        return pd.concat(parts)

    return meet(fitted, rows.select("id", "vec"), kernel, "i long, j long, ll double", rows=512)


def likelihood_distances(ll: DataFrame) -> DataFrame:
    """i, j, d: symmetrised gap of likelihoods, (ll_ii - ll_ij + ll_jj - ll_ji) / 2 for i < j; at least 0."""
    own = ll.filter("i = j").select("i", F.col("ll").alias("own"))
    a = ll.join(own, "i").select("i", "j", (F.col("own") - F.col("ll")).alias("gap")).filter("i <> j")
    return a.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.greatest(F.sum("gap") / 2, F.lit(0.0)).alias("d")).select(F.col("a").alias("i"), F.col("b").alias("j"), "d")


def likelihood_divergence(ll: DataFrame, times: int = 1) -> DataFrame:
    """i, j, d (times as much: the form that adds it up twice has times=2) of the row-normalised form p_ik = ll_ik / sum_k ll_ik (p_ii from 1): sum over k of p_i log(p_i / p_j) + p_j log(p_j / p_i); null
    where a ratio is not positive."""
    flat = ll.withColumn("ll", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("ll")))
    p = flat.join(flat.groupBy("i").agg(F.sum("ll").alias("z")), "i").select("i", F.col("j").alias("k"), (F.col("ll") / F.col("z")).alias("p"))
    q = p.select(F.col("i").alias("j"), "k", F.col("p").alias("q"))
    ratio = F.col("p") / F.col("q")
    term = F.when(ratio > 0, F.col("p") * F.log(ratio) - F.col("q") * F.log(ratio))
    return p.join(q, "k").filter("i < j").groupBy("i", "j").agg(F.when(F.count(term) == F.count("*"), F.sum(term) * times).alias("d"))
