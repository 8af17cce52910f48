"""Sparse precision matrices that vary slowly over the windows of a series.

For each window, given its neighbours: minimise -logdet X + tr(S X) + beta |X|_1 + 3 lamb |X|^2 + lamb <B, X>, with
B = X[t+2] - 4 X[t+1] - 4 X[t-1] + X[t-2] (missing neighbours are 0), by ADMM from a cold start; windows in turn, until max_updates
window updates are spent. A window's solution depends only on its covariance and its four neighbours, so samples are solved
together as stacked matrices, converged ones leave the stack, and windows whose neighbours have not moved keep their solution.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.series import by_dataset, packed, ragged, unpacked_symmetric, window_covariances
from chronoloom.storage import materialize

#: Neighbours that moved less than this leave a window's solution alone; the solver's own tolerance is coarser.
STILL = 1e-5


def prox_logdet(s: np.ndarray, a: np.ndarray, eta: np.ndarray | float) -> np.ndarray:
    """argmin -logdet X + tr(S X) + eta/2 |X - A|^2 for stacked matrices."""
    d, q = np.linalg.eigh(eta * a - s)
    eta = np.asarray(eta)[..., 0] if np.ndim(eta) else eta
    # (d + sqrt(d^2 + 4 eta)) / (2 eta), without cancellation where d is negative.
    root = np.sqrt(d * d + 4 * eta)
    value = np.where(d > 0, (d + root) / (2 * eta), 2 / np.maximum(root - d, 1e-300))
    return (q * value[..., None, :]) @ q.swapaxes(-1, -2)


def balanced(rho: np.ndarray, primal: np.ndarray, _: np.ndarray, dual: np.ndarray, __: np.ndarray) -> np.ndarray:
    """Step sizes that keep both residuals within a factor of 5 of each other."""
    return rho * np.where(primal > 5 * dual, 2.0, np.where(dual > 5 * primal, 0.5, 1.0))


def local_losses(s: np.ndarray, x: np.ndarray, b: np.ndarray, lamb: float, beta: float) -> np.ndarray:
    """Objective of one window's problem for stacked packed solutions x, and its smooth part: -logdet X + tr(S X) + 3 lamb |X|^2 + lamb
    <B, X>, all over packed entries but the first two terms."""
    full = unpacked_symmetric(x, s.shape[-1])
    sign, logdet = np.linalg.slogdet(full)
    fit = np.einsum("nij,nji->n", s, full) - np.where(sign > 0, logdet, np.log(1e-8))
    smooth = fit + 3 * lamb * (x * x).sum(1) + lamb * (b * x).sum(1)
    return np.stack([smooth + beta * np.abs(x).sum(1), smooth], axis=1)


def admm(s: np.ndarray, b: np.ndarray, lamb: float, beta: float, most: int = 1000, tol: float = 1e-6, rho_update=balanced, watch=None) -> np.ndarray:
    """Packed solutions for stacked covariances s (n x d x d) and packed neighbour terms b (n x p). Each problem has its own step
    size, from 1; rho_update(rho, primal, its limit, dual, its limit) gives the next ones (None: they stay). watch(turn, local losses of
    the problems that are not solved yet), if given, is called in every turn."""
    n, d = len(s), s.shape[-1]
    p = b.shape[1]
    out = np.zeros((n, p))
    live, z, u, rho = np.arange(n), np.zeros((n, p)), np.zeros((n, p)), np.ones(n)
    norm = lambda m: np.sqrt((m * m).sum(1))
    for turn in range(most):
        x = packed(prox_logdet(s[live], unpacked_symmetric(z - u, d), rho[:, None, None]))
        r = rho[:, None]
        v = r * (x + u) - lamb * b[live]
        old, z = z, np.sign(v) * np.maximum(np.abs(v) - beta, 0) / (r + 6 * lamb)
        u = u + x - z
        out[live] = x
        if watch is not None:
            watch(turn, local_losses(s[live], x, b[live], lamb, beta))
        if turn == 0:
            continue
        primal, dual = norm(x - z), rho * norm(z - old)
        limit = np.sqrt(p) * tol + 1e-4
        most_x, most_u = limit + tol * np.maximum(norm(x), norm(z)), limit + tol * rho * norm(u)
        keep = ~((primal <= most_x) & (dual <= most_u))
        if rho_update is not None and turn % 4 == 0 and turn <= most // 3:  # then fixed, so that it converges
            fresh = rho_update(rho, primal, most_x, dual, most_u)
            u, rho = u * (rho / fresh)[:, None], fresh
        if not keep.all():
            live, z, u, rho = live[keep], z[keep], u[keep], rho[keep]
            if not len(live):
                break
    return out


def neighbour_term(theta: np.ndarray, t: int) -> np.ndarray:
    b = np.zeros_like(theta[:, 0])
    for step, weight in ((2, 1.0), (1, -4.0), (-1, -4.0), (-2, 1.0)):
        if 0 <= t + step < theta.shape[1]:
            b += weight * theta[:, t + step]
    return b


def descend(cov: np.ndarray, lamb: float, beta: float, max_updates: int, admm_steps: int = 1000, init: str = "zero", rho_update=balanced) -> np.ndarray:
    """Packed precision sequences (n x windows x p) for covariances (n x windows x d x d). init: zero, or inverse (of the
    covariance, with 1e-12 on the diagonal where it is singular)."""
    n, w, d = cov.shape[:3]
    theta = np.zeros((n, w, d * (d + 1) // 2))
    if init == "inverse":
        for k in np.ndindex(n, w):
            try:
                theta[k] = packed(np.linalg.inv(cov[k]))
            except np.linalg.LinAlgError:
                try:
                    theta[k] = packed(np.linalg.inv(cov[k] + 1e-12 * np.eye(d)))
                except np.linalg.LinAlgError:  # a constant channel: 1e-12 is lost beside the other entries
                    theta[k] = packed(np.linalg.pinv(cov[k]))
    if not n or not w:
        return theta
    seen = np.full_like(theta, np.inf)
    for k in range(max_updates):
        t = k % w
        b = neighbour_term(theta, t)
        todo = np.flatnonzero(np.abs(b - seen[:, t]).max(1) > STILL)
        if len(todo):
            theta[todo, t] = admm(cov[todo, t], b[todo], lamb, beta, admm_steps, rho_update=rho_update)
            seen[todo, t] = b[todo]
            idle = 0
        else:
            idle = idle + 1 if k else 1
            if idle >= w:
                break
    return theta


def losses(cov: np.ndarray, theta: np.ndarray, lamb: float, beta: float) -> np.ndarray:
    """Per sample: log-likelihood with tr(S X), the same with the sum of S_ii X_ii, penalty, loss, number of parameters."""
    d = cov.shape[-1]
    full = unpacked_symmetric(theta, d)
    sign, logdet = np.linalg.slogdet(full + 0.0)
    logdet = np.where(sign > 0, logdet, np.log(1e-8))
    trace = np.einsum("nwij,nwji->nw", cov, full)
    elementwise = np.einsum("nwii,nwii->nw", cov, full)
    second = np.zeros(len(theta))
    if theta.shape[1] > 2:
        step = full[:, 2:] + full[:, :-2] - 2 * full[:, 1:-1]
        second = (step**2).sum((1, 2, 3))
    penalty = beta * np.abs(full).sum((1, 2, 3)) + lamb * second
    ll = (logdet - trace).sum(1)
    return np.stack([ll, (logdet - elementwise).sum(1), penalty, penalty - ll, np.full(len(theta), float(theta[0].size if len(theta) else 0))], axis=1)


def scalar_precision(s: np.ndarray | float, lamb: float, beta: float, b: float = 0.0) -> np.ndarray | float:
    """The one-variable solution: the positive root of 6 lamb x^2 + (s + beta + lamb b) x - 1."""
    q = s + beta + lamb * b
    return (-q + np.sqrt(q * q + 24 * lamb)) / (12 * lamb) if lamb > 0 else 1 / q


def precision_sequences(rows: DataFrame, channels: DataFrame, hyper: DataFrame, init: str | None = None, rho_update=balanced) -> DataFrame:
    """sample_id, dataset, feature (windows end to end, each a packed precision matrix), ll, ll_elementwise, penalty, loss, n_params.
    init: what a sequence starts from, zero or inverse (of the covariances); by default inverse where maxiters is 0, so that the start is
    the result, else zero. Rows are written and spread evenly first, by ranges of dataset and sample: the solver's work does not depend on where the data lay, records of
    one dataset come together, and the larger the stack the cheaper each record. The number of tasks is given, since the size of
    the rows says nothing about the work they make."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kernel(cube: np.ndarray, par: dict, ids: np.ndarray) -> list[pa.Array]:
        cov = window_covariances(cube, par["width"], par["stride"])
        start = init or ("zero" if par["maxiters"] else "inverse")
        theta = descend(cov, par["lamb"], par["beta"], par["maxiters"], par["maxiters_admm"], start, rho_update)
        score = losses(cov, theta, par["lamb"], par["beta"])
        return [pa.array(ids, pa.int64()), pa.array([par["dataset"]] * len(ids)), ragged(theta.reshape(len(ids), -1)), *(pa.array(score[:, k]) for k in range(5))]

    cols = ["dataset", "width", "stride", "lamb", "beta", "maxiters", "maxiters_admm"]
    schema = "sample_id long, dataset string, feature array<double>, ll double, ll_elementwise double, penalty double, loss double, n_params double"
    rows = materialize(rows, "prepared")  # the ranges are found by a sample, for which the rows are not to be made twice
    return by_dataset(rows.repartitionByRange(tasks, "dataset", "sample_id"), channels, hyper.select(*cols), kernel, schema)


def summed_losses(sequences: DataFrame) -> DataFrame:
    """dataset, n_samples and the sums of the losses; n_params is that of one sample, since all samples of a dataset have as many."""
    total = (F.sum(c).alias(c) for c in ("ll", "ll_elementwise", "penalty", "loss"))
    return sequences.groupBy("dataset").agg(F.count("*").alias("n_samples"), *total, F.max("n_params").alias("n_params"))
