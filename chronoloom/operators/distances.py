"""Distances between all records of a set, in blocks, without building the matrix.

Rows are cut into B blocks by hash and pairs of blocks meet in tasks of bounded size (an equi-join on the pair of block numbers).
What leaves a task is already reduced: the k nearest, the neighbours within a radius, sums per cluster, or counts per bin of
distance. Where a set meets itself (meet_self), only pairs of blocks with the first not after the second meet: the distances
are made once and handed to the kernel from both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block; a meeting holds two. Few rows are cut finer, so that they keep SPREAD blocks busy.
ROWS, SPREAD = 2_048, 8
#: Cells of the part of a distance matrix that is worked on at once: it stays in the processor's cache.
PART = 65_536


def _by_dimension(a: np.ndarray, b: np.ndarray, add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Sums over the dimensions of add(difference), row against row, one dimension of a part of the matrix at a time."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    out = np.zeros((len(a), len(b)))
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    step = max(1, PART // max(1, len(b)))
    gap = np.empty((min(step, len(a)), len(b)))
    for k in range(0, len(a), step):
        part = out[k : k + step]
        g = gap[: len(part)]
        for x, y in zip(at, bt, strict=True):
            np.subtract(x[k : k + step, None], y, out=g)
            add(part, g)
    return out


def _add_size(part: np.ndarray, g: np.ndarray) -> None:
    np.abs(g, out=g)
    part += g


def _add_square(part: np.ndarray, g: np.ndarray) -> None:
    np.multiply(g, g, out=g)
    part += g


def l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L1 distances of all rows of a to all rows of b."""
    return _by_dimension(a, b, _add_size)


def l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_by_dimension(a, b, _add_square))


METRICS = {"l1": l1, "l2": l2}


def points(df: DataFrame, key: str, vector: str, *others: str) -> DataFrame:
    """id, vec (double array) and the other columns; rows with null key or vector, or null or NaN in it, are left out."""
    vec = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), vec.alias("vec"), *others).filter(ok)


def block_rows(n: int, rows: int) -> int:
    """Rows of a block of n: at most `rows`, fewer where that would leave less than SPREAD blocks."""
    return max(1, min(rows, max(64, -(-n // SPREAD))))


def _hashed(df: DataFrame, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)))


def _columns(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(", ")]


def meet(left: DataFrame, right: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, group: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """kernel(rows of left, rows of right) for every pair of blocks, within each group. Both sides: id, vec, ..."""
    group = group or []
    sizes = [df.count() for df in (left, right)]
    n_left, n_right = (max(1, -(-n // block_rows(n, rows))) for n in sizes)
    other = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    a = other(_hashed(left, n_left, "_a"), n_right, "_b")
    b = other(_hashed(right, n_right, "_b"), n_left, "_a")
    columns = _columns(schema)

    # The right side gets names of its own: both may come from one table, whose columns the cogroup would then confuse.
    names = b.columns
    b = b.toDF(*(f"r_{c}" for c in names))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y.columns = names
        return kernel(x, y) if len(x) and len(y) else pd.DataFrame({c: [] for c in columns})

    keys = [*group, "_a", "_b"]
    return a.groupBy(*keys).cogroup(b.groupBy(*(f"r_{c}" for c in keys))).applyInPandas(run, schema)


def meet_self(table: DataFrame, metric: str, kernel: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, rows: int = ROWS) -> DataFrame:
    """kernel(x, y, distances of x to y) for every ordered pair of blocks of one table (id, vec, ...). Each unordered pair of blocks
    meets once: a row is copied to the pairs its block is in, and the distances serve both orders."""
    f = METRICS[metric]
    n = table.count()
    blocks = max(1, -(-n // block_rows(n, rows)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    placed = _hashed(table, blocks, "_own").withColumn("_other", every)
    placed = placed.withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other")}).drop("_other")
    columns = _columns(schema)

    def run(both: pd.DataFrame) -> pd.DataFrame:
        first = both._own.to_numpy() == both._a.to_numpy()
        x = both[first].sort_values("id").drop(columns=["_own", "_a", "_b"]).reset_index(drop=True)
        if both._a.iloc[0] == both._b.iloc[0]:
            v = stack(x.vec)
            return kernel(x, x, f(v, v))
        y = both[~first].sort_values("id").drop(columns=["_own", "_a", "_b"]).reset_index(drop=True)
        if not len(x) or not len(y):
            return pd.DataFrame({c: [] for c in columns})
        d = f(stack(x.vec), stack(y.vec))
        return pd.concat([kernel(x, y, d), kernel(y, x, d.T)])

    return placed.groupBy("_a", "_b").applyInPandas(run, schema)


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def all_pairs(metric: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A kernel that gives i, j, d of all pairs of two blocks."""
    f = METRICS[metric]

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d = f(stack(x.vec), stack(y.vec))
        return pd.DataFrame({"i": np.repeat(x.id.to_numpy(), len(y)), "j": np.tile(y.id.to_numpy(), len(x)), "d": d.ravel()})

    return kernel


def distances_from(queries: DataFrame, rows: DataFrame, metric: str = "l1") -> DataFrame:
    """i, j, d of every query against every row. For a bounded set of queries; the result has queries x rows."""
    return meet(queries, rows, all_pairs(metric), "i long, j long, d double")


def within(rows: DataFrame, eps: float, metric: str = "l1", strict: bool = False) -> DataFrame:
    """i, j, d of all ordered pairs within eps, each row with itself among them."""

    def kernel(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(d < eps if strict else d <= eps)
        return pd.DataFrame({"i": x.id.to_numpy()[i], "j": y.id.to_numpy()[j], "d": d[i, j]})

    return meet_self(rows.select("id", "vec"), metric, kernel, "i long, j long, d double")


def _k_smallest(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of y (ordered by id) of each row of x; ties to the smaller id."""
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    i, j = np.nonzero(np.isfinite(dist))
    return pd.DataFrame({"i": x.id.to_numpy()[i], "j": y.id.to_numpy()[near[i, j]], "d": dist[i, j]})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).filter(F.col("rank") <= k).select("i", "rank", "j", "d")


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "l1") -> DataFrame:
    """i, rank (from 1), j, d: the k nearest rows of each query, ties to the smaller id."""
    f = METRICS[metric]

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("id")
        return _k_smallest(x, y, f(stack(x.vec), stack(y.vec)), k)

    return _ranked(meet(queries, rows, kernel, "i long, j long, d double"), k)


def nearest_within(rows: DataFrame, k: int, metric: str = "l1") -> DataFrame:
    """The same of every row among all rows, itself among them."""
    return _ranked(meet_self(rows.select("id", "vec"), metric, lambda x, y, d: _k_smallest(x, y, d, k), "i long, j long, d double"), k)


def k_distances(rows: DataFrame, k: int, metric: str = "l1") -> DataFrame:
    """id, k_dis: distance of the k-th nearest row, the row itself being number 0."""
    return nearest_within(rows, k + 1, metric).filter(F.col("rank") == k + 1).select(F.col("i").alias("id"), F.col("d").alias("k_dis"))


#: Bits of a distance that are left out of its bin in the passes of distance_percentile. Positive doubles are ordered as their bits.
SHIFTS = (46, 26, 0)


def distance_percentile(rows: DataFrame, percent: float, metric: str = "l1") -> float:
    """Linearly interpolated percentile of the distances other than 0 of all ordered pairs, exact, without keeping them: three passes
    count them per bin, a bin being the leading bits of the number (64 bins an octave, then 2^20 in each of these, then the
    numbers themselves); only the bins that hold one of the two ranks are opened in the next pass."""
    ranks: dict[int, tuple[int, int]] = {}  # rank -> (bin it is in, rank inside this bin)
    want = 0.0
    for turn, shift in enumerate(SHIFTS):
        inside = np.unique([b for b, _ in ranks.values()])
        above = SHIFTS[turn - 1]

        def kernel(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray, shift: int = shift, inside: np.ndarray = inside, above: int = above) -> pd.DataFrame:
            bits = d[d > 0].view(np.int64)
            if len(inside):
                bits = bits[np.isin(bits >> above, inside)]
            bins, n = np.unique(bits >> shift, return_counts=True)
            return pd.DataFrame({"bin": bins, "n": n})

        found = meet_self(rows.select("id", "vec"), metric, kernel, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()  # occupied bins
        bins, n = found.bin.to_numpy(np.int64), found.n.to_numpy(np.int64)
        if turn == 0:
            total = int(n.sum())
            if not total:
                return float("nan")
            want = (total - 1) * percent / 100
            ranks = {int(k): (0, int(k)) for k in (np.floor(want), np.ceil(want))}
        fresh = {}
        for k, (outer, rest) in ranks.items():
            mine = np.ones(len(bins), bool) if turn == 0 else bins >> (above - shift) == outer
            cum = np.cumsum(n[mine])
            at = int(np.searchsorted(cum, rest, side="right"))
            fresh[k] = int(bins[mine][at]), rest - int(cum[at - 1] if at else 0)
        ranks = fresh
    low, high = (float(np.int64(ranks[int(k)][0]).view(np.float64)) for k in (np.floor(want), np.ceil(want)))
    return float(low + (high - low) * (want - np.floor(want)))
