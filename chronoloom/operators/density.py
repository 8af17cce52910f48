"""Density-based clustering: one radius, several radii found on the k-distance curve, density peaks.

Neighbourhoods come from the blocked meetings of distances; numbering of clusters, border points and ties follow the usual rules: a
core point has at least min_samples points within eps, itself counted; clusters are numbered in the order of their first core
point; a border point belongs to the lowest-numbered cluster among its core neighbours; the rest is noise, -1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.distances import METRICS, k_distances, meet, meet_self, nearest, nearest_within, stack, within
from chronoloom.operators.graphs import components
from chronoloom.storage import materialize, materialize_measured, release


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with the place of each row in the order, from 0: rows are parted into ranges, the sizes of the ranges before are added to
    the ranks inside, so that no task sorts all of them."""
    part = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    part = materialize(part, "ranges")
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n")).drop("_n")  # one row per range
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return part.withColumn("_r", inner).join(before, "_p").withColumn(out, (F.col("_r") + F.col("_before")).cast("long")).drop("_p", "_r", "_before")


def dbscan(rows: DataFrame, eps: float, min_samples: int, metric: str = "l1") -> DataFrame:
    """id, cluster, is_core. rows: id, vec."""
    links = materialize(within(rows, eps, metric), "links")
    core = links.groupBy("i").agg(F.count("*").alias("n")).filter(F.col("n") >= min_samples).select(F.col("i").alias("id"))
    a, b = core.withColumnRenamed("id", "i"), core.withColumnRenamed("id", "j")
    comp = components(links.join(a, "i").join(b, "j").select(F.col("i").alias("a"), F.col("j").alias("b")))
    owner = core.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    heads = owner.select("comp").distinct()
    number = numbered(heads, ["comp"], "cluster")
    named = owner.join(number, "comp").select("id", "cluster")
    border = links.join(named.withColumnRenamed("id", "j"), "j").groupBy("i").agg(F.min("cluster").alias("near")).withColumnRenamed("i", "id")
    out = rows.select("id").join(named, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("cluster", "near", F.lit(-1)).cast("long").alias("cluster"), F.col("cluster").isNotNull().alias("is_core"))


def dbscan_predict(queries: DataFrame, rows: DataFrame, labels: DataFrame, eps: float, metric: str = "l1") -> DataFrame:
    """id, cluster: that of the first core point (by id) closer than eps, else -1."""
    f = METRICS[metric]
    core = rows.join(labels.filter("is_core"), "id").select("id", "vec", "cluster")

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("id")
        close = f(stack(x.vec), stack(y.vec)) < eps
        first = close.argmax(1)
        some = close.any(1)
        return pd.DataFrame({"id": x.id.to_numpy()[some], "core": y.id.to_numpy()[first[some]], "cluster": y.cluster.to_numpy()[first[some]]})

    hit = meet(queries.select("id", "vec"), core, kernel, "id long, core long, cluster long").groupBy("id").agg(F.min_by("cluster", "core").alias("cluster"))
    return queries.select("id").join(hit, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


#: Places of the curve that are compared at once.
CURVE_PART = 1_000_000


def turning_points(curve: np.ndarray, diff: float, slope: float) -> list[int]:
    """Places of the sorted curve where an interval splits into two of nearly equal, small slopes. Every interval is split where
    the slopes to both of its ends differ least (the first such place), whether or not the place is accepted."""
    found, todo = [], [(0, len(curve) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a <= 1:
            continue
        if curve[a] == curve[b]:  # level, so that each split is at the second place of what is left
            if diff > 0 and slope > 0:
                found += range(a + 1, b, 2)
            continue
        at, gap, left, right = a + 1, np.inf, 0.0, 0.0
        for start in range(a + 1, b, CURVE_PART):
            k = np.arange(start, min(start + CURVE_PART, b))
            lefts, rights = (curve[k] - curve[a]) / (k - a), (curve[b] - curve[k]) / (b - k)
            gaps = np.abs(lefts - rights)
            m = int(gaps.argmin())
            if gaps[m] < gap:
                at, gap, left, right = int(k[m]), gaps[m], lefts[m], rights[m]
        if gap < diff and abs(left) < slope and abs(right) < slope:
            found.append(at)
        todo += [(a, at - 1), (at + 1, b)]
    return sorted(found)


def radii(curve: np.ndarray, diff: float, slope: float, low: float, high: float, portion: float = 0.3) -> list[float]:
    """Radii at the turning points, thinned to one per `portion` of their range, strictly between low and high."""
    points = turning_points(curve, diff, slope)
    if not points:
        return []
    reach = (points[-1] - points[0]) * portion
    kept, start, run = [points[0]], points[0], 0
    for before, p in zip(points, points[1:], strict=False):
        run += p - before
        if run > reach:
            kept.append(int(start + (p - start) * 0.8))
            start, run = p, 0
    return sorted(float(curve[k]) for k in kept if low < curve[k] < high)


def curve_table(rows: DataFrame, k: int, metric: str = "l1") -> DataFrame:
    """rank, id, k_dis: the sorted k-distance curve, ranked in value ranges, so that no task sorts it as a whole."""
    return numbered(materialize(k_distances(rows, k, metric), "kdist"), ["k_dis", "id"], "rank").select("rank", "id", "k_dis")


def multi_density(rows: DataFrame, k: int, diff: float, slope: float, low: float, high: float, min_samples: int | None = None, metric: str = "l1") -> DataFrame:
    """id, cluster, is_noise: clusters of the smallest radius first, then of what is left at the next one. Codes are dense; noise, if
    there is any, is code 0, as is usual for categories with a lowest member -1. The curve's values are searched on the driver,
    all of them: 8 bytes per row."""
    n = rows.count()
    curve = curve_table(rows, k, metric)
    values = curve.orderBy("rank").select("k_dis").toArrow()["k_dis"].to_numpy()
    need = min_samples if min_samples is not None else (4 if n == 80 else 3)
    left, parts, scraps = rows.select("id", "vec"), [], []
    for number, r in enumerate(radii(values, diff, slope, low, high)):
        found = materialize(dbscan(left, r, need, metric), "density")
        parts.append(found.filter("cluster >= 0").select("id", F.lit(number).alias("pass"), "cluster"))
        left = materialize(left.join(found.filter("cluster = -1").select("id"), "id"), "left")
        scraps += [found, left]
        if left.isEmpty():
            break
    rest = left.select("id", F.lit(-1).alias("pass"), F.lit(-1).cast("long").alias("cluster"))
    every = rest
    for p in parts:
        every = every.unionByName(p)
    every = materialize(every, "clusters")
    for t in scraps:
        release(t)
    codes = numbered(every.select("pass", "cluster").distinct(), ["pass", "cluster"], "code")
    return every.join(codes, ["pass", "cluster"]).select("id", F.col("code").cast("long").alias("cluster"), (F.col("pass") == -1).alias("is_noise"))


def nearest_label(queries: DataFrame, rows: DataFrame, labels: DataFrame, metric: str = "l1") -> DataFrame:
    """id, cluster of the nearest labelled row (ties to the smaller id)."""
    return nearest(queries.select("id", "vec"), rows.select("id", "vec"), 1, metric).join(labels.select(F.col("id").alias("j"), "cluster"), "j").select(F.col("i").alias("id"), "cluster")


class MultiDensity:
    """Clusters at several radii, fitted on one set of rows and carried over to others: each takes the cluster of the nearest row."""

    def __init__(self, k: int, diff: float, slope: float, low: float = 1e-12, high: float = 1e12, min_samples: int | None = None, metric: str = "l1") -> None:
        self.how, self.metric = (k, diff, slope, low, high, min_samples, metric), metric

    def fit(self, rows: DataFrame) -> "MultiDensity":
        self.rows = materialize(rows.select("id", "vec"), "fitted")
        self.labels = materialize(multi_density(self.rows, *self.how), "fitted")
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """id, cluster."""
        return nearest_label(rows, self.rows, self.labels, self.metric)

    def fit_predict(self, rows: DataFrame) -> DataFrame:
        return self.fit(rows).labels


class DensityPeaks:
    """Density peaks over rows (id, vec). rho: gauss (sum of exp(-(d / dc)^2) over all points), count (points nearer than dc), nearest
    (from the mean distance of the nearest 5 %)."""

    def __init__(self, rows: DataFrame, metric: str = "l1", dc: float | None = None, percent: float = 1.0, rho: str = "gauss") -> None:
        self.rows, self.metric, self.n = rows.select("id", "vec"), metric, rows.count()
        self.dc = dc if dc is not None else self.cutoff(percent)
        self.rho = materialize(self._rho(rho), "rho")

    def _pairs(self, kernel, schema: str, table: DataFrame | None = None) -> DataFrame:
        return meet_self(self.rows if table is None else table, self.metric, kernel, schema)

    def cutoff(self, percent: float, tries: int = 10) -> float:
        """Bisection for a distance below which lie percent to percent + 1 per cent of the unordered pairs; at most `tries` steps,
        each one pass that counts."""

        def most(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"m": [d.max()]})

        lo, hi = 0.0, self._pairs(most, "m double").agg(F.max("m")).first()[0] or 0.0
        dc = hi / 2
        for _ in range(tries):
            dc = (lo + hi) / 2

            def below(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray, dc: float = dc) -> pd.DataFrame:
                return pd.DataFrame({"n": [int(((d < dc) & (x.id.to_numpy()[:, None] < y.id.to_numpy()[None, :])).sum())]})

            share = (self._pairs(below, "n long").agg(F.sum("n")).first()[0] or 0) / max((self.n - 1) ** 2 / 2, 1)
            if percent / 100 <= share <= (percent + 1) / 100:
                break
            lo, hi = (lo, dc) if share > (percent + 1) / 100 else (dc, hi)
        return dc

    def _rho(self, kind: str) -> DataFrame:
        dc = self.dc
        if kind == "nearest":
            k = int(self.n * 0.05)
            near = nearest_within(self.rows, max(k, 1), self.metric).groupBy("i").agg(F.sum("d").alias("s"))
            return near.select(F.col("i").alias("id"), F.exp(-F.col("s") / max(k - 1, 1)).alias("rho"))

        def kernel(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"id": x.id.to_numpy(), "rho": np.exp(-((d / dc) ** 2)).sum(1) if kind == "gauss" else (d < dc).sum(1).astype(float)})

        out = self._pairs(kernel, "id long, rho double").groupBy("id").agg(F.sum("rho").alias("rho"))
        return out if kind == "gauss" else out.withColumn("rho", F.col("rho") - 1)

    def delta(self, strict: bool = False) -> DataFrame:
        """id, rho, delta, link: distance to the nearest denser point, and that point. Of points of equal density the one with the
        larger id is the denser; the densest gets the largest delta and links to itself. strict: only greater densities are
        denser, and each point without a denser one gets the largest of its own distances and links to itself."""
        dense = self.rows.join(self.rho, "id")

        def kernel(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
            a, b = x.rho.to_numpy()[:, None], y.rho.to_numpy()[None, :]
            higher = b > a if strict else (b > a) | ((b == a) & (y.id.to_numpy()[None, :] > x.id.to_numpy()[:, None]))
            near = np.where(higher, d, np.inf)
            at = near.argmin(1)
            best = near[np.arange(len(x)), at]
            none = ~np.isfinite(best)
            return pd.DataFrame({"id": x.id.to_numpy(), "near": pd.arrays.FloatingArray(np.where(none, 0, best), none), "link": pd.arrays.IntegerArray(y.id.to_numpy()[at].astype(np.int64), none), "far": d.max(1)})

        found = self._pairs(kernel, "id long, near double, link long, far double", dense)
        best = found.groupBy("id").agg(F.min(F.when(F.col("link").isNotNull(), F.struct(F.col("near").alias("delta"), "link"))).alias("m"), F.max("far").alias("far")).select("id", "m.*", "far")
        top = F.col("far") if strict else F.lit(best.agg(F.max("delta")).first()[0])
        return self.rho.join(best, "id").select("id", "rho", F.coalesce("delta", top, F.lit(0.0)).alias("delta"), F.coalesce("link", "id").alias("link"))

    def centers(self, n: int) -> DataFrame:
        """The n points with the largest rho * delta (ties to the smaller id)."""
        return self.delta().withColumn("gamma", F.col("rho") * F.col("delta")).orderBy(F.desc("gamma"), "id").limit(n)

    def assign(self, n: int) -> DataFrame:
        """id, center, by following links to denser points until a centre is met: pointer doubling, log(length of chain) rounds."""
        step = self.delta().select("id", "link").join(self.centers(n).select("id", F.lit(True).alias("c")), "id", "left")
        step = materialize(step.select("id", F.when(F.col("c"), F.col("id")).otherwise(F.col("link")).alias("link")), "chain")
        while True:
            far = step.select(F.col("id").alias("link"), F.col("link").alias("next"))
            fresh, got = materialize_measured(step.join(far, "link").select("id", F.col("next").alias("link"), (F.col("next") != F.col("link")).alias("moved")), "chain", moved=F.count_if("moved"))
            step = fresh.drop("moved")
            if not got["moved"]:
                return step.select("id", F.col("link").alias("center"))

    def halo(self, assigned: DataFrame) -> DataFrame:
        """id, center, is_core: points at least as dense as the densest border point of their cluster (one with a foreign point
        closer than dc); all points of a cluster without a border."""
        dc = self.dc

        def kernel(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
            near = (d < dc) & (x.center.to_numpy()[:, None] != y.center.to_numpy()[None, :])
            return pd.DataFrame({"id": x.id.to_numpy()[near.any(1)]})

        border = self._pairs(kernel, "id long", self.rows.join(assigned, "id")).distinct()
        limit = border.join(assigned, "id").join(self.rho, "id").groupBy("center").agg(F.max("rho").alias("limit"))
        return assigned.join(self.rho, "id").join(limit, "center", "left").select("id", "center", (F.col("limit").isNull() | (F.col("rho") >= F.col("limit"))).alias("is_core"))
