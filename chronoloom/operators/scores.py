"""Scores of clusterings from the contingency table, which is one partial aggregation; the rest is arithmetic on its cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.distances import meet_self


def contingency(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """cluster, label, n; a null on either side counts as a value of its own."""
    return df.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def _margins(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return table.groupBy("cluster").agg(F.sum("n").alias("n")), table.groupBy("label").agg(F.sum("n").alias("n"))


def scores(table: DataFrame) -> DataFrame:
    """One row: n, rand_index, adjusted_rand, nmi (arithmetic mean), csm (1/K sum over clusters of the best 2 n_ij / (n_i + n_j)).
    A table without rows gives nulls; a single pair of classes counts as full agreement."""
    rows, cols = _margins(table)
    total = table.agg(F.sum("n").alias("n"), F.sum(_pairs(F.col("n"))).alias("both"), F.sum(F.col("n") * F.log("n")).alias("hij"))
    side = lambda t, s: t.agg(F.sum(_pairs(F.col("n"))).alias(f"p{s}"), F.sum(F.col("n") * F.log("n")).alias(f"h{s}"), F.count("*").alias(f"k{s}"))
    best = table.join(rows.withColumnRenamed("n", "ni"), table.cluster.eqNullSafe(rows.cluster)).drop(rows.cluster).join(cols.withColumnRenamed("n", "nj"), table.label.eqNullSafe(cols.label)).drop(cols.label)
    csm = best.groupBy("cluster").agg(F.max(2 * F.col("n") / (F.col("ni") + F.col("nj"))).alias("b")).agg(F.avg("b").alias("csm"))
    one = F.lit(1).alias("_k")
    out = total.select("*", one)
    for t in (side(rows, "a"), side(cols, "b"), csm):
        out = out.join(t.select("*", one), "_k")  # single rows
    n, pa, pb, both = F.col("n"), F.col("pa"), F.col("pb"), F.col("both")
    ha, hb = F.log(n) - F.col("ha") / n, F.log(n) - F.col("hb") / n
    mutual = ha + hb - (F.log(n) - F.col("hij") / n)
    expected = pa * pb / _pairs(n)
    spread = (pa + pb) / 2 - expected
    return out.select(
        "n",
        F.when(n > 1, (_pairs(n) + 2 * both - pa - pb) / _pairs(n)).alias("rand_index"),
        F.when(n > 1, F.when(spread == 0, F.lit(1.0)).otherwise((both - expected) / spread)).alias("adjusted_rand"),
        F.when((ha + hb) > 1e-12, 2 * mutual / (ha + hb)).otherwise(F.when(n > 0, F.lit(1.0))).alias("nmi"),
        "csm",
    )


def best_assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row with the least total cost (square matrix): shortest augmenting paths with potentials."""
    n = len(cost)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        col, slack, way, used = 0, np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[col]:
            used[col] = True
            row = owner[col]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reduced < slack[1:])
            slack[1:][better], way[1:][better] = reduced[better], col
            col_next = int(np.where(used[1:], np.inf, slack[1:]).argmin()) + 1
            step = slack[col_next]
            u[owner[used]] += step
            v[used] -= step
            slack[1:][~used[1:]] -= step
            col = col_next
        while col:
            owner[col] = owner[way[col]]
            col = way[col]
    out = np.empty(n, int)
    out[owner[1:] - 1] = np.arange(n)
    return out


def accuracy(table: DataFrame, most: int = 2_000) -> float:
    """Share of rows in the best one-to-one matching of clusters and labels; the table's K x K cells (K at most `most`) are
    matched on the driver."""
    cells = table.limit(most * most + 1).toPandas()
    if not len(cells):
        return float("nan")
    a, b = pd.factorize(cells.cluster, use_na_sentinel=False)[0], pd.factorize(cells.label, use_na_sentinel=False)[0]
    k = max(a.max(), b.max()) + 1
    if k > most:
        raise ValueError(f"{k} classes: more than {most}")
    m = np.zeros((k, k))
    m[a, b] = cells.n
    return float(m[np.arange(k), best_assignment(m.max() - m)].sum() / m.sum())


def evaluation(table: DataFrame) -> DataFrame:
    """One row: rand_index, nmi, accuracy."""
    return scores(table).select("rand_index", "nmi", F.lit(accuracy(table)).alias("accuracy"))


def silhouette(rows: DataFrame, metric: str = "l1") -> DataFrame:
    """id, cluster, s for rows (id, vec, cluster): mean distance to the nearest other cluster against that to its own; 0 for a
    point alone in its cluster. Distances leave a task as sums per point and cluster."""

    def kernel(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        names, at = np.unique(y.cluster.to_numpy(), return_inverse=True)
        one = np.zeros((len(y), len(names)))
        one[np.arange(len(y)), at] = 1
        sums = d @ one
        return pd.DataFrame({"id": np.repeat(x.id.to_numpy(), len(names)), "other": np.tile(names, len(x)), "total": sums.ravel()})

    sums = meet_self(rows.select("id", "vec", "cluster"), metric, kernel, "id long, other long, total double").groupBy("id", "other").agg(F.sum("total").alias("total"))
    sizes = rows.groupBy(F.col("cluster").alias("other")).agg(F.count("*").alias("n"))
    own = F.col("other") == F.col("cluster")
    per = rows.select("id", "cluster").join(sums, "id").join(sizes, "other")
    a = F.max(F.when(own, F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1))))
    b = F.min(F.when(~own, F.col("total") / F.col("n")))
    ab = per.groupBy("id", "cluster").agg(a.alias("a"), b.alias("b"))
    return ab.select("id", "cluster", F.coalesce(F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")), F.lit(0.0)).alias("s"))


def information_criterion(n: Column, parameters: Column, likelihood: Column) -> Column:
    """0.15 * P * ln(n) - 2 ln(LL); null where LL is not positive."""
    return F.when(likelihood > 0, 0.15 * parameters * F.log(n) - 2 * F.log(likelihood))
