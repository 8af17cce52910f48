"""Connected components over tables of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.storage import materialize_measured, release


def _forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """u, v: for the nodes of each batch of edges the smallest node they reach inside the batch, so that a batch leaves at most one edge
    for each of its nodes."""
    for f in frames:
        nodes, at = np.unique(np.concatenate([f.u.to_numpy(), f.v.to_numpy()]), return_inverse=True)
        a, b = at[: len(f)], at[len(f) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
            if (root == before).all():
                break
        some = root != np.arange(len(nodes))
        yield pd.DataFrame({"u": nodes[some], "v": nodes[root[some]]})


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reached) for the nodes of the edges (a, b), by alternating large-star and small-star steps: a
    few rounds of shuffles whatever the length of the chains, with partial minima before each shuffle. Batches of edges are replaced by
    forests of their nodes first."""
    print_of = {"rows": F.count("*"), "digest": F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))}
    once = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e, before = materialize_measured(once.mapInPandas(_forests, "u long, v long").distinct().mapInPandas(_forests, "u long, v long").distinct(), "stars", **print_of)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least(F.min("v"), F.first("u"))
        large = both.join(both.groupBy("u").agg(low.alias("m")), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        fresh = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        fresh, after = materialize_measured(fresh, "stars", **print_of)
        release(e)
        e = fresh
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
