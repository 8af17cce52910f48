"""Hyper-parameter search as one data-parallel job: configurations are rows, features are solved once per distinct solver setting."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.distances import distance_percentile, points
from chronoloom.operators.density import dbscan
from chronoloom.operators.features import embed
from chronoloom.operators.precision import precision_sequences
from chronoloom.operators.scores import contingency, scores, silhouette
from chronoloom.operators.shapes import k_means

# The grid of the search.
GRID = {"width": [5, 10, 16, 20, 32, 40], "stride": [5, 10, 16, 20, 32, 40], "lamb": [1e-3, 1e-2, 1e-1], "beta": [1e-3, 1e-2, 1e-1], "energy": [10, 20, 50]}


def config_grid(spark: SparkSession, grid: dict[str, list] | None = None) -> DataFrame:
    """All combinations with width >= stride, numbered; the values are a fixed, short list."""
    grid = grid or GRID
    rows = [(n, *map(float, c)) for n, c in enumerate(product(*grid.values()))]
    df = spark.createDataFrame(rows, "config_id long, " + ", ".join(f"{k} double" for k in grid))
    return df.filter("width >= stride")


def trial(samples: DataFrame, channels: DataFrame, hyper: DataFrame, label: str = "label") -> list[DataFrame]:
    """Scores of one configuration (hyper: one row per dataset): dataset, method, rand_index, nmi, silhouette."""
    from chronoloom.storage import materialize

    feats = materialize(precision_sequences(samples, channels, hyper), "features")
    emb = materialize(embed(feats, hyper).join(samples.select("sample_id", label), "sample_id"), "embedded")
    out = []
    for (name,) in hyper.select("dataset").collect():  # one row per dataset
        rows = points(emb.filter(F.col("dataset") == name), "sample_id", "emb", label)
        k = rows.filter(F.col(label).isNotNull()).select(label).distinct().count()
        found = {"k_means": k_means(rows, max(k, 2)), "dbscan": dbscan(rows, distance_percentile(rows, 8.0), 3).select("id", "cluster")}
        for method, clusters in found.items():
            both = rows.join(clusters, "id")
            width = silhouette(both).agg(F.avg("s").alias("silhouette"))
            score = scores(contingency(both.filter(F.col(label).isNotNull()), "cluster", label))
            out.append(score.select(F.lit(name).alias("dataset"), F.lit(method).alias("method"), "rand_index", "nmi", F.lit(1).alias("_k")).join(width.withColumn("_k", F.lit(1)), "_k").drop("_k"))
    return out


def best_configs(trials: DataFrame, metric: str, largest: bool = True) -> DataFrame:
    """The configuration with the best metric, ties to the smaller config_id."""
    order = F.struct(F.col(metric) if largest else -F.col(metric), -F.col("config_id"))
    return trials.filter(F.col(metric).isNotNull()).agg(F.max_by("config_id", order).alias("config_id"), (F.max(metric) if largest else F.min(metric)).alias(metric))
