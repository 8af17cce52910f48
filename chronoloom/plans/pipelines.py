"""The whole path of one dataset: series to precision sequences, embeddings, clusters by several methods, scores on the test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import density, shapes
from chronoloom.operators.distances import distance_percentile, points
from chronoloom.operators.features import embed
from chronoloom.operators.precision import precision_sequences
from chronoloom.operators.scores import contingency, scores
from chronoloom.operators.series import by_dataset, ragged
from chronoloom.storage import materialize


def embeddings(samples: DataFrame, channels: DataFrame, hyper: DataFrame) -> DataFrame:
    """sample_id, dataset, emb, split, label of prepared samples."""
    feats = materialize(precision_sequences(samples, channels, hyper).select("sample_id", "dataset", "feature"), "features")
    return materialize(embed(feats, hyper).join(samples.select("sample_id", "split", "label"), "sample_id"), "embedded")


def filled_vectors(samples: DataFrame, channels: DataFrame) -> tuple[DataFrame, int]:
    """(id, vec), channels: the filled series of one dataset's samples, channel after channel."""
    import pyarrow as pa

    def kernel(cube, par, ids):  # noqa: ANN001, ANN202
        return [pa.array(ids, pa.int64()), ragged(cube.reshape(len(ids), -1))]

    depth = channels.join(samples.select("dataset").distinct(), "dataset").select("var_id").distinct().count()
    return materialize(by_dataset(samples, channels, channels.select("dataset").distinct(), kernel, "id long, vec array<double>"), "filled"), depth


def compared(samples: DataFrame, channels: DataFrame, hyper: DataFrame, percent: float = 8.0, seed: int = 5) -> DataFrame:
    """method, n, rand_index, adjusted_rand, nmi, csm on the labelled test rows of one dataset (hyper: its one row): clusters at
    several radii with labels carried over to the nearest row, clusters at one radius, k-means, shape-based clusters of the series."""
    par = hyper.first()
    rows = points(embeddings(samples, channels, hyper), "sample_id", "emb", "split", "label")
    rows = materialize(rows, "rows")
    k = max(rows.filter("label is not null").select("label").distinct().count(), 2)
    several = density.MultiDensity(par.k_nearest, par.diff_threshold, par.slope_threshold, par.k_dis_low, par.k_dis_high).fit(rows)
    whole, depth = filled_vectors(samples, channels)
    asked = rows.filter("split = 'test'")
    found = {
        "several radii": several.predict(asked),
        "one radius": density.dbscan(rows.select("id", "vec"), distance_percentile(rows, percent), 3).select("id", "cluster"),
        "k-means": shapes.k_means(rows, k, seed),
        "k-shape": shapes.k_shape(whole, k, depth, seed),
    }
    out = None
    for method, clusters in found.items():
        both = asked.filter("label is not null").select("id", "label").join(clusters, "id")
        one = scores(contingency(both, "cluster", "label")).select(F.lit(method).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return out
