"""Queries of the series operators and their SQL: cleaning, scaling, windows, covariances, features, precision matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import distances, features, precision, series
from chronoloom.operators.tuning import config_grid as make_grid
from chronoloom.plans.cleaning import CELLS_SQL
from chronoloom.storage import materialize, table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return series.prepared(table(spark, d, "samples"), table(spark, d, "channels"))


def _scaled(*steps):
    def query(spark: SparkSession, d: str) -> DataFrame:
        long = series.channels_long(_rows(spark, d), *steps)
        return long.withColumn("value", F.round("value", 6) + F.lit(0.0))

    return query


def label_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = series.first_rows(table(spark, d, "samples"), "dataset", "label_name")
    return series.encoded(rows, "label_name", "code", ("dataset",)).select("sample_id", F.col("code").cast("long").alias("code"))


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    rows = series.first_rows(table(spark, d, "samples"), "dataset", "label").filter("dataset is not null and label is not null")
    return series.stratified(rows, "sample_id", ["dataset", "label"], 0.5).select("sample_id", "in_part")


def _windows(cube, par, ids):
    import numpy as np
    import pyarrow as pa

    start = series.window_starts(cube.shape[2], par["width"], par["stride"])
    view = np.lib.stride_tricks.sliding_window_view(cube, par["width"], axis=2)[:, :, start].sum(-1) if len(start) else np.zeros((len(ids), cube.shape[1], 0))
    n, v, w = view.shape
    return [pa.array(np.repeat(ids, v * w), pa.int64()), pa.array(np.tile(np.repeat(np.arange(v, dtype=np.int32), w), n)), pa.array(np.tile(np.arange(w, dtype=np.int32), n * v)), pa.array(view.ravel())]


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sum of each channel in each window of its dataset's width and stride."""
    hyper = table(spark, d, "hyper_parameters").select("dataset", "width", "stride")
    out = series.by_dataset(_rows(spark, d), table(spark, d, "channels"), hyper, _windows, "sample_id long, var_id int, win_id int, total double")
    return out.withColumn("total", F.round("total", 6) + F.lit(0.0))


def window_cov(spark: SparkSession, d: str) -> DataFrame:
    """Packed covariances of the windows, one row per entry."""
    out = series.window_covariance_rows(_rows(spark, d), table(spark, d, "channels"), table(spark, d, "hyper_parameters"))
    return out.select("sample_id", "win_id", F.posexplode("cov").alias("idx", "cov")).withColumn("cov", F.round("cov", 4) + F.lit(0.0))


def scalar_precision(spark: SparkSession, d: str) -> DataFrame:
    """Closed-form precision of each channel taken alone over its whole length."""
    import numpy as np
    import pyarrow as pa

    def kernel(cube, par, ids):
        s = cube.var(axis=2, ddof=1)
        theta = precision.scalar_precision(s, par["lamb"], par["beta"])
        n, v = s.shape
        return [pa.array(np.repeat(ids, v), pa.int64()), pa.array(np.tile(np.arange(v, dtype=np.int32), n)), pa.array(theta.ravel())]

    out = series.by_dataset(_rows(spark, d), table(spark, d, "channels"), table(spark, d, "hyper_parameters").select("dataset", "lamb", "beta"), kernel, "sample_id long, var_id int, theta double")
    return out.withColumn("theta", F.round("theta", 6) + F.lit(0.0))


def _features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ctrans").filter("sample_id is not null and c_feat is not null")
    once = rows.groupBy("sample_id").agg(F.min_by(F.struct("dataset", "c_feat"), F.struct("computed_at")).alias("r"))
    return once.select("sample_id", "r.dataset", F.transform("r.c_feat", lambda x: x.cast("double")).alias("feature"))


def feature_l2_norm(spark: SparkSession, d: str) -> DataFrame:
    out = features.normalised(_features(spark, d))
    return out.select("sample_id", F.posexplode("feature").alias("f_id", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


def feature_cov(spark: SparkSession, d: str) -> DataFrame:
    return features.covariance(_features(spark, d)).select("dataset", "i", "j", (F.round("cov", 6) + F.lit(0.0)).alias("cov"))


def feature_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Features to embeddings by energy-limited components."""
    return features.embed(_features(spark, d), table(spark, d, "hyper_parameters"))


def embedding_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances between embeddings that keep all components, of the samples whose id is divisible by 20 to all of their dataset: they are
    those of the scaled features."""
    hyper = table(spark, d, "hyper_parameters").select("dataset", F.lit(200.0).alias("cumulativeenergysaving"))
    emb = materialize(features.embed(_features(spark, d), hyper), "embedded")
    rows = emb.select(F.col("sample_id").alias("id"), "dataset", F.col("emb").alias("vec"))
    found = distances.meet(rows.filter("id % 20 = 0"), rows, distances.all_pairs("l2"), "i long, j long, d double", ["dataset"])
    return found.withColumn("d", F.round("d", 5) + F.lit(0.0))


def feature_transform(spark: SparkSession, d: str) -> DataFrame:
    """Components fitted on the training samples, applied to the others."""
    which = series.first_rows(table(spark, d, "samples"), "split").filter("split is not null")
    rows = materialize(_features(spark, d).join(which, "sample_id"), "features")
    fitted = features.Embedder(table(spark, d, "hyper_parameters")).fit(rows.filter("split = 'train'"))
    return fitted.transform(rows.filter("split <> 'train'"))


def precision_start(spark: SparkSession, d: str) -> DataFrame:
    """Sums of losses per dataset of sequences without iterations: the inverses of the covariances."""
    hyper = table(spark, d, "hyper_parameters").withColumn("maxiters", F.lit(0))
    out = precision.precision_sequences(_rows(spark, d), table(spark, d, "channels"), hyper)
    return precision.summed_losses(out)


def precision_sequence(spark: SparkSession, d: str) -> DataFrame:
    """The whole feature extraction: windows, covariances, precision sequences, with their losses."""
    return precision.precision_sequences(_rows(spark, d), table(spark, d, "channels"), table(spark, d, "hyper_parameters"))


def precision_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Precision sequences to embeddings."""
    feats = materialize(precision_sequence(spark, d).select("sample_id", "dataset", "feature"), "features")
    return features.embed(feats, table(spark, d, "hyper_parameters"))


def config_grid(spark: SparkSession, d: str) -> DataFrame:
    return make_grid(spark).select("width", "stride", "lamb", "beta", "energy")


QUERIES = {
    "series_long": _scaled(),
    "fill_na": _scaled(series.fill_forward_back),
    "minmax": _scaled(series.scale_min_max),
    "znorm": _scaled(series.scale_z),
    "series_l2": _scaled(series.scale_l2),
    **{f.__name__: f for f in (label_encode, stratified_split, sliding_windows, window_cov, scalar_precision, feature_l2_norm, feature_cov, feature_embedding, embedding_distances, feature_transform, precision_start, precision_sequence, precision_embedding, config_grid)},
}

SPAN = "(PARTITION BY sample_id, var_id)"
#: Values on the whole grid of channels and steps: forward, then backward filled, else 0.
FILLED_SQL = f"""{CELLS_SQL},
grid AS (SELECT o.sample_id, o.dataset, k.var_id, unnest(range(k.series_len))::INT AS t FROM once o JOIN channels k USING (dataset) WHERE o.series IS NOT NULL),
open_grid AS (SELECT g.*, r.val FROM grid g LEFT JOIN read r ON r.sample_id = g.sample_id AND r.var_id = g.var_id AND r.pos = g.t),
filled AS (SELECT sample_id, dataset, var_id, t, coalesce(last_value(val IGNORE NULLS) OVER (PARTITION BY sample_id, var_id ORDER BY t ROWS UNBOUNDED PRECEDING),
           first_value(val IGNORE NULLS) OVER (PARTITION BY sample_id, var_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM open_grid)"""
WINDOWS_SQL = """
wins AS (SELECT f.*, h.stride, unnest(range(greatest(0, ceil((t - width + 1) / stride)::INT), least((k.series_len - width) // stride, t // stride) + 1)) AS win_id
         FROM filled f JOIN hyper_parameters h USING (dataset) JOIN (SELECT dataset, max(series_len) AS series_len FROM channels GROUP BY 1) k USING (dataset) WHERE k.series_len >= width)"""

FEATURES_SQL = """
feats AS (SELECT DISTINCT ON (sample_id) sample_id, dataset, c_feat FROM ctrans WHERE c_feat IS NOT NULL ORDER BY sample_id, computed_at),
fl AS (SELECT sample_id, dataset, unnest(range(len(c_feat)))::INT AS f_id, unnest(c_feat)::DOUBLE AS v FROM feats)"""

ORACLE = {
    "series_long": f"WITH {CELLS_SQL} SELECT sample_id, var_id, pos AS t, round(val, 6) + 0.0 AS value FROM read",
    "fill_na": f"""WITH {CELLS_SQL} SELECT sample_id, var_id, pos AS t, round(coalesce(last_value(val IGNORE NULLS) OVER (PARTITION BY sample_id, var_id ORDER BY pos ROWS UNBOUNDED PRECEDING),
first_value(val IGNORE NULLS) OVER (PARTITION BY sample_id, var_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS value FROM read""",
    "minmax": f"""WITH {CELLS_SQL} SELECT sample_id, var_id, pos AS t, round(CASE WHEN max(val) OVER {SPAN} <> min(val) OVER {SPAN}
THEN (val - min(val) OVER {SPAN}) / (max(val) OVER {SPAN} - min(val) OVER {SPAN}) ELSE val - min(val) OVER {SPAN} END, 6) + 0.0 AS value FROM read""",
    "znorm": f"""WITH {CELLS_SQL} SELECT sample_id, var_id, pos AS t, round((val - avg(val) OVER {SPAN}) / CASE WHEN stddev_pop(val) OVER {SPAN} > 0 THEN stddev_pop(val) OVER {SPAN} ELSE 1 END, 6) + 0.0 AS value FROM read""",
    "series_l2": f"""WITH {CELLS_SQL} SELECT sample_id, var_id, pos AS t, round(val / CASE WHEN sum(val * val) OVER {SPAN} > 0 THEN sqrt(sum(val * val) OVER {SPAN}) ELSE 1 END, 6) + 0.0 AS value FROM read""",
    "label_encode": """WITH once AS (SELECT DISTINCT ON (sample_id) sample_id, dataset, lower(trim(label_name)) AS w FROM samples ORDER BY sample_id, loaded_at)
SELECT sample_id, CASE WHEN w IS NOT NULL THEN dense_rank() OVER (PARTITION BY dataset, w IS NULL ORDER BY w) - 1 END AS code FROM once""",
    "stratified_split": """WITH once AS (SELECT DISTINCT ON (sample_id) sample_id, dataset, label FROM samples ORDER BY sample_id, loaded_at)
SELECT sample_id, row_number() OVER (PARTITION BY dataset, label ORDER BY (sample_id * 2654435761) % 4294967296, sample_id) <= floor(0.5 * count(*) OVER (PARTITION BY dataset, label)) AS in_part
FROM once WHERE dataset IS NOT NULL AND label IS NOT NULL""",
    "sliding_windows": f"WITH {FILLED_SQL}, {WINDOWS_SQL} SELECT sample_id, var_id, win_id::INT AS win_id, round(sum(v), 6) + 0.0 AS total FROM wins GROUP BY ALL",
    "window_cov": f"""WITH {FILLED_SQL}, {WINDOWS_SQL}, dims AS (SELECT dataset, count(*) AS d FROM channels GROUP BY 1)
SELECT a.sample_id, a.win_id::INT AS win_id, (a.var_id * d - a.var_id * (a.var_id - 1) // 2 + b.var_id - a.var_id)::INT AS idx, round(covar_samp(a.v, b.v), 4) + 0.0 AS cov
FROM wins a JOIN wins b ON a.sample_id = b.sample_id AND a.win_id = b.win_id AND a.t = b.t AND a.var_id <= b.var_id JOIN dims ON dims.dataset = a.dataset GROUP BY a.sample_id, a.win_id, a.var_id, b.var_id, d""",
    "scalar_precision": f"""WITH {FILLED_SQL}, s AS (SELECT sample_id, dataset, var_id, var_samp(v) AS s FROM filled GROUP BY ALL)
SELECT sample_id, var_id, round((-(s + beta) + sqrt((s + beta) * (s + beta) + 24 * lamb)) / (12 * lamb), 6) + 0.0 AS theta FROM s JOIN hyper_parameters USING (dataset)""",
    "feature_l2_norm": f"""WITH {FEATURES_SQL}, n AS (SELECT dataset, f_id, sqrt(sum(v * v)) AS n FROM fl GROUP BY ALL)
SELECT sample_id, f_id, round(CASE WHEN n > 0 THEN v / n ELSE 0 END, 6) + 0.0 AS value FROM fl JOIN n USING (dataset, f_id)""",
    "feature_cov": f"""WITH {FEATURES_SQL} SELECT a.dataset, a.f_id AS i, b.f_id AS j, round(covar_samp(a.v, b.v), 6) + 0.0 AS cov
FROM fl a JOIN fl b ON a.sample_id = b.sample_id AND a.f_id <= b.f_id GROUP BY ALL""",
    "embedding_distances": f"""WITH {FEATURES_SQL}, n AS (SELECT dataset, f_id, sqrt(sum(v * v)) AS n FROM fl GROUP BY ALL),
s AS (SELECT sample_id, dataset, f_id, CASE WHEN n > 0 THEN v / n ELSE 0 END AS v FROM fl JOIN n USING (dataset, f_id))
SELECT a.sample_id AS i, b.sample_id AS j, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 5) + 0.0 AS d FROM s a JOIN s b USING (dataset, f_id) WHERE a.sample_id % 20 = 0 GROUP BY ALL""",
    "config_grid": """SELECT w::DOUBLE AS width, s::DOUBLE AS stride, l::DOUBLE AS lamb, b::DOUBLE AS beta, e::DOUBLE AS energy
FROM unnest([5, 10, 16, 20, 32, 40]) a(w), unnest([5, 10, 16, 20, 32, 40]) c(s), unnest([0.001, 0.01, 0.1]) f(l), unnest([0.001, 0.01, 0.1]) g(b), unnest([10, 20, 50]) h(e) WHERE w >= s""",
}
