"""Queries that write a collection in the layout of its files, read it back with the reader of the layout, and hand on what came, so that
readers and sinks run over whole tables and can be compared with the tables themselves; and the whole path of a synthetic set."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import density, series
from chronoloom.plans import pipelines
from chronoloom.sources import readers, sinks, synthetic
from chronoloom.storage import materialize, shared_dir, table

#: The set of the whole path: length, samples and channels; its solver's parameters are those of SYNTHETIC.
SET, WIDTH = "Fake_96_60_4", 10
SYNTHETIC = {"width": WIDTH, "stride": WIDTH, "lamb": 5e-3, "beta": 5e-3, "maxiters": 80, "maxiters_admm": 300, "cumulativeenergysaving": 50, "k_nearest": 5, "diff_threshold": 0.01, "slope_threshold": 0.05, "k_dis_low": 1e-12, "k_dis_high": 1e12}


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def source_arff(spark: SparkSession, d: str) -> DataFrame:
    """All labelled samples as one relational ARFF collection, read again: position, class code and cells of each."""
    rows = series.first_rows(table(spark, d, "samples"), "split", "series", "label_name").withColumn("label_name", F.lower(F.trim("label_name")))
    rows = materialize(rows.filter("series is not null and label_name is not null"), "samples")
    folder = _folder(spark)
    for split in ("train", "test"):
        sinks.arff_rows(rows.filter(F.col("split") == split), f"{folder}/All/All_{split.upper()}.arff", "sample_id")
    got = readers.arff_dataset(spark, folder, "All")
    held = F.filter(F.flatten("series"), lambda x: x.isNotNull())
    total = F.round(F.aggregate(held, F.lit(0.0), lambda s, x: s + x), 3) + F.lit(0.0)
    return got.select(F.col("sample_id").alias("pos"), "split", "label_name", F.col("label").cast("long").alias("label"), F.size("series").cast("long").alias("n_channels"), F.size(held).cast("long").alias("n_held"), total.alias("total"))


def source_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The parameter file, written and read again."""
    names = {c.split()[0].lower(): c.split()[0] for c in readers.PARAMETER_SCHEMA.split(", ")}
    path = f"{_folder(spark)}/parameters"
    sinks.csv_table(table(spark, d, "hyper_parameters").select(*(F.col(k).alias(v) for k, v in names.items())), path)
    return readers.parameters(spark, path).withColumnRenamed("cumulativeenergysaving", "energy")


def _point_set(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark)}/points"
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").alias("num"))
    rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").drop("vec_id").write.csv(path, sep="\t", header=True)
    return readers.point_set(spark, path)


def point_peaks(spark: SparkSession, d: str) -> DataFrame:
    """A set of points in the plane, written, read, and divided by density peaks: point, class, centre."""
    rows = materialize(_point_set(spark, d), "points")
    return density.DensityPeaks(rows, "l2", dc=0.02).assign(6).join(rows.select("id", "num"), "id")


def cached_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table by way of the cache that is keyed by its parameters: made once, read the second time."""
    folder = _folder(spark)
    for _ in range(2):
        out = sinks.cached(spark, folder, "label_targets", lambda: table(spark, d, "label_targets"), source=d, version=1)
    return out


def synthetic_set(spark: SparkSession, d: str) -> DataFrame:
    """Figures of a synthetic set per class and channel: samples, steps, mean and deviation."""
    rows = synthetic.named_set(spark, SET)
    cells = rows.select("label", F.posexplode("series").alias("var_id", "x")).select("label", "var_id", F.size("x").alias("n_steps"), F.explode("x").alias("v"))
    return cells.groupBy("label", "var_id").agg((F.count("*") / F.max("n_steps")).cast("long").alias("n_samples"), F.max("n_steps").cast("long").alias("n_steps"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def compared_methods(spark: SparkSession, d: str) -> DataFrame:
    """The whole path of a synthetic set: precision sequences, embeddings, clusters by four methods, scores on the test rows."""
    length, n, depth = (int(x) for x in SET.split("_")[1:4])
    samples = materialize(synthetic.as_samples(readers.resplit(synthetic.named_set(spark, SET)), SET), "synthetic")
    channels = synthetic.flat_channels(spark, SET, depth, length)
    hyper = spark.createDataFrame([(SET, *SYNTHETIC.values())], "dataset string, width int, stride int, lamb double, beta double, maxiters int, maxiters_admm int, cumulativeenergysaving int, k_nearest int, diff_threshold double, slope_threshold double, k_dis_low double, k_dis_high double")
    return pipelines.compared(series.prepared(samples, channels), channels, hyper)


QUERIES = {f.__name__: f for f in (source_arff, source_parameters, point_peaks, cached_rows, synthetic_set, compared_methods)}

ORACLE = {
    "source_arff": """WITH once AS (SELECT DISTINCT ON (sample_id) sample_id, split, series, lower(trim(label_name)) AS label_name FROM samples ORDER BY sample_id, loaded_at),
r AS (SELECT *, list_filter(flatten(list_transform(series, lambda c: coalesce(c, []))), lambda x: x IS NOT NULL AND NOT isnan(x)) AS held FROM once WHERE series IS NOT NULL AND label_name IS NOT NULL AND split IN ('train', 'test'))
SELECT row_number() OVER (ORDER BY split = 'test', sample_id) - 1 AS pos, split, label_name, dense_rank() OVER (ORDER BY label_name) - 1 AS label, len(series) AS n_channels, len(held) AS n_held, round(coalesce(list_sum(held), 0), 3) + 0.0 AS total FROM r""",
    "source_parameters": """SELECT dataset, width, stride, lamb, beta, diff_threshold, slope_threshold, maxiters, dimension_reduce, cumulativeenergysaving AS energy, k_nearest, k_dis_low, k_dis_high, maxiters_admm FROM hyper_parameters""",
    "cached_rows": "SELECT * FROM label_targets",
    "point_peaks": """WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS num FROM embeddings),
dist AS MATERIALIZED (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM e a, e b),
rho AS MATERIALIZED (SELECT i AS id, sum(exp(-(d / 0.02) * (d / 0.02))) AS rho FROM dist GROUP BY i),
up AS (SELECT a.id, min(d.d) AS delta, arg_min(b.id, {'d': d.d, 'j': b.id}) AS link FROM rho a JOIN dist d ON d.i = a.id JOIN rho b ON b.id = d.j WHERE b.rho > a.rho OR (b.rho = a.rho AND b.id > a.id) GROUP BY a.id),
delta AS (SELECT rho.id, rho.rho, coalesce(delta, (SELECT max(delta) FROM up)) AS delta FROM rho LEFT JOIN up USING (id)),
centers AS (SELECT id FROM delta ORDER BY rho * delta DESC, id LIMIT 6),
link AS MATERIALIZED (SELECT rho.id, CASE WHEN rho.id IN (SELECT id FROM centers) THEN rho.id ELSE coalesce(up.link, rho.id) END AS link FROM rho LEFT JOIN up USING (id)),
walk AS (SELECT id, id AS at FROM rho UNION ALL SELECT w.id, l.link FROM walk w JOIN link l ON l.id = w.at WHERE l.link <> w.at)
SELECT walk.id, walk.at AS center, num FROM walk JOIN centers ON centers.id = walk.at JOIN e ON e.id = walk.id""",
}
