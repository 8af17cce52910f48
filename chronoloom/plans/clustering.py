"""Queries of the distance, clustering and scoring operators over the embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import density, distances, features, maps, scores, shapes
from chronoloom.storage import materialize, table

EPS, MIN_SAMPLES, K, DC = 7.3, 3, 5, 8.0
DEPTH = 4  # an embedding of 64 numbers as 4 channels of 16 steps


def _points(spark: SparkSession, d: str) -> DataFrame:
    return distances.points(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


def _asked(rows: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by 20."""
    return rows.filter(F.col("id") % 20 == 0)


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def pairwise_l1(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return _round(distances.distances_from(_asked(p), p), "d")


def pairwise_l2(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return _round(distances.distances_from(_asked(p), p, "l2"), "d")


def range_counts(spark: SparkSession, d: str) -> DataFrame:
    return distances.within(_points(spark, d).select("id", "vec"), EPS).groupBy(F.col("i").alias("id")).agg(F.count("*").alias("n"))


def kdist_curve(spark: SparkSession, d: str) -> DataFrame:
    out = density.curve_table(_points(spark, d).select("id", "vec"), K)
    return _round(out.withColumn("rank", F.col("rank").cast("long")), "k_dis")


def percentile_eps(spark: SparkSession, d: str) -> DataFrame:
    rows = _points(spark, d).select("id", "vec")
    value = distances.distance_percentile(rows, 8.0)
    return spark.createDataFrame([(round(value, 6),)], "eps double")


def nn_predict(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    train = p.filter("id % 20 <> 0")
    return density.nearest_label(_asked(p), train, train.select("id", F.col("label").cast("long").alias("cluster")))


def dbscan_labels(spark: SparkSession, d: str) -> DataFrame:
    return density.dbscan(_points(spark, d).select("id", "vec"), EPS, MIN_SAMPLES)


def dbscan_predict(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select("id", "vec")
    labels = materialize(density.dbscan(p, EPS, MIN_SAMPLES), "labels")
    return density.dbscan_predict(p, p, labels, 7.0)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return p.join(dbscan_labels(spark, d).select("id", "cluster"), "id")


def contingency(spark: SparkSession, d: str) -> DataFrame:
    return scores.contingency(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag")


def cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    return _round(scores.scores(contingency(spark, d)), "rand_index", "adjusted_rand", "nmi", "csm")


def cluster_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(scores.accuracy(contingency(spark, d)), 9),)], "accuracy double")


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Rand index, mutual information and accuracy in one row."""
    return _round(scores.evaluation(contingency(spark, d)), "rand_index", "nmi", "accuracy")


def dbscan_quality(spark: SparkSession, d: str) -> DataFrame:
    """The whole path: distances, radius from a percentile, clusters, scores against the labels."""
    p = materialize(_points(spark, d), "points")
    found = density.dbscan(p.select("id", "vec"), distances.distance_percentile(p, 0.5), MIN_SAMPLES)
    return _round(scores.scores(scores.contingency(p.join(found, "id"), "cluster", "label")), "rand_index", "adjusted_rand", "nmi", "csm")


def silhouette(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select("id", "vec", F.col("label").cast("long").alias("cluster"))
    return _round(scores.silhouette(p), "s")


def bic(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scores.information_criterion(F.lit(80), F.lit(168), F.col("o_totalprice") - 100000).alias("bic"))
    return _round(t, "bic")


def _peaks(spark: SparkSession, d: str) -> density.DensityPeaks:
    return density.DensityPeaks(_points(spark, d), dc=DC)


def dpc_rho(spark: SparkSession, d: str) -> DataFrame:
    return _round(_peaks(spark, d).rho, "rho")


def dpc_delta(spark: SparkSession, d: str) -> DataFrame:
    return _round(_peaks(spark, d).delta().select("id", "delta"), "delta")


def dpc_centers(spark: SparkSession, d: str) -> DataFrame:
    return _round(_peaks(spark, d).centers(6).select("id", "gamma"), "gamma")


def dpc_assign(spark: SparkSession, d: str) -> DataFrame:
    return _peaks(spark, d).assign(6)


def dpc_halo(spark: SparkSession, d: str) -> DataFrame:
    peaks = _peaks(spark, d)
    return peaks.halo(materialize(peaks.assign(6), "assigned"))


def dpc_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(float(density.DensityPeaks(_points(spark, d)).dc), 6),)], "dc double")


def dpc_rho_count(spark: SparkSession, d: str) -> DataFrame:
    """Densities as counts of points nearer than the cutoff."""
    return _round(density.DensityPeaks(_points(spark, d), dc=DC, rho="count").rho, "rho")


def dpc_rho_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Densities from the mean distance of the nearest 5 %."""
    return _round(density.DensityPeaks(_points(spark, d), dc=DC, rho="nearest").rho, "rho")


def dpc_delta_strict(spark: SparkSession, d: str) -> DataFrame:
    """Distances to strictly denser points, by counts, which have many ties."""
    return _round(density.DensityPeaks(_points(spark, d), dc=DC, rho="count").delta(strict=True).select("id", "delta"), "delta")


def multi_density_predict(spark: SparkSession, d: str) -> DataFrame:
    """Clusters at several radii of the rows whose id is not divisible by 20, carried over to the others."""
    p = materialize(_points(spark, d), "points")
    return density.MultiDensity(K, 0.01, 0.05).fit(p.filter("id % 20 <> 0")).predict(_asked(p))


def multi_density(spark: SparkSession, d: str) -> DataFrame:
    """Clusters at several radii found on the k-distance curve."""
    return density.multi_density(_points(spark, d), K, 0.01, 0.05, 1e-12, 1e12)


def kmeans(spark: SparkSession, d: str) -> DataFrame:
    return shapes.k_means(_points(spark, d), 10)


def kshape(spark: SparkSession, d: str) -> DataFrame:
    return shapes.k_shape(_points(spark, d), 6, DEPTH)


def fcm(spark: SparkSession, d: str) -> DataFrame:
    return shapes.fuzzy_c_means(_points(spark, d), 3)[0]


def mc2pca(spark: SparkSession, d: str) -> DataFrame:
    return shapes.common_component_clusters(_points(spark, d), 6, DEPTH)


def mc2pca_farthest(spark: SparkSession, d: str) -> DataFrame:
    """The members of each common-component cluster that its basis reconstructs worst."""
    p = materialize(_points(spark, d), "points")
    labels, bases = shapes.common_component_fit(p, 6, DEPTH)
    return shapes.farthest_members(p, labels, bases, DEPTH)


def sbd_cube(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select("id", "vec")
    return _round(shapes.sbd_cube(_asked(p), p, DEPTH), "d")


def sbd(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select("id", "vec")
    return _round(shapes.sbd_table(_asked(p), p, DEPTH), "d")


def dtw(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select("id", "vec")
    return _round(shapes.dtw_table(_asked(p), p, DEPTH), "d")


def range_weights(spark: SparkSession, d: str) -> DataFrame:
    return _round(shapes.range_weights(_points(spark, d).select("id", "vec"), DEPTH), "weight")


def memberships(spark: SparkSession, d: str) -> DataFrame:
    """Membership of every row to the rows 0, 100, 200, ... by L1 distance."""
    p = _points(spark, d).select("id", "vec")
    dist = distances.distances_from(p, p.filter("id % 100 = 0"))
    return _round(shapes.memberships(dist, []), "u")


def fcfw(spark: SparkSession, d: str) -> DataFrame:
    """Memberships to density-peak centres by shape and warping."""
    p = materialize(_points(spark, d), "points")
    return shapes.fuzzy_shape_warp(p.select("id", "vec"), density.DensityPeaks(p).centers(6), DEPTH)


def _cspca(spark: SparkSession, d: str, width: int | None, stride: int | None) -> DataFrame:
    from collections.abc import Iterator

    import pandas as pd

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"sample_id": f.id, "dataset": "all", "feature": list(shapes.covariance_features(shapes.series_rows(f.vec, DEPTH), width, stride))})

    feats = _points(spark, d).select("id", "vec").mapInPandas(kernel, "sample_id long, dataset string, feature array<double>")
    emb = features.embed(feats, spark.createDataFrame([("all", 95)], "dataset string, cumulativeenergysaving int"))
    p = materialize(distances.points(emb, "sample_id", "emb"), "cspca")
    return distances.distances_from(_asked(p), p, "l2")


def cspca_whole(spark: SparkSession, d: str) -> DataFrame:
    return _cspca(spark, d, None, None)


def cspca_windows(spark: SparkSession, d: str) -> DataFrame:
    return _cspca(spark, d, 8, 4)


def cspca_sequences(spark: SparkSession, d: str) -> DataFrame:
    seq, k = shapes.component_sequences(_points(spark, d), DEPTH, 8, 4)
    seq = materialize(seq, "sequences")
    return shapes.dtw_table(_asked(seq), seq, k)


def mc2pca_predict(spark: SparkSession, d: str) -> DataFrame:
    """Bases fitted without the rows whose id is divisible by 20, applied to these."""
    p = _points(spark, d)
    return shapes.common_component_predict(_asked(p), shapes.common_component_fit(p.filter("id % 20 <> 0"), 6, DEPTH)[1], DEPTH)


def fcfw_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy clusters of the memberships of fcfw."""
    u = fcfw(spark, d).groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list(F.struct("j", "u"))).alias("m"))
    return shapes.fuzzy_c_means(materialize(u.select("id", F.col("m.u").alias("vec")), "memberships"), 3)[0]


def tsne_map(spark: SparkSession, d: str) -> DataFrame:
    return maps.tsne(_points(spark, d))


def hmm_distance(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood distances between all rows: each has its own model, and every model scores every row. divergence: the row-normalised
    form, added up twice."""
    p = materialize(_points(spark, d).select("id", "vec"), "points")
    ll = materialize(shapes.hmm_likelihoods(p, p, DEPTH), "ll")
    return shapes.likelihood_distances(ll).join(shapes.likelihood_divergence(ll, 2).withColumnRenamed("d", "divergence"), ["i", "j"], "left")


QUERIES = {
    f.__name__: f
    for f in (
        pairwise_l1, pairwise_l2, range_counts, kdist_curve, percentile_eps, nn_predict, dbscan_labels, dbscan_predict, contingency, cluster_scores, cluster_accuracy, evaluation, dbscan_quality,
        silhouette, bic, dpc_rho, dpc_delta, dpc_centers, dpc_assign, dpc_halo, dpc_cutoff, dpc_rho_count, dpc_rho_nearest, dpc_delta_strict, multi_density, multi_density_predict, kmeans, kshape, fcm, mc2pca, mc2pca_farthest, sbd, sbd_cube, dtw, range_weights, memberships, fcfw, cspca_whole, cspca_windows, cspca_sequences, mc2pca_predict, fcfw_clusters, tsne_map, hmm_distance,
    )
}

E = """e AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
dist AS MATERIALIZED (SELECT a.id AS i, b.id AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) AS d FROM e a, e b)"""
SOME = E.replace("FROM e a, e b)", "FROM e a, e b WHERE a.id % {n} = 0)")
DBSCAN = f"""{E},
core AS (SELECT i FROM dist WHERE d <= {EPS} GROUP BY i HAVING count(*) >= {MIN_SAMPLES}),
link AS MATERIALIZED (SELECT i, j FROM dist WHERE d <= {EPS} AND i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
reach AS (SELECT i, i AS m FROM core UNION SELECT l.j, r.m FROM reach r JOIN link l ON l.i = r.i WHERE r.m < l.j),
comp AS (SELECT i, min(m) AS m FROM reach GROUP BY i),
named AS (SELECT i, dense_rank() OVER (ORDER BY m) - 1 AS c FROM comp),
border AS (SELECT dist.i, min(c) AS c FROM dist JOIN named ON named.i = dist.j WHERE d <= {EPS} GROUP BY dist.i),
labels AS (SELECT id, coalesce(n.c, b.c, -1) AS cluster, n.c IS NOT NULL AS is_core FROM e LEFT JOIN named n ON n.i = id LEFT JOIN border b ON b.i = id)"""
RHO = f"{E}, rho AS MATERIALIZED (SELECT i AS id, sum(exp(-(d / {DC}) * (d / {DC}))) AS rho FROM dist GROUP BY i)"
DELTA = f"""{RHO}, up AS (SELECT a.id, min(d.d) AS delta FROM rho a JOIN dist d ON d.i = a.id JOIN rho b ON b.id = d.j WHERE b.rho > a.rho OR (b.rho = a.rho AND b.id > a.id) GROUP BY a.id),
delta AS (SELECT rho.id, rho.rho, coalesce(delta, (SELECT max(delta) FROM up)) AS delta FROM rho LEFT JOIN up USING (id))"""
ASSIGNED = f"""{DELTA},
centers AS (SELECT id FROM delta ORDER BY rho * delta DESC, id LIMIT 6),
near AS (SELECT a.id, arg_min(b.id, {{'d': d.d, 'j': b.id}}) AS link FROM rho a JOIN dist d ON d.i = a.id JOIN rho b ON b.id = d.j WHERE b.rho > a.rho OR (b.rho = a.rho AND b.id > a.id) GROUP BY a.id),
link AS MATERIALIZED (SELECT rho.id, CASE WHEN rho.id IN (SELECT id FROM centers) THEN rho.id ELSE coalesce(near.link, rho.id) END AS link FROM rho LEFT JOIN near USING (id)),
walk AS (SELECT id, id AS at FROM rho UNION ALL SELECT w.id, l.link FROM walk w JOIN link l ON l.id = w.at WHERE l.link <> w.at),
assigned AS (SELECT walk.id, walk.at AS center FROM walk JOIN centers ON centers.id = walk.at)"""
TABLE = "t AS (SELECT l_linenumber AS cluster, l_returnflag AS label, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL)"

#: Warping costs row by row: the least cost of a cell is the running sum of the row's costs plus the least entry, from the row before, so far.
STEPS = "\n".join(
    f"""r{a} AS MATERIALIZED (SELECT i, j, b, s + min(m - s + c) OVER (PARTITION BY i, j ORDER BY b ROWS UNBOUNDED PRECEDING) AS w FROM (
 SELECT c.i, c.j, c.b, c.c, sum(c.c) OVER (PARTITION BY c.i, c.j ORDER BY c.b ROWS UNBOUNDED PRECEDING) AS s, {"CASE WHEN c.b = 0 THEN 0 ELSE 1e300 END" if a == 0 else "least(p.w, coalesce(lag(p.w) OVER (PARTITION BY c.i, c.j ORDER BY c.b), 1e300))"} AS m
 FROM cost c {"" if a == 0 else f"JOIN r{a - 1} p ON p.i = c.i AND p.j = c.j AND p.b = c.b"} WHERE c.a = {a})){"," if a < 15 else ""}"""
    for a in range(16)
)
DTW = f"""WITH v AS (SELECT vec_id AS id, k AS t, list_transform(range(4), lambda c: embedding[c * 16 + k + 1]::DOUBLE) AS x FROM embeddings, range(16) r(k)),
cost AS MATERIALIZED (SELECT a.id AS i, b.id AS j, a.t AS a, b.t AS b, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS c FROM v a, v b WHERE a.id % 20 = 0),
{STEPS}
SELECT i, j, round(sqrt(w), 6) + 0.0 AS d FROM r15 WHERE b = 15"""
SCORES = """a AS (SELECT cluster, sum(n) AS n FROM t GROUP BY 1), b AS (SELECT label, sum(n) AS n FROM t GROUP BY 1),
s AS (SELECT (SELECT sum(n) FROM t) AS n, (SELECT sum(n * (n - 1) / 2) FROM t) AS p, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb,
 (SELECT sum(n * ln(n)) FROM t) AS h, (SELECT sum(n * ln(n)) FROM a) AS ha, (SELECT sum(n * ln(n)) FROM b) AS hb,
 (SELECT avg(m) FROM (SELECT max(2 * t.n / (a.n + b.n)) AS m FROM t JOIN a USING (cluster) JOIN b USING (label) GROUP BY cluster)) AS csm)
SELECT n::BIGINT AS n, round((n * (n - 1) / 2 + 2 * p - pa - pb) / (n * (n - 1) / 2), 6) + 0.0 AS rand_index,
 round((p - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) + 0.0 AS adjusted_rand,
 round(2 * (ln(n) + h / n - ha / n - hb / n) / (2 * ln(n) - ha / n - hb / n), 6) + 0.0 AS nmi, round(csm, 6) + 0.0 AS csm FROM s"""
#: The best one-to-one matching of three labels, by trying all.
BEST = """best AS (SELECT max(x.n + y.n + z.n) AS n FROM full_table x, full_table y, full_table z WHERE x.label = 'A' AND y.label = 'N' AND z.label = 'R' AND x.cluster <> y.cluster AND x.cluster <> z.cluster AND y.cluster <> z.cluster),
acc AS (SELECT best.n / (SELECT sum(n) FROM t) AS accuracy FROM best)"""
FULL = "full_table AS (SELECT c.cluster, l.label, coalesce(n, 0) AS n FROM (SELECT DISTINCT cluster FROM t) c CROSS JOIN (SELECT DISTINCT label FROM t) l LEFT JOIN t USING (cluster, label))"

ORACLE = {
    "dtw": DTW,
    "cluster_accuracy": f"WITH {TABLE}, {FULL}, {BEST} SELECT round(accuracy, 9) AS accuracy FROM acc",
    "dbscan_quality": f"""WITH RECURSIVE {DBSCAN.replace(f"<= {EPS}", "<= (SELECT eps FROM q)").replace("core AS", "q AS MATERIALIZED (SELECT quantile_cont(d, 0.005) AS eps FROM dist WHERE d <> 0), core AS", 1)},
t AS (SELECT cluster, label, count(*)::DOUBLE AS n FROM labels JOIN e USING (id) GROUP BY ALL), {SCORES}""",
    "dpc_cutoff": f"""WITH RECURSIVE {E}, m AS (SELECT max(d) AS m FROM dist), n AS (SELECT count(*) AS n FROM e),
shares AS MATERIALIZED (SELECT k, (SELECT count(*) FROM dist WHERE i < j AND d < m * k / 1024) / ((n - 1) * (n - 1) / 2) AS share FROM range(1, 1024) r(k), m, n),
b AS (SELECT 1 AS step, 0 AS lo, 1024 AS hi, 512 AS mid UNION ALL
 SELECT step + 1, CASE WHEN share > 0.02 THEN lo ELSE mid END, CASE WHEN share > 0.02 THEN mid ELSE hi END, CASE WHEN share > 0.02 THEN (lo + mid) // 2 ELSE (mid + hi) // 2 END
 FROM b JOIN shares ON k = mid WHERE step < 10 AND NOT share BETWEEN 0.01 AND 0.02)
SELECT round(m * arg_max(mid, step) / 1024, 6) AS dc FROM b, m GROUP BY m""",
    "dpc_rho_count": f"WITH {E} SELECT i AS id, (count(*) FILTER (d < {DC}) - 1)::DOUBLE AS rho FROM dist GROUP BY i",
    "dpc_rho_nearest": f"""WITH {E}, k AS (SELECT count(*) * 5 // 100 AS k FROM e), r AS (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM dist)
SELECT i AS id, round(exp(-sum(d) / greatest(any_value(k) - 1, 1)), 6) + 0.0 AS rho FROM r, k WHERE r <= k GROUP BY i""",
    "dpc_delta_strict": f"""WITH {E}, rho AS MATERIALIZED (SELECT i AS id, count(*) FILTER (d < {DC}) AS rho FROM dist GROUP BY i)
SELECT a.id, round(coalesce(min(d.d) FILTER (b.rho > a.rho), max(d.d)), 6) + 0.0 AS delta FROM rho a JOIN dist d ON d.i = a.id JOIN rho b ON b.id = d.j GROUP BY a.id""",
    "pairwise_l1": f"WITH {SOME.format(n=20)} SELECT i, j, round(d, 6) + 0.0 AS d FROM dist",
    "pairwise_l2": f"WITH {SOME.format(n=20).replace('abs(z[1] - z[2])', '(z[1] - z[2]) * (z[1] - z[2])')} SELECT i, j, round(sqrt(d), 6) + 0.0 AS d FROM dist",
    "range_counts": f"WITH {E} SELECT i AS id, count(*) AS n FROM dist WHERE d <= {EPS} GROUP BY i",
    "kdist_curve": f"""WITH {E}, r AS (SELECT i AS id, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM dist)
SELECT row_number() OVER (ORDER BY d, id) - 1 AS rank, id, round(d, 6) + 0.0 AS k_dis FROM r WHERE r = {K + 1}""",
    "percentile_eps": f"WITH {E} SELECT round(quantile_cont(d, 0.08), 6) AS eps FROM dist WHERE d <> 0",
    "nn_predict": f"""WITH {E}, r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM dist WHERE i % 20 = 0 AND j % 20 <> 0)
SELECT i AS id, label::BIGINT AS cluster FROM r JOIN e ON e.id = r.j WHERE r = 1""",
    "dbscan_labels": f"WITH RECURSIVE {DBSCAN} SELECT * FROM labels",
    "dbscan_predict": f"""WITH RECURSIVE {DBSCAN}, hit AS (SELECT i, arg_min(cluster, j) AS cluster FROM dist JOIN labels ON labels.id = j WHERE is_core AND d < 7.0 GROUP BY i)
SELECT id, coalesce(cluster, -1) AS cluster FROM e LEFT JOIN hit ON hit.i = id""",
    "contingency": "SELECT l_linenumber AS cluster, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL",
    "cluster_scores": f"""WITH {TABLE}, a AS (SELECT cluster, sum(n) AS n FROM t GROUP BY 1), b AS (SELECT label, sum(n) AS n FROM t GROUP BY 1),
s AS (SELECT (SELECT sum(n) FROM t) AS n, (SELECT sum(n * (n - 1) / 2) FROM t) AS p, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb,
 (SELECT sum(n * ln(n)) FROM t) AS h, (SELECT sum(n * ln(n)) FROM a) AS ha, (SELECT sum(n * ln(n)) FROM b) AS hb,
 (SELECT avg(m) FROM (SELECT max(2 * t.n / (a.n + b.n)) AS m FROM t JOIN a USING (cluster) JOIN b USING (label) GROUP BY cluster)) AS csm)
SELECT n::BIGINT AS n, round((n * (n - 1) / 2 + 2 * p - pa - pb) / (n * (n - 1) / 2), 6) + 0.0 AS rand_index,
 round((p - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) + 0.0 AS adjusted_rand,
 round(2 * (ln(n) + h / n - ha / n - hb / n) / (2 * ln(n) - ha / n - hb / n), 6) + 0.0 AS nmi, round(csm, 6) + 0.0 AS csm FROM s""",
    "silhouette": f"""WITH {E}, m AS (SELECT i, a.label AS own, b.label AS other, sum(d) AS s, count(*) AS n FROM dist JOIN e a ON a.id = i JOIN e b ON b.id = j GROUP BY ALL),
ab AS (SELECT i, own, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM m GROUP BY ALL)
SELECT i AS id, own::BIGINT AS cluster, round(coalesce((b - a) / greatest(a, b), 0), 6) + 0.0 AS s FROM ab""",
    "bic": "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 100000 THEN round(0.15 * 168 * ln(80) - 2 * ln(o_totalprice - 100000), 6) + 0.0 END AS bic FROM orders",
    "dpc_rho": f"WITH {RHO} SELECT id, round(rho, 6) + 0.0 AS rho FROM rho",
    "dpc_delta": f"WITH {DELTA} SELECT id, round(delta, 6) + 0.0 AS delta FROM delta",
    "dpc_centers": f"WITH {DELTA} SELECT id, round(rho * delta, 6) + 0.0 AS gamma FROM delta ORDER BY rho * delta DESC, id LIMIT 6",
    "dpc_assign": f"WITH RECURSIVE {ASSIGNED} SELECT id, center FROM assigned",
    "dpc_halo": f"""WITH RECURSIVE {ASSIGNED}, border AS (SELECT DISTINCT a.id, a.center FROM assigned a JOIN dist d ON d.i = a.id JOIN assigned b ON b.id = d.j WHERE d.d < {DC} AND a.center <> b.center),
edge AS (SELECT center, max(rho) AS edge FROM border JOIN rho USING (id) GROUP BY center)
SELECT a.id, a.center, edge IS NULL OR rho >= edge AS is_core FROM assigned a JOIN rho USING (id) LEFT JOIN edge USING (center)""",
    "sbd": f"""WITH {SOME.format(n=20).split('dist AS')[0].rstrip().rstrip(',')},
v AS (SELECT id, u.k AS var_id, v[u.k * 16 + 1 : u.k * 16 + 16] AS x FROM e, (SELECT unnest([0, 1, 2, 3]) AS k) u),
c AS (SELECT a.id AS i, b.id AS j, a.var_id, max(list_sum(list_transform(list_zip(a.x[s + 1 : 16], b.x[1 : 16 - s]), lambda z: z[1] * z[2]))) AS c,
 any_value(sqrt(list_sum(list_transform(a.x, lambda p: p * p))) * sqrt(list_sum(list_transform(b.x, lambda p: p * p)))) AS n
 FROM v a JOIN v b USING (var_id), range(15) r(s) WHERE a.id % 20 = 0 GROUP BY ALL)
SELECT i, j, var_id, round(1 - c / n, 6) + 0.0 AS d FROM c""",
    "evaluation": f"WITH {TABLE}, {FULL}, {BEST}, x AS (SELECT * FROM (WITH {SCORES})) SELECT rand_index, nmi, round(accuracy, 6) + 0.0 AS accuracy FROM x, acc",
    "sbd_cube": f"""WITH {SOME.format(n=20).split('dist AS')[0].rstrip().rstrip(',')},
v AS (SELECT id, u.k AS var_id, v[u.k * 16 + 1 : u.k * 16 + 16] AS x FROM e, (SELECT unnest([0, 1, 2, 3]) AS k) u),
p AS (SELECT a.id AS i, b.id AS j, a.var_id, CASE WHEN a.id <= b.id THEN a.x ELSE b.x END AS x, CASE WHEN a.id <= b.id THEN b.x ELSE a.x END AS y FROM v a JOIN v b USING (var_id) WHERE a.id % 20 = 0),
c AS (SELECT i, j, var_id, max(list_sum(list_transform(list_zip(x[s + 1 : 16], y[1 : 16 - s]), lambda z: z[1] * z[2]))) AS c,
 any_value(sqrt(list_sum(list_transform(x, lambda p: p * p))) * sqrt(list_sum(list_transform(y, lambda p: p * p)))) AS n FROM p, range(15) r(s) GROUP BY i, j, var_id)
SELECT i, j, var_id, round(1 - c / n, 6) + 0.0 AS d FROM c""",
    "range_weights": """WITH v AS (SELECT u.k AS var_id, unnest(embedding[u.k * 16 + 1 : u.k * 16 + 16])::DOUBLE AS x FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS k) u),
r AS (SELECT var_id, max(x) - min(x) AS r FROM v GROUP BY 1) SELECT var_id, round(r / sum(r) OVER (), 6) + 0.0 AS weight FROM r""",
    "memberships": f"""WITH {E}, c AS (SELECT i, j, d, sum(sqrt(1 / (d + 1e-12))) OVER (PARTITION BY i) AS s FROM dist WHERE j % 100 = 0)
SELECT i, j, round(CASE WHEN i % 100 = 0 THEN CASE WHEN i = j THEN 1.0 ELSE 0.0 END ELSE 1 / (sqrt(d) * s + 1e-12) END, 6) + 0.0 AS u FROM c""",
}
