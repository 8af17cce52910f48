import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.operators import features, precision, series
from chronoloom.operators.distances import points
from chronoloom.operators.series import packed, packed_index, unpacked_symmetric, window_covariances, window_starts


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(2, 12), st.integers(1, 12))
def test_windows(length, width, stride):
    want = int((length - width) / stride) + 1 if length >= width else 0
    start = window_starts(length, width, stride)
    assert len(start) == want and (not want or start[-1] + width <= length)


def test_covariances_and_packing():
    x = np.random.default_rng(0).standard_normal((3, 4, 20))
    c = window_covariances(x, 8, 5)
    assert c.shape == (3, 3, 4, 4)
    assert np.allclose(c[1, 2], np.cov(x[1][:, 10:18]))
    p = packed(c)
    assert np.allclose(unpacked_symmetric(p, 4), c)
    assert all(np.isclose(p[0, 0, packed_index(i, j, 4)], c[0, 0, i, j]) for i in range(4) for j in range(4))


def kkt(x, s, b, lamb, beta):
    g = -np.linalg.inv(x) + s + 6 * lamb * x + lamb * b
    return np.where(np.abs(x) > 1e-3, np.abs(g + beta * np.sign(x)), np.maximum(np.abs(g) - beta, 0)).max()


@pytest.mark.parametrize("d", [1, 4, 6])
@pytest.mark.parametrize("rule", [None, precision.balanced])
def test_admm_is_optimal(d, rule):
    rng = np.random.default_rng(d)
    s = np.stack([np.atleast_2d(np.cov(rng.standard_normal((d, 25)))) for _ in range(8)])
    b = packed(np.stack([m + m.T for m in 0.3 * rng.standard_normal((8, d, d))]))
    x = unpacked_symmetric(precision.admm(s, b, 0.1, 0.1, rho_update=rule), d)
    full = unpacked_symmetric(b, d)
    assert all(kkt(x[k], s[k], full[k], 0.1, 0.1) < 1e-2 and np.linalg.eigvalsh(x[k])[0] > 0 for k in range(8))
    one = precision.admm(s[3:4], b[3:4], 0.1, 0.1, rho_update=rule)
    assert np.allclose(one[0], packed(x[3]))
    if d == 1:
        assert np.allclose(x[:, 0, 0], precision.scalar_precision(s[:, 0, 0], 0.1, 0.1, full[:, 0, 0]), atol=1e-3)


def test_admm_limits():
    s = np.cov(np.random.default_rng(1).standard_normal((3, 200)))[None]
    assert np.allclose(unpacked_symmetric(precision.admm(s, np.zeros((1, 6)), 0.0, 0.0), 3)[0], np.linalg.inv(s[0]), atol=1e-2)
    diag = np.diag([1.0, 2.0, 3.0])[None]
    x = unpacked_symmetric(precision.admm(diag, np.zeros((1, 6)), 0.1, 0.1), 3)[0]
    assert np.abs(x - np.diag(np.diag(x))).max() < 1e-3


def test_descent():
    cov = window_covariances(np.random.default_rng(3).standard_normal((2, 3, 60)), 20, 10)
    part = precision.descend(cov, 0.1, 0.1, 2)
    assert (part[:, 2:] == 0).all() and (np.abs(part[:, :2]) > 0).any()
    assert np.allclose(precision.descend(cov, 0.1, 0.1, 0, init="inverse"), packed(np.linalg.inv(cov)))
    far = precision.descend(cov, 0.1, 0.1, 400)
    assert np.allclose(far, precision.descend(cov[::-1], 0.1, 0.1, 400)[::-1])
    n = far.shape[2]
    full = unpacked_symmetric(far, 3)
    for t in range(cov.shape[1]):
        b = unpacked_symmetric(precision.neighbour_term(far, t), 3)
        assert kkt(full[0, t], cov[0, t], b[0], 0.1, 0.1) < 2e-2
    assert precision.losses(cov, far, 0.1, 0.1)[0, 4] == cov.shape[1] * n


def test_scaling_edges():
    x, lens = np.array([[1.0, 1.0, 1.0], [np.nan, 2.0, np.nan], [np.nan] * 3]), np.array([3, 3, 2])
    with np.errstate(all="ignore"):
        f = series.fill_forward_back(x, lens)
        assert np.array_equal(f[1], [2, 2, 2]) and np.isnan(f[2]).all()
        assert np.array_equal(series.scale_min_max(x, lens)[0], [0, 0, 0]) and np.array_equal(series.scale_z(x, lens)[0], [0, 0, 0])


def test_stratified(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 = 0 as even", "int(id % 7) as s")
    out = series.stratified(df, "id", ["s"], 0.25).toPandas()
    assert len(out) == 1000
    assert all(g.in_part.sum() == int(len(g) * 0.25) for _, g in out.groupby("s"))


def test_encoded(spark):
    df = spark.createDataFrame([("b ",), ("A",), (None,), ("B",), ("c",)], "w string")
    assert sorted((str(r.w), r.code) for r in series.encoded(df, "w", "code").collect()) == [("A", 0), ("B", 1), ("None", None), ("b ", 1), ("c", 2)]


def test_energy_rank():
    assert features.energy_rank(np.array([60.0, 30, 10]), 50) == 3  # the first holds enough: all are kept
    assert features.energy_rank(np.array([40.0, 30, 20, 10]), 75) == 3
    assert features.energy_rank(np.zeros(3), 50) == 3


def test_embedding_keeps_distances(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30, 6)) @ rng.standard_normal((6, 6))
    df = spark.createDataFrame(pd.DataFrame({"sample_id": range(30), "dataset": "a", "feature": list(x)}), "sample_id long, dataset string, feature array<double>")
    emb = features.embed(df, spark.createDataFrame([("a", 100)], "dataset string, cumulativeenergysaving int")).toPandas().sort_values("sample_id")
    unit = x / np.linalg.norm(x, axis=0)
    e = np.stack(emb.emb)
    assert np.allclose(np.linalg.norm(e[0] - e[1:], axis=1), np.linalg.norm(unit[0] - unit[1:], axis=1), atol=1e-6)


def test_end_to_end_on_synthetic_classes(spark):
    from chronoloom.operators.scores import contingency, scores
    from chronoloom.operators.shapes import k_means
    from chronoloom.sources.synthetic import as_samples, flat_channels, named_set

    made = named_set(spark, "Fake_96_60_4")
    assert made.count() == 60 and {len(r.series[0]) for r in made.collect()} == {96}
    again = {r.sample_id: r.series for r in named_set(spark, "Fake_96_60_4").collect()}
    assert all(again[r.sample_id] == r.series for r in made.collect())
    rows = series.prepared(as_samples(made, "fake"), flat_channels(spark, "fake", 4, 96))
    hyper = spark.createDataFrame([("fake", 24, 24, 5e-3, 5e-3, 80, 500, 80)], "dataset string, width int, stride int, lamb double, beta double, maxiters int, maxiters_admm int, cumulativeenergysaving int")
    emb = features.embed(precision.precision_sequences(rows, flat_channels(spark, "fake", 4, 96), hyper).select("sample_id", "dataset", "feature"), hyper)
    p = points(emb, "sample_id", "emb").join(made.select("sample_id", "label").withColumnRenamed("sample_id", "id"), "id")
    got = scores(contingency(p.join(k_means(p, 3), "id"), "cluster", "label")).first()
    assert got.n == 60 and got.rand_index > 0.55


def test_streaming_windows_match_batch(spark, tmp_path):
    from chronoloom.streaming.windows import sliding_covariances, windowed_rates

    rng = np.random.default_rng(7)
    x = rng.standard_normal((2, 3, 30))
    rows = [(s, t, x[s, :, t].tolist()) for t in range(30) for s in range(2)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : (k + 1) * 20], "sample_id long, t long, vec array<double>").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("sample_id long, t long, vec array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = sliding_covariances(stream, 8, 5).writeStream.format("memory").queryName("hops").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.sample_id, r.win_id): r["cov"] for r in spark.sql("select * from hops").collect()}
    want = packed(window_covariances(x, 8, 5))
    assert set(got) == {(s, w) for s in range(2) for w in range(want.shape[1])}
    assert all(np.allclose(got[s, w], want[s, w]) for s, w in got)
    ev = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), "a", 1.0) for m in range(0, 30, 7)], "ts timestamp, k string, v double")
    assert windowed_rates(ev, "ts", "10 minutes", "10 minutes", "5 minutes", "k", value="v").agg({"n": "sum"}).first()[0] == 5


def test_components_by_samples_and_by_iteration(spark):
    """More features than the driver takes: the same embeddings, up to the sign, as from the covariance."""
    from chronoloom.operators import features

    rng = np.random.default_rng(3)
    basis = rng.standard_normal((4, 60)) * np.array([9.0, 5, 3, 1])[:, None]
    x = rng.standard_normal((40, 4)) @ basis + 0.01 * rng.standard_normal((40, 60)) + 2
    df = spark.createDataFrame([(i * 7, "a", v.tolist()) for i, v in enumerate(x)], "sample_id long, dataset string, feature array<double>")
    hyper = spark.createDataFrame([("a", 95)], "dataset string, cumulativeenergysaving int")
    scaled = x / np.sqrt((x * x).sum(0))
    value, vector = np.linalg.eigh(np.cov(scaled.T))
    k = features.energy_rank(np.maximum(value[::-1], 0), 95)
    want = scaled @ vector[:, ::-1][:, :k]
    for matrix in (2_000, 50, 20):
        got = {r.sample_id: r.emb for r in features.Embedder(hyper, matrix=matrix).fit_transform(df).collect()}
        emb = np.array([got[i * 7] for i in range(40)])
        assert emb.shape == want.shape and np.allclose(np.abs(emb), np.abs(want), atol=1e-5)
    centred = features.embed(df, hyper, components=2, centred=True).collect()
    assert np.allclose(np.mean([r.emb for r in centred], axis=0), 0, atol=1e-9) and len(centred[0].emb) == 2
    whole = hyper.selectExpr("*", "false as dimension_reduce")
    assert len(features.Embedder(whole).fit_transform(df).first().emb) == 60


def test_fitted_components_serve_new_samples(spark):
    from chronoloom.operators import features

    rng = np.random.default_rng(4)
    x = rng.standard_normal((30, 6))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "sample_id long, dataset string, feature array<double>")
    hyper = spark.createDataFrame([("a", 60)], "dataset string, cumulativeenergysaving int")
    fitted = features.Embedder(hyper).fit(df.filter("sample_id < 20"))
    new = x[20:] / np.sqrt((x[20:] ** 2).sum(0))
    got = {r.sample_id: r.emb for r in fitted.transform(df.filter("sample_id >= 20")).collect()}
    assert np.allclose([got[i] for i in range(20, 30)], new @ fitted.components["a"])


def test_inverse_start_and_local_losses():
    from chronoloom.operators import precision
    from chronoloom.operators.series import packed, unpacked_symmetric

    rng = np.random.default_rng(5)
    a = rng.standard_normal((2, 3, 4, 9))
    cov = a @ a.swapaxes(-1, -2) / 9
    theta = precision.descend(cov, 0.1, 0.1, 0, init="inverse")
    assert np.allclose(unpacked_symmetric(theta, 4), np.linalg.inv(cov))
    flat = precision.descend(np.zeros((1, 1, 2, 2)), 0.1, 0.1, 0, init="inverse")
    assert np.isfinite(flat).all()
    seen = []
    precision.admm(cov[0], np.zeros((3, 10)), 0.1, 0.1, watch=lambda turn, loss: seen.append((turn, loss)))
    assert [t for t, _ in seen[:3]] == [0, 1, 2] and seen[0][1].shape == (3, 2)
    x = packed(np.eye(4))[None]
    assert np.allclose(precision.local_losses(cov[0][:1], x, np.zeros((1, 10)), 0.1, 0.2), [[np.trace(cov[0][0]) + 0.3 * 4 + 0.2 * 4, np.trace(cov[0][0]) + 0.3 * 4]])


def test_streamed_rows_in_any_order(spark):
    """Rows that come before their turn wait; repeated rows are ignored."""
    from chronoloom.plans.streams import _streamed
    from chronoloom.streaming.windows import run_once, sliding_covariances

    rng = np.random.default_rng(6)
    rows = [(s, t, rng.standard_normal(2).tolist()) for s in (1, 2) for t in range(20)]
    data = {(s, t): v for s, t, v in rows}
    mixed = [rows[i] for i in rng.permutation(40)] + rows[:5]
    got = {(r.sample_id, r.win_id): r.cov for r in run_once(sliding_covariances(_streamed(spark.createDataFrame(mixed, "sample_id long, t long, vec array<double>").repartition(5), 1), 8, 4)).collect()}
    assert set(got) == {(s, w) for s in (1, 2) for w in range(4)}
    for (s, w), c in got.items():
        m = np.cov(np.array([data[s, t] for t in range(4 * w, 4 * w + 8)]).T)
        assert np.allclose(c, [m[0, 0], m[0, 1], m[1, 1]])
