import itertools

import numpy as np
import pandas as pd
import pytest

from chronoloom.operators import density, scores, shapes
from chronoloom.operators.distances import distance_percentile, k_distances, l1, l2, meet, nearest, points, within
from chronoloom.operators.graphs import components


def frame(spark, x, **columns):
    df = pd.DataFrame({"id": np.arange(len(x)), "vec": list(np.asarray(x, float)), **columns})
    return spark.createDataFrame(df, "id long, vec array<double>" + "".join(f", {c} long" for c in columns))


def blobs(seed=0, n=40):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.3, (n, 2)) for c in ((0, 0), (5, 0), (0, 5))] + [np.array([[20.0, 20], [-20, 3]])])


def dbscan_brute(x, eps, least):
    d = np.abs(x[:, None] - x[None]).sum(2)
    core = (d <= eps).sum(1) >= least
    label, n = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            label[i] = n
            while todo:
                k = todo.pop()
                for j in np.flatnonzero((d[k] <= eps) & core & (label < 0)):
                    label[j] = n
                    todo.append(j)
            n += 1
    for i in np.flatnonzero(~core):
        near = label[(d[i] <= eps) & core]
        label[i] = near.min() if len(near) else -1
    return label, core


def test_dbscan(spark):
    x = blobs()
    for eps, least in ((0.5, 4), (0.25, 3)):
        want, core = dbscan_brute(x, eps, least)
        got = density.dbscan(frame(spark, x), eps, least).toPandas().sort_values("id")
        assert list(got.cluster) == list(want) and list(got.is_core) == list(core)


def test_meeting_in_many_blocks(spark):
    x = blobs(n=20)
    df = frame(spark, x)
    out = meet(df, df, lambda a, b: pd.DataFrame({"i": np.repeat(a.id.to_numpy(), len(b)), "j": np.tile(b.id.to_numpy(), len(a))}), "i long, j long", rows=10)
    assert out.count() == len(x) ** 2 == out.distinct().count()
    d = np.abs(x[:, None] - x[None]).sum(2)
    assert within(df, 0.5).count() == (d <= 0.5).sum()
    got = k_distances(df, 3).toPandas().sort_values("id").k_dis
    assert np.allclose(got, np.sort(d, axis=1)[:, 3])
    assert nearest(df.filter("false"), df, 2).count() == 0


@pytest.mark.parametrize("percent", [0.0, 8.0, 50.0, 99.9])
def test_distance_percentile(spark, percent):
    x = np.round(blobs(3, 15), 1)
    d = np.abs(x[:, None] - x[None]).sum(2).ravel()
    assert np.isclose(distance_percentile(frame(spark, x), percent), np.percentile(d[d != 0], percent))


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (200, 200), (103, 101), (100, 101)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[103] == 100 and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_turning_points_by_hand():
    curve = np.array([0, 1, 2, 3, 10, 20, 30, 31, 32.0])
    found = density.turning_points(curve, 0.5, 2.0)
    assert found == sorted(found) and set(found) <= set(range(1, 8))
    assert density.radii(curve, 1e-9, 1e-9, 0, 100) == []
    flat = np.linspace(0, 1, 50)
    assert density.radii(flat, 0.1, 0.1, 0.0, 1.0)


def test_turning_points_of_level_parts(monkeypatch):
    def plain(curve, diff, slope, a, b):
        if b - a <= 1:
            return []
        gap = [abs((curve[k] - curve[a]) / (k - a) - (curve[b] - curve[k]) / (b - k)) for k in range(a + 1, b)]
        m = a + 1 + int(np.argmin(gap))
        ok = min(gap) < diff and (curve[m] - curve[a]) / (m - a) < slope and (curve[b] - curve[m]) / (b - m) < slope
        return plain(curve, diff, slope, a, m - 1) + [m] * bool(ok) + plain(curve, diff, slope, m + 1, b)

    curve = np.sort(np.round(np.random.default_rng(6).gamma(2, 1, 200), 1))
    want = plain(curve, 0.05, 0.3, 0, 199)
    for part in (7, 10**6):
        monkeypatch.setattr(density, "CURVE_PART", part, raising=False)
        assert density.turning_points(curve, 0.05, 0.3) == want
    assert density.turning_points(np.zeros(8), 0.1, 0.1) == [1, 3, 5] and density.turning_points(np.zeros(8), 0.0, 0.1) == []


def test_multi_density_reads_the_whole_curve(spark, monkeypatch):
    x = blobs()
    seen, find = [], density.radii
    monkeypatch.setattr(density, "CURVE_POINTS", 50, raising=False)
    monkeypatch.setattr(density, "radii", lambda curve, *args: seen.append(curve) or find(curve, *args))
    density.multi_density(frame(spark, x), 4, 0.05, 0.5, 1e-9, 1e9, 3)
    d = np.sort(np.abs(x[:, None] - x[None]).sum(2), axis=1)[:, 4]
    assert len(seen[0]) == len(x) and np.allclose(seen[0], np.sort(d))


def test_multi_density(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.05, (30, 2)), rng.normal((5, 5), 0.5, (30, 2)), [[50.0, 50]]])
    got = density.multi_density(frame(spark, x), 4, 0.05, 0.5, 1e-9, 1e9, 3).toPandas().sort_values("id")
    assert got.is_noise.iloc[-1] and got.cluster.iloc[-1] == 0
    assert len(set(got.cluster[:30])) <= 4 and not set(got.cluster[:30][~got.is_noise[:30]]) & set(got.cluster[30:60][~got.is_noise[30:60]])
    nothing = density.multi_density(frame(spark, x), 4, 1e-15, 1e-15, 1e-9, 1e9, 3)
    assert nothing.filter("not is_noise").count() == 0


def test_density_peaks(spark):
    x = blobs(4, 25)[:75]
    peaks = density.DensityPeaks(frame(spark, x), "l2", dc=0.6)
    got = peaks.assign(3).toPandas().sort_values("id")
    assert all(len(set(got.center[k : k + 25])) == 1 for k in (0, 25, 50)) and len(set(got.center)) == 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    rho = peaks.rho.toPandas().sort_values("id").rho
    assert np.allclose(rho, np.exp(-((d / 0.6) ** 2)).sum(1))
    assert peaks.halo(peaks.assign(3)).filter("is_core").count() == 75
    dc = density.DensityPeaks(frame(spark, x), "l2", percent=1.0).dc
    share = (d[np.triu_indices(75, 1)] < dc).sum() / (74**2 / 2)
    assert 0.009 <= share <= 0.021
    count = density.DensityPeaks(frame(spark, x), "l2", dc=0.6, rho="count").rho.toPandas().sort_values("id").rho
    assert np.array_equal(count, (d < 0.6).sum(1) - 1)


def test_scores_by_pairs(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, 60), rng.integers(0, 3, 60)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    got = scores.scores(scores.contingency(df, "a", "b")).first()
    same = [((a[i] == a[j]), (b[i] == b[j])) for i, j in itertools.combinations(range(60), 2)]
    assert np.isclose(got.rand_index, np.mean([x == y for x, y in same]))
    p = np.array([[np.mean((a == i) & (b == j)) for j in range(3)] for i in range(4)])
    h = lambda q: -(q[q > 0] * np.log(q[q > 0])).sum()
    assert np.isclose(got.nmi, 2 * (h(p.sum(1)) + h(p.sum(0)) - h(p.ravel())) / (h(p.sum(1)) + h(p.sum(0))))
    n = p * 60
    assert np.isclose(got.csm, np.mean([max(2 * n[i, j] / (n[i].sum() + n[:, j].sum()) for j in range(3)) for i in range(4)]))
    perfect = scores.scores(scores.contingency(df, "a", "a")).first()
    assert perfect.rand_index == perfect.adjusted_rand == perfect.csm == 1 and np.isclose(perfect.nmi, 1)
    assert scores.scores(scores.contingency(df.filter("false"), "a", "b")).first().rand_index is None
    best = max(sum(n[i, c] for i, c in enumerate(cols) if c is not None) for cols in itertools.permutations([0, 1, 2, None]))
    assert np.isclose(scores.accuracy(scores.contingency(df, "a", "b")), best / 60)


def test_best_assignment():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 6):
        c = rng.random((n, n))
        want = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        got = scores.best_assignment(c)
        assert sorted(got) == list(range(n)) and np.isclose(c[np.arange(n), got].sum(), want)


def test_silhouette(spark):
    x = blobs(5, 6)
    label = np.array([0] * 6 + [1] * 6 + [2] * 6 + [3, 4])
    got = scores.silhouette(frame(spark, x, cluster=label)).toPandas().sort_values("id").s
    d = np.abs(x[:, None] - x[None]).sum(2)
    want = []
    for i in range(len(x)):
        own = (label == label[i]).sum()
        a = d[i][label == label[i]].sum() / (own - 1) if own > 1 else None
        b = min(d[i][label == c].mean() for c in set(label) - {label[i]})
        want.append(0 if a is None else (b - a) / max(a, b))
    assert np.allclose(got, want)


def sbd_plain(x, y):
    n = len(x)
    norm = np.linalg.norm(x) * np.linalg.norm(y)
    return 1 - max(sum(x[j + s] * y[j] for j in range(n - s)) for s in range(n - 1)) / norm if norm else 1.0


def dtw_plain(x, y):
    t = np.full((len(x) + 1, len(y) + 1), np.inf)
    t[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            t[i + 1, j + 1] = np.linalg.norm(x[i] - y[j]) + min(t[i, j + 1], t[i + 1, j], t[i, j])
    return t[-1, -1]


def test_sequence_distances():
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((3, 12)), rng.standard_normal((4, 12))
    assert np.allclose(shapes.sbd(x, y), [[sbd_plain(a, b) for b in y] for a in x])
    assert shapes.sbd(np.zeros((1, 4)), y[:1, :4])[0, 0] == 1.0
    p, q = rng.standard_normal((5, 9, 2)), rng.standard_normal((5, 7, 2))
    assert np.allclose(shapes.dtw(p, q), [dtw_plain(a, b) for a, b in zip(p, q)])
    with pytest.raises(ValueError, match="measure"):
        shapes.dtw(p, q, "x")


def waves(seed=7, n=12, steps=24):
    rng, t = np.random.default_rng(seed), np.arange(steps)
    x = [np.stack([np.sin(t / (1.5 if k else 4.0) + rng.uniform(0, 1)), (1 + k) * np.cos(t / (3 + 5 * k))]) + 0.05 * rng.standard_normal((2, steps)) for k in (0, 1) for _ in range(n)]
    x = np.stack(x)
    x = (x - x.mean(2, keepdims=True)) / x.std(2, keepdims=True)
    return x.reshape(len(x), -1)


def agreement(got, n):
    a = got.sort_values("id").cluster.to_numpy()
    return max(np.mean(a == np.repeat([0, 1], n)), np.mean(a == np.repeat([1, 0], n)))


def test_series_clusterers(spark):
    df = frame(spark, waves())
    assert agreement(shapes.k_shape(df, 2, 2).toPandas(), 12) > 0.9
    assert agreement(shapes.fuzzy_c_means(df, 2)[0].toPandas(), 12) > 0.7
    assert set(shapes.k_means(df, 2).toPandas().cluster) == {0, 1}
    out = shapes.common_component_clusters(df, 2, 2).toPandas()
    assert len(out) == 24 and set(out.cluster) <= {0, 1}
    u = shapes.fuzzy_shape_warp(df, df.filter("id in (0, 12)").select("id"), 2).toPandas()
    best = u.loc[u.groupby("i").u.idxmax()].sort_values("i").j.to_numpy()
    assert np.mean(best == np.repeat([0, 12], 12)) > 0.9


def test_k_shape_scales_and_keeps_the_best_start(spark):
    x = waves().reshape(24, 2, 24) * np.array([1.0, 300.0])[None, :, None] + np.array([5.0, 900.0])[None, :, None]
    df = frame(spark, x.reshape(24, -1))
    assert agreement(shapes.k_shape(df, 2, 2).toPandas(), 12) > 0.9
    raw, scaled = (shapes.k_shape(y, 2, 2).toPandas().sort_values("id").cluster for y in (df, frame(spark, waves())))
    assert list(raw) == list(scaled)


def test_hidden_markov(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((4, 2, 40)), 6 + 3 * rng.standard_normal((4, 2, 40))]).reshape(8, -1)
    df = frame(spark, x)
    ll = shapes.hmm_likelihoods(df, df, 2, states=2, rounds=20)
    d = shapes.likelihood_distances(ll).toPandas()
    within_ = d[(d.i < 4) == (d.j < 4)].d.mean()
    assert len(d) == 28 and d[(d.i < 4) != (d.j < 4)].d.mean() > 3 * within_
    assert shapes.likelihood_divergence(ll).count() == 28


def test_hidden_markov_query_takes_all_rows(spark, tmp_path):
    from chronoloom.plans.clustering import QUERIES

    x = np.random.default_rng(2).standard_normal((23, 64)).astype("float32")
    frame(spark, x).selectExpr("id as vec_id", "cast(vec as array<float>) as embedding", "0 as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.i, r.j): r.d for r in QUERIES["hmm_distance"](spark, str(tmp_path)).collect()}
    assert set(got) == set(itertools.combinations(range(23), 2))
    series = [v.astype(float).reshape(4, 16).T for v in x]
    models = [shapes.GaussHMM(s, states=5, rounds=100) for s in series]
    ll = np.array([[m.score(s) / 16 for s in series] for m in models])
    own = np.diag(ll)
    want = np.maximum((own[:, None] - ll + own[None, :] - ll.T) / 2, 0)
    assert all(np.isclose(v, want[k], rtol=1e-6, atol=1e-8) for k, v in got.items())


def test_points_leave_out_unusable(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, float("nan")]), (None, [1.0]), (4, [None, 1.0])], "k long, v array<double>")
    assert [r.id for r in points(df, "k", "v").collect()] == [1]


def test_metrics():
    a, b = np.array([[0.0, 0], [1, 1]]), np.array([[3.0, 4]])
    assert list(l1(a, b)[:, 0]) == [7, 5] and np.allclose(l2(a, b)[:, 0], [5, np.sqrt(13)])


def test_tuning(spark):
    from chronoloom.operators import tuning

    grid = tuning.config_grid(spark)
    assert grid.count() == 567 and grid.filter("width < stride").count() == 0
    t = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, None)], "config_id long, ri double")
    assert tuple(tuning.best_configs(t, "ri").first()) == (2, 0.9) and tuple(tuning.best_configs(t, "ri", largest=False).first()) == (1, 0.5)


def test_maps(spark):
    from chronoloom.operators import maps

    x = np.concatenate([np.random.default_rng(1).normal(c, 0.1, (20, 3)) for c in (0, 10)])
    y = maps.tsne(frame(spark, x), steps=200).toPandas().sort_values("id")[["x", "y"]].to_numpy()
    assert y.min() >= 0 and y.max() <= 1
    d = np.linalg.norm(y[:, None] - y[None], axis=2)
    assert d[:20, :20].mean() < d[:20, 20:].mean()
    assert maps.tsne(frame(spark, x).filter("false")).count() == 0
    with pytest.raises(ValueError, match="more than"):
        maps.tsne(spark.range(maps.ROWS + 1).selectExpr("id", "array(double(id)) as vec"))


def test_component_sequences(spark):
    df = frame(spark, waves())
    seq, k = shapes.component_sequences(df, 2, 8, 4)
    got = seq.toPandas()
    assert len(got) == 24 and {len(v) for v in got.vec} == {5 * k}
    bases = shapes.common_component_fit(df, 2, 2)[1]
    assert len(bases) == 2 and shapes.common_component_predict(df, bases, 2).count() == 24


def test_whole_path(spark):
    from chronoloom.operators import series, tuning
    from chronoloom.plans.pipelines import compared
    from chronoloom.sources.synthetic import as_samples, flat_channels, named_set

    made = named_set(spark, "Fake_60_24_3").selectExpr("*", "if(sample_id % 2 = 0, 'train', 'test') as split")
    ch = flat_channels(spark, "fake", 3, 60)
    rows = series.prepared(as_samples(made, "fake"), ch)
    hyper = spark.createDataFrame([("fake", 20, 20, 5e-3, 5e-3, 60, 300, 80, 3, 0.5, 0.5, 1e-12, 1e12)], "dataset string, width int, stride int, lamb double, beta double, maxiters int, maxiters_admm int, cumulativeenergysaving int, k_nearest int, diff_threshold double, slope_threshold double, k_dis_low double, k_dis_high double")
    got = {r.method: r for r in compared(rows, ch, hyper).collect()}
    assert set(got) == {"several radii", "one radius", "k-means", "k-shape"} and all(r.n == 12 and 0 <= r.rand_index <= 1 for r in got.values())
    trials = [r for df in tuning.trial(rows, ch, hyper) for r in df.collect()]
    assert {r.method for r in trials} == {"k_means", "dbscan"} and all(-1 <= r.silhouette <= 1 for r in trials)


def test_carried_over_clusters_and_farthest_members(spark):
    from chronoloom.operators import density, shapes

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 0.2, (30, 2)), rng.normal(9, 0.2, (30, 2))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    fitted = density.MultiDensity(4, 0.5, 0.5).fit(rows.filter("id % 5 <> 0"))
    known = {r.id: r.cluster for r in fitted.labels.collect()}
    for r in fitted.predict(rows.filter("id % 5 = 0")).collect():
        near = min(known, key=lambda j: (np.abs(x[j] - x[r.id]).sum(), j))
        assert r.cluster == known[near]
    wide = spark.createDataFrame([(i, rng.standard_normal(12).tolist()) for i in range(20)], "id long, vec array<double>")
    labels, bases = shapes.common_component_fit(wide, 2, 3)
    got = shapes.farthest_members(wide, labels, bases, 3, n=4).collect()
    error = {r.id: shapes._errors(np.array(r.vec).reshape(1, 3, 4), bases)[0] for r in wide.collect()}
    own = {r.id: r.cluster for r in labels.collect()}
    for c in set(own.values()):
        want = sorted((i for i in own if own[i] == c), key=lambda i: (-error[i][c], i))[:4]
        assert [r.id for r in sorted((r for r in got if r.cluster == c), key=lambda r: r["rank"])] == want
