import numpy as np
import pytest

from chronoloom.llm import overlap

SAMPLES = "sample_id long, split string, dataset string, series array<array<double>>, block string"
CHANNELS = "dataset string, var_id int, unit string, phys_lo double, phys_hi double, missing_code double, series_len int"


def test_suffix_array_and_search():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 200, 700):
        text = np.append(rng.integers(1, 5, n), 0)
        order = overlap.suffix_array(text)
        assert [bytes(text[i:].astype(np.uint8)) for i in order] == sorted(bytes(text[i:].astype(np.uint8)) for i in range(n + 1))
    for size in (5, 600):
        text = np.append(rng.integers(1, size, 3000 if size > 5 else 700), 0)
        index = overlap.TextIndex(text)
        query = np.where(rng.random(300) < 0.1, overlap.NEVER, rng.integers(1, size, 300))
        query[100:140] = text[50:90]
        ends = np.arange(len(query))
        for length in (1, 2, 4):
            who, lo, hi = index.ranges(query, ends, length)
            which, at = index.places_of(lo, hi)
            want = {(e, i) for e in range(length - 1, len(query)) for i in range(len(text) - length) if (query[e - length + 1 : e + 1] > 1).all() and (query[e - length + 1 : e + 1] == text[i : i + length]).all()}
            assert set(zip(who[which].tolist(), at.tolist())) == want and len(which) == len(want) > 0
            ((_, who, lo, hi),) = index.whole_words(query, ends, np.array([length]))
            which, at = index.places_of(lo, hi)
            assert set(zip(who[which].tolist(), at.tolist())) == {(e, i - 1) for e, i in want if i and text[i - 1] == 1 and text[i + length] == 1}


def brute(rows):
    """Plain comparison of all pairs, for readings without implausible ones."""
    once = {r[0]: r for r in rows}
    out = set()
    for a in once.values():
        for b in once.values():
            if a[1] != "train" or b[1] != "test" or a[2] != b[2] or a[3] is None or b[3] is None:
                continue
            for h in range(-3, 4):
                verdict = []
                for x, y in zip(a[3], b[3]):
                    if x is None or y is None:
                        continue
                    y = np.array([np.nan if v is None else v for v in y], float)
                    x = np.array([np.nan if v is None else v for v in x], float)
                    sd = np.nanstd(y)
                    pairs = [(x[t], y[t + h]) for t in range(len(x)) if 0 <= t + h < len(y)]
                    pairs = [(p, q) for p, q in pairs if not np.isnan(p) and not np.isnan(q)]
                    if len(pairs) >= 5:
                        verdict.append(np.mean([abs(p - q) <= 0.05 * sd for p, q in pairs]) >= 0.9)
                if verdict and all(verdict):
                    out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize("sizes", [(8_192, 16_384), (5, 7)])
def test_overlaps(spark, sizes):
    rng = np.random.default_rng(1)
    made = lambda: (3 * rng.standard_normal((2, 40))).clip(-9, 9)
    rows = []
    for k in range(14):
        x = made()
        rows.append((k, "train", "a", x.tolist(), ""))
        if k % 2 == 0:
            h = k % 4
            y = x + 0.003 * rng.standard_normal(x.shape)
            y = np.concatenate([made()[:, :h], y[:, : 40 - h]], axis=1) if h else y
            y = [[None if rng.random() < 0.05 else float(v) for v in c] for c in y]
            rows.append((100 + k, "test", "a", y, ""))
        else:
            rows.append((100 + k, "test", "a", made().tolist(), ""))
    half = np.array(rows[0][3])
    half[1] = made()[1]
    rows += [(200, "test", "a", half.tolist(), ""), (201, "test", "b", rows[0][3], ""), (202, "test", "a", None, ""), (203, "test", "a", [None, []], ""), (204, "other", "a", rows[0][3], ""), (205, "test", "a", [rows[0][3][0], None], ""), rows[0], (100, "test", "a", rows[1][3], ""), (300, "test", None, rows[0][3], "")]
    rows += [(400 + k, ("train", "test")[k % 2], "a", rows[2][3], "") for k in range(6)]
    df = spark.createDataFrame(rows, SAMPLES)
    ch = spark.createDataFrame([("a", v, "", -10.0, 10.0, -999.0, 40) for v in (0, 1)], CHANNELS)
    got = {(r.train_id, r.test_id) for r in overlap.split_overlaps(df, ch, *sizes).collect()}
    assert got == brute(rows) and (0, 205) in got and (0, 200) not in got and len(got) >= 7
    rep = {(r.dataset, r.split): (r.n_overlapping, r.n_pairs) for r in overlap.overlap_report(df, overlap.split_overlaps(df, ch)).collect()}
    assert rep["a", "train"] == (len({a for a, _ in got}), len(got))
    assert overlap.split_overlaps(df.filter("false"), ch).count() == 0


def test_matches_are_opened_in_parts():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((9, 2, 30)).cumsum(2)
    shard = overlap.Shard(np.arange(40), np.concatenate([x, x + 0.01, rng.standard_normal((22, 2, 30)).cumsum(2)]))
    whole, parts = list(shard.candidates(x)), list(shard.candidates(x, most=20))
    assert len(parts) > 3 and len(np.concatenate(whole)) >= 18
    assert sorted(map(tuple, np.concatenate(parts))) == sorted(map(tuple, np.concatenate(whole)))


def test_short_and_ragged_records(spark):
    """Exact copies of few cells, with gaps, of one word's length, and without any two cells in a row."""
    rng = np.random.default_rng(7)
    made = lambda d, n: rng.uniform(-9, 9, (d, n))
    short, ridged, thin, noisy = made(2, 7), made(2, 40), made(2, 41), made(1, 60).cumsum(1).clip(-9.5, 9.5)
    ridged[:, ::8] = np.nan
    five = made(1, 5)
    thin[:, ::2] = np.nan
    listed = lambda x: [[None if np.isnan(v) else float(v) for v in c] for c in x]
    shifted = np.concatenate([np.full((2, 2), np.nan), ridged[:, :-2]], axis=1)
    close = noisy + rng.uniform(-0.049, 0.049, noisy.shape) * noisy.std()
    rows = []
    for k, (a, b) in enumerate([(short, short), (ridged, ridged), (thin, thin), (five, five), (ridged, shifted), (noisy, close)]):
        rows += [(2 * k, "train", "a", listed(a), ""), (2 * k + 1, "test", "a", listed(b), "")]
    rows += [(100 + k, ("train", "test")[k % 2], "a", listed(made(2, 40)), "") for k in range(20)]
    df = spark.createDataFrame(rows, SAMPLES)
    ch = spark.createDataFrame([("a", v, "", -10.0, 10.0, -999.0, 40) for v in (0, 1)], CHANNELS)
    got = {(r.train_id, r.test_id) for r in overlap.split_overlaps(df, ch).collect()}
    assert got == {(0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11), (2, 9), (8, 3)} | {p for p in got if p in brute(rows)} and got == brute(rows)


def test_recall_of_disturbed_copies(spark):
    rng = np.random.default_rng(8)
    rows = [(k, "train" if k < 300 else "test", "a", (rng.standard_normal((2, 40)).cumsum(1) + rng.normal(0, 20)).tolist(), "") for k in range(340)]
    df = spark.createDataFrame(rows, SAMPLES)
    ch = spark.createDataFrame([("a", v, "", -100.0, 100.0, -999.0, 40) for v in (0, 1)], CHANNELS)
    got = {r.kind: r for r in overlap.measured_recall(df, ch, every=2).collect()}
    assert got["noisy"].n_true == 150 and got["noisy"].recall >= 0.99
