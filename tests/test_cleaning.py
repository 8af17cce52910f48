import math

import numpy as np
import pytest

from chronoloom.functions.numbers import known_word, parse_number
from chronoloom.operators.hotdeck import fill_block, hot_deck, weighted_median
from chronoloom.operators.spikes import chunks, implausible, reading_spikes, sample_spikes
from chronoloom.operators.widen import completed, empty_cells, empty_readings, reading_cells, wide_table

READINGS = "rec_id long, subject_id long, trail_num int, sensor_pos string, sample_num int, sensor_val string, loaded_at timestamp_ntz"
SENSORS = "sensor_pos string, alt_name string, unit string, phys_lo double, phys_hi double"
SAMPLES = "sample_id long, split string, dataset string, series array<array<double>>, label_name string, label int, session_id long, device string, site string, loaded_at timestamp_ntz"
CHANNELS = "dataset string, var_id int, unit string, phys_lo double, phys_hi double, missing_code double, series_len int"


def at(hour):
    import datetime

    return datetime.datetime(2024, 1, 1, hour)


@pytest.fixture(scope="module")
def sensors(spark):
    return spark.createDataFrame([("C3", None, "uV", -100.0, 100.0), ("T7", "T3", "uV", None, None)], SENSORS)


def test_parse_number(spark):
    cases = {"1.5": 1.5, "-2": -2, " +3,25 ": 3.25, "1e2": 100, "4.5 uV": 4.5, "1,234.5": 1234.5, "nan": None, "": None, "NA": None, "1.5f": None, "-": None, "1e999": None, None: None, "٣": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", parse_number(df_col("v")).alias("n"))
    assert {r.v: r.n for r in df.collect()} == cases


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_known_word(spark):
    df = spark.createDataFrame([("a ",), (" ",), ("N/A",), (None,), ("Unknown",), ("x y",)], "v string")
    assert [r[0] for r in df.select(known_word(df.v)).collect()] == ["a", None, None, None, None, "x y"]


def brute_cases(v, lo, hi, times=8.0, longest=3, stuck=8):
    here = [(i, x) for i, x in enumerate(v) if not math.isnan(x)]
    if not here:
        return set()
    m = float(np.median([x for _, x in here]))
    s = 1.4826 * float(np.median([abs(x - m) for _, x in here]))
    far = [abs(x - m) > times * s for _, x in here]
    out = set()
    for k, (i, x) in enumerate(here):
        if x < lo or x > hi:
            out.add(i)
        a = b = k
        while a and far[a - 1] and far[k]:
            a -= 1
        while b + 1 < len(here) and far[b + 1] and far[k]:
            b += 1
        if far[k] and b - a + 1 <= longest:
            out.add(i)
        a = b = k
        while a and here[a - 1][1] == x:
            a -= 1
        while b + 1 < len(here) and here[b + 1][1] == x:
            b += 1
        if b - a + 1 >= stuck:
            out.add(i)
    return out


def test_implausible_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        v = np.round(rng.standard_normal((5, 40)), 1)
        v[rng.random(v.shape) < 0.1] = np.nan
        for r in range(5):
            k = rng.integers(0, 30)
            v[r, k : k + rng.integers(1, 12)] = rng.choice([50.0, 0.3])
        v[4, rng.integers(0, 40, 3)] = np.nan
        lo, hi = np.full(5, -2.0), np.array([2.0, 3, np.nan, 60, 60])
        got = implausible(v, lo, hi)
        for r in range(5):
            assert set(np.flatnonzero(got[r])) == brute_cases(v[r], -2.0, np.inf if np.isnan(hi[r]) else hi[r])


def test_implausible_edges():
    assert implausible(np.zeros((0, 5)), np.zeros(0), np.zeros(0)).shape == (0, 5)
    assert not implausible(np.full((2, 3), np.nan), np.zeros(2), np.ones(2)).any()
    flat = np.full((1, 9), 3.0)
    assert implausible(flat, np.array([np.nan]), np.array([np.nan])).all()
    rolling = np.concatenate([np.zeros(20) + np.arange(20) % 3, 100 + np.arange(20) % 3]).astype(float)[None]
    rolling[0, 8] = 60
    got = implausible(rolling, np.array([np.nan]), np.array([np.nan]), window=9)
    assert list(np.flatnonzero(got)) == [8]


def test_reading_spikes(spark, sensors):
    rows = [(1, 1, 0, " c3", k, str(k % 3), at(1)) for k in range(12)]
    rows += [(1, 1, 0, "C3", 5, "500", at(2)), (1, 1, 0, "C3", 5, "500", at(2)), (1, 1, 0, "t3", 0, "7", at(1)), (1, 1, 0, "XX", 0, "9999", at(1)), (None, 1, 0, "C3", 0, "9999", at(1)), (1, 1, 0, None, 0, "9", at(1)), (1, 1, 0, "C3", 6, "999", None)]
    df = spark.createDataFrame(rows, READINGS)
    assert [tuple(r) for r in reading_spikes(df, sensors).collect()] == [(1, 0, "C3", 5)]
    assert reading_spikes(df.filter("false"), sensors).count() == 0


def test_sample_spikes(spark):
    ch = spark.createDataFrame([("a", 0, "", -10.0, 10.0, -999.0, 9)], CHANNELS)
    good = [0.0, 1.0, 2.0, 1.0, 0.0, 1.0, 2.0, 50.0, -999.0]
    rows = [(1, "train", "a", [good], None, None, None, None, None, at(1)), (1, "train", "a", [good], None, None, None, None, None, at(2)), (2, "train", "a", None, None, None, None, None, None, at(1)), (3, "test", "b", [None, [], [1.0, None, float("nan")]], None, None, None, None, None, at(1))]
    df = spark.createDataFrame(rows, SAMPLES)
    assert [tuple(r) for r in sample_spikes(df, ch).collect()] == [(1, 0, 7)]
    assert sample_spikes(df.filter("false"), ch).count() == 0


def test_rolling_query_has_both_origins(spark, sensors, tmp_path):
    from chronoloom.plans.cleaning import QUERIES

    level = [float(k % 3) for k in range(40)]
    level[20] = 60.0
    ch = spark.createDataFrame([("a", 0, "", None, None, None, 40)], CHANNELS)
    tables = {
        "eeg_readings": spark.createDataFrame([(1, 1, 0, "C3", k, str(v), at(1)) for k, v in enumerate(level)], READINGS),
        "sensors": sensors,
        "samples": spark.range(7, 8).selectExpr("id as sample_id", "'a' as dataset", f"array(array({', '.join(f'{v}D' for v in level)})) as series"),
        "channels": ch,
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.origin, r.dataset, r.chan): (r.n_cases, r.n_samples) for r in QUERIES["p2_rolling"](spark, str(tmp_path)).collect()}
    assert got == {("eeg_readings", None, "C3"): (1, 1), ("samples", "a", "0"): (1, 1)}


def test_wide_table(spark, sensors):
    rows = [(1, 1, 0, "C3", 0, "1,5", at(1)), (1, 1, 0, "c3 ", 0, "2.5", at(3)), (1, 1, 0, "T3", 1, "4 uV", at(1)), (1, 1, 0, "T7", 1, "", at(2)), (1, 1, 0, "T7", 0, "8", at(1)), (1, 1, 1, "C3", 0, "n/a", at(1)), (1, 1, 2, "AUX", 5, "1", at(1))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], READINGS + ", wanted string")
    assert sorted(map(tuple, empty_readings(df, sensors).collect())) == [(1, 0, 1, "C3"), (1, 0, 1, "T7")]
    wide = wide_table(reading_cells(df, sensors), {"C3": "double", "T7": "int", "rec_id": "double", "AF3": "string"})
    assert wide.columns == ["rec_id", "trail_num", "sample_num", "C3", "T7", "rec_id_", "AF3"]
    assert sorted(map(tuple, wide.collect()), key=str) == [(1, 0, 0, 2.5, 8, None, None), (1, 0, 1, None, None, None, None), (1, 1, 0, None, None, None, None)]
    assert empty_readings(df.filter("false"), sensors).count() == 0 and empty_readings(df, sensors.filter("false")).count() == 0


def test_latest_version_with_and_without_texts(spark, sensors):
    rows = [(1, 1, 0, "C3", 0, "1", None), (1, 1, 0, "C3", 1, "1", None), (1, 1, 0, "C3", 1, "", at(1)), (1, 1, 0, "C3", 2, "1", at(2)), (1, 1, 0, "C3", 2, "", at(2)), (1, 1, 0, "C3", 3, "", at(3)), (1, 1, 0, "C3", 3, "2", at(1)), (1, 1, 0, "C3", 4, "", None), (1, 1, 0, "C3", 5, "", at(1)), (1, 1, 0, "C3", 5, "4", at(2))]
    df = spark.createDataFrame(rows, READINGS)
    assert {r.sample_num for r in reading_cells(df, sensors).collect() if r.found} == {0, 2, 5}
    assert {r.sample_num for r in empty_readings(df, sensors).collect()} == {1, 3, 4}


def test_more_attributes_than_bits_of_a_column(spark):
    names = [f"a{k:03d}" for k in range(150)]
    rows = [(1, e, k, 1.0 if (k + e) % 3 else None, at(1)) for e in (0, 1) for k in range(150) if k % 5]
    df = spark.createDataFrame(rows, "g long, e long, place int, v double, seen timestamp_ntz")
    grid = completed(df, ["g"], ["e"], "place", "v", "seen", names)
    held = {e: {k for _, x, k, v, _ in rows if x == e and v is not None} for e in (0, 1)}
    want = {(1, e, names[k]) for e in (0, 1) for k in (held[0] | held[1]) - held[e]}
    assert {tuple(r) for r in empty_cells(grid, names, "name").collect()} == want and len(want) > 50


def test_typed_columns_come_from_the_text(spark, sensors):
    rows = [(1, 1, 0, "C3", 0, " 1.50 uV", at(1)), (1, 1, 0, "T7", 0, "2e1", at(1)), (1, 1, 0, "C3", 1, "0x10", at(1)), (1, 1, 0, "T7", 1, "7f", at(1)), (1, 1, 0, "C3", 2, "7.", at(1))]
    cells = reading_cells(spark.createDataFrame(rows, READINGS), sensors)
    got = sorted(map(tuple, wide_table(cells, {"C3": "string", "T7": "int"}).collect()))
    assert got == [(1, 0, 0, " 1.50 uV", 20), (1, 0, 1, None, None), (1, 0, 2, "7.", None)]


def test_chunks_are_cut_by_what_is_padded():
    import pyarrow as pa

    series = [[[0.0] * 100] * 2 for _ in range(99)] + [[[0.0] * 50_000], None, [None, [1.0]]]
    batch = pa.RecordBatch.from_arrays([pa.array(series, pa.list_(pa.list_(pa.float64())))], ["series"])
    parts = list(chunks(batch, 4_000))
    assert sum(p.num_rows for p in parts) == 102
    for p in parts:
        lens = [len(c or []) for s in p.column(0).to_pylist() for c in s or []]
        assert p.num_rows == 1 or len(lens) * max(lens) <= 4_000
    flat = pa.RecordBatch.from_arrays([pa.array([[1.0]] * 50 + [[0.0] * 900], pa.list_(pa.float64()))], ["series"])
    assert [p.num_rows for p in chunks(flat, 1_000)] == [50, 1]


def test_implausible_readings_give_nothing_to_others(spark):
    ch = spark.createDataFrame([("a", 0, "", -10.0, 10.0, -999.0, 6)], CHANNELS)
    rows = [(k, "train", "a", [[1.0, 2.0, 999.0, 1.0, 2.0, 3.0]], "x", 0, 7, "d", "s", at(1)) for k in range(6)] + [(9, "train", "a", [[1.0, 2.0, None, 1.0, 2.0, 3.0]], "x", 0, 7, "d", "s", at(1))]
    (got,) = hot_deck(spark.createDataFrame(rows, SAMPLES), ch).collect()
    assert (got.sample_id, got.t_pos, got.method) == (9, 2, "series") and got.value == 2.0


def test_weighted_median():
    v = np.array([[1.0, 5, 9], [2, 2, 8], [4, 0, 0]])
    w = np.array([[1.0, 1, 1], [0.1, 0.1, 5], [1, 0, 0]])
    assert list(weighted_median(v, w)) == [5, 8, 4]


def test_fill_block_takes_the_closest():
    rng = np.random.default_rng(2)
    base = np.array([0.0, 100.0]).repeat(20)
    x = base[:, None] + rng.standard_normal((40, 10))
    truth = x.copy()
    x[3, 4] = x[30, 7] = np.nan
    x[5] = np.nan
    f = fill_block(np.arange(40), x, 10, np.array([50.0]), np.array([50.0]))
    got = {(r, p): v for r, p, v in zip(f["row"], f["pos"], f["value"])}
    assert len(got) == 12 and abs(got[3, 4] - truth[3, 4]) < 5 and abs(got[30, 7] - truth[30, 7]) < 5
    assert not any(np.isnan(v) for v in got.values())


def test_hot_deck(spark):
    ch = spark.createDataFrame([("a", 0, "", -10.0, 10.0, -999.0, 4), ("a", 1, "", None, None, None, 4)], CHANNELS)
    one, two = [1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]
    rows = [(k, "train", "a", [one, two], "x", 0, 7, "dev", "lab", at(1)) for k in range(5)]
    rows += [(10, "train", "a", [[1.0, -999.0, 3.0], None], "x", None, 7, "n/a", " ", at(1)), (10, "train", "a", [[1.0, -999.0, 3.0], None], "x", None, 7, "n/a", " ", at(2)), (11, "test", "a", None, "x", 0, None, None, "lab", at(1)), (12, "test", "zz", [[1.0]], None, None, None, "d", "s", at(1)), (None, "test", "a", [one, two], "x", 0, 7, "dev", "lab", at(1))]
    df = spark.createDataFrame([(*r, 1) for r in rows], SAMPLES + ", code int")
    out = [r.asDict() for r in hot_deck(df, ch).collect()]
    cells = {(r["sample_id"], r["var_id"], r["t_pos"]): r for r in out if r["field_name"] == "x"}
    assert set(cells) == {(10, 0, 1), (10, 0, 3), *((10, 1, t) for t in range(4)), *((11, v, t) for v in (0, 1) for t in range(4))}
    assert cells[10, 0, 1]["value"] == 2.0 and cells[10, 1, 3]["value"] == 8.0 and len(cells[10, 0, 1]["donors"]) == 5
    words = {(r["sample_id"], r["field_name"]): r["word"] for r in out if r["field_name"] != "x"}
    assert words == {(10, "device"): "dev", (10, "site"): "lab", (11, "device"): "dev"}
    assert hot_deck(df.filter("false"), ch).count() == 0
