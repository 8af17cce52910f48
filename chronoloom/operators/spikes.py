"""Implausible readings: Hampel filter, runs of stuck values and physical bounds, per source.

The kernel works on a padded matrix (one source per row, NaN = no reading), so that a whole Arrow batch is one numpy call.

Defined results: null or empty sources give nothing; missing cells are no readings and do not break a run; null bounds do not
bound; equal readings everywhere have deviation 0, so nothing differs from the median; ties and repeated rows change nothing
beyond what their values say (repeated sample_ids are reported once); further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.readings import known_readings

MAD_SCALE = 1.4826
#: Cells of one padded matrix, so that memory stays the same whatever the lengths of the series; one longer series has a matrix of its own.
CELLS = 1_000_000


def _middle(ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the first n entries of each ordered row (NaN where n is 0)."""
    at = np.arange(len(ordered))
    last = max(ordered.shape[1] - 1, 0)
    lo, hi = np.clip((n - 1) // 2, 0, last), np.clip(n // 2, 0, last)
    return np.where(n > 0, (ordered[at, lo] + ordered[at, hi]) / 2, np.nan)


def _run_lengths(same: np.ndarray) -> np.ndarray:
    """For each cell the length of the run it is in, where same[i, j] says that j belongs with j-1 of the row."""
    flat = same.copy()
    flat[:, 0] = False
    starts = np.flatnonzero(~flat.ravel())
    lengths = np.diff(np.append(starts, flat.size))
    return np.repeat(lengths, lengths).reshape(same.shape)


def _centre(v: np.ndarray, n: np.ndarray, window: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Median and scaled median absolute deviation for each cell of the compact rows v with n readings each."""
    if window is None:
        m = _middle(np.sort(v, axis=1), n)[:, None]
        s = _middle(np.sort(np.abs(v - m), axis=1), n)[:, None]
        return m, MAD_SCALE * s
    half = window // 2
    padded = np.pad(v, ((0, 0), (half, half)), constant_values=np.nan)
    view = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1, axis=1).reshape(-1, 2 * half + 1)
    count = (~np.isnan(view)).sum(1)
    m = _middle(np.sort(view, axis=1), count)
    s = _middle(np.sort(np.abs(view - m[:, None]), axis=1), count)
    return m.reshape(v.shape), MAD_SCALE * s.reshape(v.shape)


def implausible(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, *, times: float = 8.0, longest: int = 3, stuck: int = 8, window: int | None = None) -> np.ndarray:
    """Boolean matrix of the cases in values (sources x positions, NaN = no reading). window: readings of the rolling median
    (centred, shorter at the ends); None takes the whole source."""
    if values.size == 0:
        return np.zeros(values.shape, bool)
    gone = np.isnan(values)
    order = np.argsort(gone, axis=1, kind="stable")
    v = np.take_along_axis(values, order, axis=1)
    n = (~gone).sum(1)
    present = np.arange(v.shape[1])[None, :] < n[:, None]
    with np.errstate(invalid="ignore"):
        m, s = _centre(v, n, window)
        far = (np.abs(v - m) > times * s) & present
        joined = np.zeros_like(far)
        joined[:, 1:] = far[:, 1:] & far[:, :-1]
        equal = np.zeros_like(far)
        equal[:, 1:] = v[:, 1:] == v[:, :-1]
        case = far & (_run_lengths(joined) <= longest)
        case |= present & (_run_lengths(equal) >= stuck)
        case |= present & ((v < lo[:, None]) | (v > hi[:, None]))
    out = np.zeros_like(case)
    np.put_along_axis(out, order, case, axis=1)
    return out


def channel_limits(channels: DataFrame) -> DataFrame:
    """One row per dataset: lo, hi, code arrays in the order of var_id, and series_len."""
    row = F.array_sort(F.collect_list(F.struct("var_id", "phys_lo", "phys_hi", "missing_code", "series_len")))
    return (
        channels.groupBy("dataset")
        .agg(row.alias("c"))
        .select("dataset", F.col("c.phys_lo").alias("lo"), F.col("c.phys_hi").alias("hi"), F.col("c.missing_code").alias("code"), F.array_max("c.series_len").alias("series_len"))
    )


def numeric_list(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each list of a (0 for null), and all values end to end (null = NaN)."""
    lens = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lens, a.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)


def pad(lens: np.ndarray, flat: np.ndarray, width: int | None = None) -> np.ndarray:
    """Lists as rows of a matrix, NaN after their end; cut at width, if given."""
    full = int(lens.max()) if len(lens) else 0
    out = np.full((len(lens), max(full, width or 0)), np.nan)
    out[np.arange(out.shape[1])[None, :] < lens[:, None]] = flat
    return out if width is None else out[:, :width]


def channels_of(series: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and var_id of each channel of an array<array<double>> column, and the channels."""
    if isinstance(series, pa.ChunkedArray):
        series = series.combine_chunks()
    row = pc.list_parent_indices(series).to_numpy(zero_copy_only=False).astype(np.int64)
    var = np.arange(len(row)) - np.searchsorted(row, row)
    return row, var, series.flatten()


def per_channel(limits: pa.Array, row: np.ndarray, var: np.ndarray) -> np.ndarray:
    """The var-th entry of each row's list of limits, NaN where there is none."""
    lens, flat = numeric_list(limits)
    start = np.cumsum(lens) - lens
    ok = var < lens[row]
    out = np.full(len(row), np.nan)
    out[ok] = flat[(start[row] + var)[ok]]
    return out


def cuts(lines: np.ndarray, longest: np.ndarray, cells: int = CELLS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose padded matrix, lines of all its rows times the longest of them, has at most so many cells; a single larger
    row is a range of its own."""
    start, held, most = 0, 0, 0
    for i, (n, k) in enumerate(zip(lines.tolist(), longest.tolist(), strict=True)):
        if i > start and (held + n) * max(most, k) > cells:
            yield start, i
            start, held, most = i, 0, 0
        held, most = held + n, max(most, k)
    if start < len(lines):
        yield start, len(lines)


def chunks(batch: pa.RecordBatch, cells: int = CELLS) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose padded series have at most so many cells."""
    series = batch.column("series")
    lines = pc.fill_null(pc.list_value_length(series), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(series.type.value_type):
        own = np.append(pc.fill_null(pc.list_value_length(series.flatten()), 0).to_numpy(zero_copy_only=False), 0)
        first = np.cumsum(lines) - lines
        longest = np.where(lines > 0, np.maximum.reduceat(own, np.minimum(first, len(own) - 1)), 0) if len(lines) else lines
    else:
        lines, longest = np.ones(len(lines), np.int64), lines
    for a, b in cuts(lines, longest, cells):
        yield batch.slice(a, b - a)


def clean_matrix(batch: pa.RecordBatch, **how: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, var_id, padded values (missing codes are NaN) and cases of a batch with series, lo, hi, code."""
    row, var, inner = channels_of(batch.column("series"))
    values = pad(*numeric_list(inner))
    values[~np.isfinite(values)] = np.nan
    values[values == per_channel(batch.column("code"), row, var)[:, None]] = np.nan
    case = implausible(values, per_channel(batch.column("lo"), row, var), per_channel(batch.column("hi"), row, var), **how)
    return row, var, values, case


def sample_spikes(samples: DataFrame, channels: DataFrame, **how: float) -> DataFrame:
    """sample_id, var_id, pos of the cases in the series of the samples; repeated rows count once."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                row, var, _, case = clean_matrix(batch, **how)
                at, pos = np.nonzero(case)
                ids = batch.column("sample_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[at]], pa.int64()), pa.array(var[at], pa.int32()), pa.array(pos, pa.int32())], ["sample_id", "var_id", "pos"])

    wide = samples.filter(F.col("sample_id").isNotNull() & F.col("series").isNotNull()).select("sample_id", "dataset", "series").join(channel_limits(channels), "dataset", "left")
    return wide.select("sample_id", "series", "lo", "hi", "code").mapInArrow(kernel, "sample_id long, var_id int, pos int").distinct()


def reading_spikes(readings: DataFrame, sensors: DataFrame, **how: float) -> DataFrame:
    """rec_id, trail_num, sensor_pos, pos of the cases among the latest values of each sensor of each trial. One shuffle, by
    the trial's sensor; the series of one sensor of one trial is the unit of work."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                lens, flat = numeric_list(batch.column("series"))
                _, pos = numeric_list(batch.column("at"))
                lo, hi = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("phys_lo", "phys_hi"))
                case = implausible(pad(lens, flat), lo, hi, **how)
                at, col = np.nonzero(case)
                start = np.cumsum(lens) - lens
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("rec_id", "trail_num", "sensor_pos")), pa.array(pos[start[at] + col].astype(np.int32))], ["rec_id", "trail_num", "sensor_pos", "pos"])

    known = known_readings(readings, sensors)
    keys = ["rec_id", "trail_num", "sensor_pos"]
    newest = known.repartition("rec_id", "trail_num").groupBy(*keys, "sample_num").agg(F.max_by("val", F.struct("loaded_at", F.col("val").isNotNull(), "val")).alias("val"), F.first("phys_lo").alias("phys_lo"), F.first("phys_hi").alias("phys_hi"))
    series = (
        newest.filter("val is not null")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("sample_num", "val"))).alias("s"), F.first("phys_lo").alias("phys_lo"), F.first("phys_hi").alias("phys_hi"))
        .select(*keys, "phys_lo", "phys_hi", F.col("s.sample_num").alias("at"), F.col("s.val").alias("series"))
    )
    schema = f"rec_id {dict(readings.dtypes)['rec_id']}, trail_num {dict(readings.dtypes)['trail_num']}, sensor_pos string, pos int"
    return series.mapInArrow(kernel, schema)


def implausible_readings(readings: DataFrame, sensors: DataFrame, samples: DataFrame, channels: DataFrame, **how: float) -> DataFrame:
    """Cases of both origins in one form: origin, rec_key, trail_num, chan, pos."""
    a = reading_spikes(readings, sensors, **how).select(F.lit("eeg_readings").alias("origin"), F.col("rec_id").alias("rec_key"), "trail_num", F.col("sensor_pos").alias("chan"), "pos")
    b = sample_spikes(samples, channels, **how).select(F.lit("samples").alias("origin"), F.col("sample_id").alias("rec_key"), F.lit(-1).alias("trail_num"), F.col("var_id").cast("string").alias("chan"), "pos")
    return a.unionByName(b)
