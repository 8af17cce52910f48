"""Series of samples: row-local cleaning and scaling, windows, covariances, features.

A sample's series is one row (array of channels), so all of this runs where the row lies (only repeated rows are moved, first_rows): an Arrow batch is unpacked into one padded
matrix of channels, worked on with numpy, and packed again. Null, NaN and the channel's missing code are no readings.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.spikes import channel_limits, channels_of, chunks, numeric_list, pad, per_channel
from chronoloom.storage import materialize


def first_rows(samples: DataFrame, *columns: str) -> DataFrame:
    """The earliest loaded row of each sample_id (repeated rows are the same but for loaded_at). Only the rows of repeated ids are
    shuffled; the ids, without the rest of their rows, are counted and written first, so that Spark knows their size when it plans
    the joins."""
    rows = samples.filter("sample_id is not null").select("sample_id", *dict.fromkeys(["loaded_at", *columns]))
    again = materialize(rows.groupBy("sample_id").count().filter("count > 1").select("sample_id"), "repeated")
    single = rows.join(again, "sample_id", "left_anti").select("sample_id", *columns)
    first = F.min_by(F.struct(*columns), F.struct("loaded_at"))
    return single.unionByName(rows.join(again, "sample_id", "left_semi").groupBy("sample_id").agg(first.alias("r")).select("sample_id", "r.*"))


def prepared(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """Once-only samples with the limits and missing codes of their channels."""
    return first_rows(samples, "dataset", "split", "label", "series").join(channel_limits(channels), "dataset", "left")


def fill_forward_back(x: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Each missing reading from the last before it, else from the first after it; a row without readings stays missing."""
    at = np.arange(x.shape[1])[None, :]
    held = ~np.isnan(x)
    left = np.maximum.accumulate(np.where(held, at, -1), axis=1)
    first = np.where(held.any(1), held.argmax(1), 0)[:, None]
    use = np.where(left >= 0, left, first)
    out = np.take_along_axis(x, use, axis=1) if x.size else x
    out[at >= lens[:, None]] = np.nan
    return out


def scale_min_max(x: np.ndarray, _: np.ndarray) -> np.ndarray:
    lo, hi = np.nanmin(x, axis=1, keepdims=True), np.nanmax(x, axis=1, keepdims=True)
    return (x - lo) / np.where(hi != lo, hi - lo, 1)


def scale_z(x: np.ndarray, _: np.ndarray) -> np.ndarray:
    sd = np.nanstd(x, axis=1, keepdims=True)
    return (x - np.nanmean(x, axis=1, keepdims=True)) / np.where(sd > 0, sd, 1)


def scale_l2(x: np.ndarray, _: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.nansum(x * x, axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def channels_long(rows: DataFrame, *steps: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """sample_id, var_id, t, value of prepared samples after the steps; one row per stored position, null where missing."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                row, var, x, lens = unpacked(b)
                with np.errstate(all="ignore"), warnings.catch_warnings():
                    warnings.simplefilter("ignore", RuntimeWarning)  # of channels without readings
                    for step in steps:
                        x = step(x, lens)
                at, t = np.nonzero(np.arange(x.shape[1])[None, :] < lens[:, None])
                ids = b.column("sample_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[at]], pa.int64()), pa.array(var[at], pa.int32()), pa.array(t, pa.int32()), pa.array(x[at, t], pa.float64(), from_pandas=True)], ["sample_id", "var_id", "t", "value"])

    return rows.filter("series is not null").select("sample_id", "series", "code").mapInArrow(kernel, "sample_id long, var_id int, t int, value double")


def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, var_id, padded readings and length of each channel of a batch."""
    row, var, inner = channels_of(b.column("series"))
    lens, flat = numeric_list(inner)
    x = pad(lens, flat)
    x[~np.isfinite(x)] = np.nan
    x[x == per_channel(b.column("code"), row, var)[:, None]] = np.nan
    return row, var, x, lens


def cubes(b: pa.RecordBatch, depth: int, length: int) -> np.ndarray:
    """Filled series of a batch of one dataset as samples x channels x steps; what no reading of the channel can fill is 0."""
    row, var, x, lens = unpacked(b)
    x = fill_forward_back(x, lens)
    out = np.full((b.num_rows, depth, length), np.nan)
    ok = var < depth
    width = min(length, x.shape[1])
    out[row[ok], var[ok], :width] = x[ok][:, :width]
    flat = out.reshape(-1, length)
    return np.nan_to_num(fill_forward_back(flat, np.full(len(flat), length)).reshape(out.shape))


def by_dataset(rows: DataFrame, channels: DataFrame, hyper: DataFrame, kernel: Callable[[np.ndarray, dict, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """kernel(cube, parameters of the dataset, ids) for the samples of one dataset in each batch; parameters travel as columns, no
    row moves between tasks."""
    names = [c.strip().split(" ")[0] for c in schema.replace("array<", "").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sets = whole.column("dataset").dictionary_encode()
            which = sets.indices.to_numpy(zero_copy_only=False)
            for k in np.unique(which):
                part = whole.filter(pa.array(which == k))
                for b in chunks(part, 400_000):
                    par = {c: b.column(c)[0].as_py() for c in b.schema.names if c not in ("series", "sample_id")}
                    cube = cubes(b, len(par["code"]), par["series_len"])
                    ids = b.column("sample_id").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(kernel(cube, par, ids), names)

    wide = rows.filter("series is not null").join(hyper, "dataset").filter("code is not null")
    return wide.select("sample_id", "series", "code", "series_len", *hyper.columns).mapInArrow(run, schema)


def window_starts(length: int, width: int, stride: int) -> np.ndarray:
    """First steps of the windows: int((length - width) / stride) + 1 of them, a partial last one is dropped."""
    return np.arange((length - width) // stride + 1) * stride if length >= width else np.zeros(0, int)


def window_covariances(cube: np.ndarray, width: int, stride: int) -> np.ndarray:
    """Sample covariance (n - 1) of the channels in each window: samples x windows x channels x channels."""
    start = window_starts(cube.shape[2], width, stride)
    view = np.lib.stride_tricks.sliding_window_view(cube, width, axis=2)[:, :, start].transpose(0, 2, 1, 3) if len(start) else np.zeros((len(cube), 0, cube.shape[1], width))
    centred = view - view.mean(-1, keepdims=True)
    return centred @ centred.swapaxes(-1, -2) / (width - 1)


def packed(m: np.ndarray) -> np.ndarray:
    """Upper triangles, row by row, of symmetric matrices in the last two axes."""
    i, j = np.triu_indices(m.shape[-1])
    return m[..., i, j]


def unpacked_symmetric(p: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((*p.shape[:-1], d, d))
    i, j = np.triu_indices(d)
    out[..., i, j] = p
    out[..., j, i] = p
    return out


def packed_index(i: int, j: int, d: int) -> int:
    """Place of the pair (i, j) in the packed triangle of a d x d matrix."""
    i, j = min(i, j), max(i, j)
    return i * d - i * (i - 1) // 2 + (j - i)


def ragged(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list array."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel()))


def window_covariance_rows(rows: DataFrame, channels: DataFrame, hyper: DataFrame) -> DataFrame:
    """sample_id, win_id, cov (packed) of each sample's windows, width and stride of its dataset."""

    def kernel(cube: np.ndarray, par: dict, ids: np.ndarray) -> list[pa.Array]:
        c = packed(window_covariances(cube, par["width"], par["stride"]))
        n, w, p = c.shape
        return [pa.array(np.repeat(ids, w), pa.int64()), pa.array(np.tile(np.arange(w, dtype=np.int32), n)), ragged(c.reshape(n * w, p))]

    return by_dataset(rows, channels, hyper.select("dataset", "width", "stride"), kernel, "sample_id long, win_id int, cov array<double>")


def encoded(df: DataFrame, column: str, out: str, within: tuple[str, ...] = (), trim: bool = True) -> DataFrame:
    """df with the alphabetical number, from 0, of the column's value (within a group of columns); null stays null. Only the
    distinct values are ordered."""
    key = F.lower(F.trim(column)) if trim else F.col(column)
    words = df.select(*within, key.alias("_word")).filter("_word is not null").distinct()
    codes = words.withColumn(out, (F.row_number().over(Window.partitionBy(*(within or [F.lit(0)])).orderBy("_word")) - 1).cast("int"))
    return df.withColumn("_word", key).join(codes, [*within, "_word"], "left").drop("_word")


def spread_hash(c: Column) -> Column:
    """An arithmetic hash in 0 .. 2^32 - 1 that SQL engines share."""
    return F.pmod(c * F.lit(2654435761), F.lit(4294967296))


def stratified(df: DataFrame, key: str, strata: list[str], share: float) -> DataFrame:
    """df with in_part: whether the row is among the first floor(share * rows) of its stratum in hash order. Ranks are made in
    two steps, over hash ranges and inside the one range where the cut falls, so a hot stratum is never ranked as a whole."""
    h = df.withColumn("_h", spread_hash(F.col(key))).withColumn("_step", F.floor(F.col("_h") / (1 << 22)))
    counts = h.groupBy(*strata, "_step").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*strata)
    counts = counts.withColumn("_before", F.sum("_n").over(w.orderBy("_step")) - F.col("_n")).withColumn("_want", F.floor(F.sum("_n").over(w) * share))
    joined = h.join(counts, [*strata, "_step"])
    rank = F.row_number().over(Window.partitionBy(*strata, "_step").orderBy("_h", key))
    return joined.withColumn("_rank", rank).withColumn("in_part", F.col("_before") + F.col("_rank") <= F.col("_want")).drop("_h", "_step", "_n", "_before", "_want", "_rank")
