"""Filling missing values from similar records: nearest-neighbour hot deck with donors flagged.

Records are put in order by a hash of their observed mixed features (dataset, label, quantised levels of their channels) and
cut into blocks of like records; the order is a range partitioning, so a dataset with a third of all rows is spread over many
tasks and a block never grows with the data. Within a block all distances are three matrix products over the cells that both
records hold. A missing cell takes the weighted median of the closest donors that hold the cell; a word (device, site) takes
the majority of its session, or else of the closest donors. What no donor of the block holds is taken from the nearest reading
of the same channel, then from the mean of the channel over all records. Implausible readings are not missing, so they are not
filled, but they give no value to others and count in no distance or mean.

Defined results: every missing cell of the grid given by channels (var_id x series_len) is reported and filled, also for a
null series; cells beyond the grid are ignored; records of datasets without channels have no grid; a repeated sample_id counts
once; words are null only if no record of the session, block or dataset holds one; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.numbers import known_word
from chronoloom.operators.spikes import channel_limits, channels_of, cuts, implausible, numeric_list, pad, per_channel
from chronoloom.storage import materialize

#: Stands for an implausible reading in the cells: held, but of no use to others.
ODD = np.inf
#: Records of a block, donors of a cell, and how many of the closest donors are looked at first.
BLOCK, DONORS, FIRST = 256, 5, 32
LEVELS = 16
FILL_SCHEMA = "sample_id long, field_name string, var_id int, t_pos int, value double, word string, method string, donors array<long>"
WORDS = ("device", "site")


def _spread(x: np.ndarray, bits: int, step: int) -> np.ndarray:
    out = np.zeros_like(x)
    for b in range(bits):
        out |= ((x >> b) & 1) << (b * step)
    return out


def level_code(means: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Interleaved bits of the first four channels' levels, each in LEVELS steps of its bounds: like records get near codes."""
    with np.errstate(invalid="ignore", divide="ignore"):
        q = np.clip(np.nan_to_num((means - lo) / (hi - lo) * LEVELS, nan=LEVELS / 2), 0, LEVELS - 1).astype(np.int64)
    code = np.zeros(len(q), np.int64)
    for v in range(min(4, q.shape[1])):
        code |= _spread(q[:, v], 4, 4) << v
    return code


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Series as one flat list of the grid's cells (NaN = missing), with the record's code."""
    for whole in batches:
        length = np.nan_to_num(whole.column("series_len").cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
        nvar, _ = numeric_list(whole.column("lo"))
        held = pc.fill_null(pc.list_value_length(whole.column("series")), 0).to_numpy(zero_copy_only=False)
        inner = np.append(pc.fill_null(pc.list_value_length(whole.column("series").flatten()), 0).to_numpy(zero_copy_only=False), 0)
        first = np.minimum(np.cumsum(held) - held, len(inner) - 1).astype(np.int64)
        longest = np.where(held > 0, np.maximum.reduceat(inner, first), 0) if len(held) else held
        for a, b in cuts(np.maximum(nvar, held), np.maximum(length, longest)):
            yield _prepared(whole.slice(a, b - a), length[a:b], nvar[a:b])


def _prepared(batch: pa.RecordBatch, length: np.ndarray, nvar: np.ndarray) -> pa.RecordBatch:
    n, width, depth = batch.num_rows, int(length.max(initial=0)), int(nvar.max(initial=0))
    cube = np.full((n, depth, width), np.nan)
    row, var, inner = channels_of(batch.column("series"))
    values = pad(*numeric_list(inner), width=width) if width else np.zeros((len(row), 0))
    values[~np.isfinite(values)] = np.nan
    values[values == per_channel(batch.column("code"), row, var)[:, None]] = np.nan
    values[implausible(values, per_channel(batch.column("lo"), row, var), per_channel(batch.column("hi"), row, var))] = ODD
    ok = var < nvar[row]
    cube[row[ok], var[ok]] = values[ok]
    inside = (np.arange(depth)[None, :, None] < nvar[:, None, None]) & (np.arange(width)[None, None, :] < length[:, None, None])
    rows, every = np.repeat(np.arange(n), depth), np.tile(np.arange(depth), n)
    lo, hi = (per_channel(batch.column(c), rows, every).reshape(n, depth) for c in ("lo", "hi"))
    held = np.isfinite(cube)
    with np.errstate(invalid="ignore"):
        means = np.where(held, cube, 0).sum(2) / held.sum(2)
    offsets = np.concatenate([[0], np.cumsum(inside.sum((1, 2)))]).astype(np.int32)
    cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cube[inside]))
    names = ["sample_id", "session_id", "device", "site", "dataset", "label"]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(level_code(means, lo, hi)), pa.array(length.astype(np.int32)), cells], [*names, "code", "series_len", "cells"])


def _channel_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sum and sum of squares per dataset and channel of each batch."""
    for batch in batches:
        lens, flat = numeric_list(batch.column("cells"))
        length = np.maximum(batch.column("series_len").to_numpy(zero_copy_only=False).astype(np.int64), 1)
        parent = np.repeat(np.arange(len(lens)), lens)
        var = (np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)) // length[parent]
        names = pc.dictionary_encode(batch.column("dataset"))
        key = names.indices.to_numpy(zero_copy_only=False)[parent] * 100_000 + var
        held = np.isfinite(flat)
        keys, at = np.unique(key[held], return_inverse=True)
        x = flat[held]
        out = [np.bincount(at, minlength=len(keys)).astype(float), np.bincount(at, x, len(keys)), np.bincount(at, x * x, len(keys))]
        words = names.dictionary.take(pa.array(keys // 100_000, pa.int64()))
        yield pa.RecordBatch.from_arrays([words, pa.array((keys % 100_000).astype(np.int32)), *map(pa.array, out)], ["dataset", "var_id", "n", "s", "q"])


def weighted_median(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Lower weighted median of each row; entries of weight 0 don't count."""
    order = np.argsort(np.where(weights > 0, values, np.inf), axis=1, kind="stable")
    v, w = np.take_along_axis(values, order, 1), np.take_along_axis(weights, order, 1)
    half = w.sum(1, keepdims=True) / 2
    at = (np.cumsum(w, axis=1) >= half - 1e-12).argmax(1)
    return v[np.arange(len(v)), at]


def _nearest_in_series(x: np.ndarray) -> np.ndarray:
    """Rows with each NaN replaced by the nearest reading of the row (earlier on ties), NaN where there is none."""
    n, width = x.shape
    at = np.arange(width)[None, :]
    held = ~np.isnan(x)
    left = np.maximum.accumulate(np.where(held, at, -1), axis=1)
    right = np.minimum.accumulate(np.where(held, at, 10**9)[:, ::-1], axis=1)[:, ::-1]
    use = np.where((left >= 0) & ((right >= 10**9) | (at - left <= right - at)), left, right)
    return np.where(use < 10**9, x[np.arange(n)[:, None], np.clip(use, 0, max(width - 1, 0))], np.nan)


def fill_block(ids: np.ndarray, x: np.ndarray, length: int, mean: np.ndarray, sd: np.ndarray, donors: int = DONORS) -> dict[str, np.ndarray]:
    """Fill the missing cells of one block of records of one dataset. x: records x cells (channel after channel), NaN where missing."""
    n, cells = x.shape
    var = np.arange(cells) // max(length, 1)
    missing, held = np.isnan(x), np.isfinite(x)
    x = np.where(held, x, np.nan)
    need = np.flatnonzero(missing.any(1))
    z = np.where(held, (x - mean[var]) / np.where(sd[var] > 0, sd[var], 1), 0).astype(np.float32)
    h = held.astype(np.float32)
    zz = z * z
    with np.errstate(invalid="ignore", divide="ignore"):
        d = (zz[need] @ h.T - 2 * z[need] @ z.T + h[need] @ zz.T) / (h[need] @ h.T)
    d = np.nan_to_num(np.maximum(d, 0), nan=1e9, posinf=1e9)
    d[np.arange(len(need)), need] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, : max(n - 1, 1)]
    r, c = np.nonzero(missing[need])
    value, used = np.full(len(r), np.nan), np.full((len(r), donors), -1)

    def take(which: np.ndarray, width: int) -> np.ndarray:
        """Fills these cells from the closest so many records; says which have all donors they may have."""
        near = order[r[which], :width]
        has = held[near, c[which][:, None]] & (near != need[r[which]][:, None])
        rank = np.cumsum(has, axis=1)
        pick = has & (rank <= donors)
        at, col = np.nonzero(pick)
        slot = rank[at, col] - 1
        who = np.full((len(which), donors), -1)
        who[at, slot] = near[at, col]
        real = who >= 0
        dist = np.take_along_axis(d[r[which]], np.maximum(who, 0), 1)
        weight = np.where(real, 1 / (0.01 + np.where(real, dist, 1)), 0)
        some = real.any(1)
        if some.any():
            value[which[some]] = weighted_median(x[np.maximum(who, 0), c[which][:, None]][some], weight[some])
        used[which] = who
        return real.all(1)

    every = np.arange(len(r))
    if n > 1 and len(every):
        short = every[~take(every, FIRST)]
        for k in range(0, len(short) if n - 1 > FIRST else 0, 8192):
            take(short[k : k + 8192], n)
    method = np.where(np.isnan(value), "series", "donor").astype(object)
    lost = np.isnan(value)
    if lost.any():
        near = _nearest_in_series(x[need].reshape(-1, length)).reshape(len(need), cells)
        value[lost] = near[r[lost], c[lost]]
        still = np.isnan(value)
        value[still] = mean[var[c[still]]]
        method[still] = "channel"
    return {"row": need[r], "var": var[c], "pos": c % max(length, 1), "value": value, "method": method, "used": used, "near": order, "need": need}


def _majority(words: list, near: np.ndarray, donors: int) -> tuple[str | None, list[int]]:
    """The word most of the closest donors have (ties: the closest one's)."""
    seen = [j for j in near if words[j] is not None][:donors]
    votes: dict[str, int] = {}
    for j in seen:
        votes[words[j]] = votes.get(words[j], 0) + 1
    best = max(votes, key=lambda w: votes[w], default=None)
    return best, [j for j in seen if words[j] == best]


def _fill_rows(block: pa.Table) -> Iterator[pa.RecordBatch]:
    ids = block.column("sample_id").to_numpy()
    length = int(block.column("series_len")[0].as_py())
    lens, flat = numeric_list(block.column("cells").combine_chunks())
    x = pad(lens, flat)
    depth = x.shape[1] // length if length else 0
    mean, sd = (np.nan_to_num(np.array(block.column(c)[0].as_py() or [0.0] * depth, float)) for c in ("mean", "sd"))
    out, plain = [], np.where(np.isfinite(x), x, np.nan)
    if x.shape[1]:
        f = fill_block(ids, x, length, mean, sd)
        m = len(f["row"])
        keep = f["used"] >= 0
        offsets = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
        who = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[f["used"][keep]].astype(np.int64)))
        out.append([ids[f["row"]], np.full(m, "x", object), f["var"], f["pos"], f["value"], np.full(m, None, object), f["method"], who])
    for field in WORDS:
        words, session = block.column(field).to_pylist(), block.column(f"session_{field}").to_pylist()
        lost = [i for i, w in enumerate(words) if w is None]
        if not lost:
            continue
        got = []
        for i in lost:
            if session[i] is not None:
                got.append((session[i], "session", []))
                continue
            gap = np.abs(np.nan_to_num(plain - plain[i])).sum(1) if x.shape[1] else np.zeros(len(ids))
            word, who = _majority(words, np.argsort(gap, kind="stable"), DONORS)
            got.append((word, "donor", [int(ids[j]) for j in who]) if word is not None else (block.column(f"common_{field}")[i].as_py(), "dataset", []))
        k = len(lost)
        minus = np.full(k, -1)
        out.append([ids[lost], np.full(k, field, object), minus, minus, np.full(k, np.nan), [g[0] for g in got], [g[1] for g in got], pa.array([g[2] for g in got], pa.list_(pa.int64()))])
    for cols in out:
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.list_(pa.int64())]
        arrays = [a if isinstance(a, pa.Array) else pa.array(a, t, from_pandas=True) for a, t in zip(cols, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, [p.split()[0] for p in FILL_SCHEMA.split(", ")])


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the ordered rows of a partition into blocks of one dataset, without repeated sample_ids, and fill each."""
    held: list[pa.RecordBatch] = []
    last: int | None = None

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        table = pa.Table.from_batches(held)
        names = table.column("dataset").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        rest = None
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = a
            while b - k > 0:
                left = b - k
                if b == len(names) and not final and left < 2 * BLOCK:
                    rest = table.slice(k)
                    break
                size = left if left < 1.5 * BLOCK else BLOCK
                yield from _fill_rows(table.slice(k, size))
                k += size
        held = rest.combine_chunks().to_batches() if rest is not None and rest.num_rows else []

    for batch in batches:
        ids = batch.column("sample_id").to_numpy(zero_copy_only=False)
        fresh = np.ones(len(ids), bool)
        fresh[1:] = ids[1:] != ids[:-1]
        if len(ids):
            fresh[0] = ids[0] != last
            last = ids[-1]
        batch = batch.filter(pa.array(fresh))
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= 2 * BLOCK:
            yield from flush(False)
    if held:
        yield from flush(True)


def hot_deck(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """One row per missing cell of the samples, with the value put in, how it was found and from which records."""
    clean = samples.filter(F.col("sample_id").isNotNull()).select("sample_id", "session_id", *(known_word(F.col(c)).alias(c) for c in WORDS), "dataset", "label", "series")
    ready = clean.join(channel_limits(channels), "dataset", "left").mapInArrow(_prepare, "sample_id long, session_id long, device string, site string, dataset string, label int, code long, series_len int, cells array<double>")
    ready = materialize(ready, "hotdeck")
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    per = ready.select("dataset", "series_len", "cells").mapInArrow(_channel_sums, "dataset string, var_id int, n double, s double, q double").groupBy("dataset", "var_id").agg((s / n).alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("sd"))
    ladder = F.sequence(F.lit(0), F.max("var_id"))
    known = F.map_from_entries(F.collect_list(F.struct("var_id", F.struct("mean", "sd"))))
    stats = per.groupBy("dataset").agg(ladder.alias("k"), known.alias("m")).select("dataset", F.transform("k", lambda v: F.try_element_at("m", v)).alias("x")).select("dataset", F.col("x.mean").alias("mean"), F.col("x.sd").alias("sd"))
    for field in WORDS:
        votes = ready.filter(F.col(field).isNotNull()).groupBy("dataset", "session_id", field).agg(F.count("*").alias("n"))
        best = F.max_by(field, F.struct("n", field))
        mates = votes.filter(F.col("session_id").isNotNull()).groupBy("session_id", field).agg(F.sum("n").alias("n")).groupBy("session_id").agg(best.alias(f"session_{field}"))
        common = votes.groupBy("dataset", field).agg(F.sum("n").alias("n")).groupBy("dataset").agg(best.alias(f"common_{field}"))
        ready = ready.join(mates, "session_id", "left").join(common, "dataset", "left")
    ordered = ready.join(stats, "dataset", "left").repartitionByRange("dataset", F.coalesce("label", F.lit(-1)), "code", "sample_id").sortWithinPartitions("dataset", F.coalesce("label", F.lit(-1)), "code", "sample_id")
    return ordered.drop("session_id", "label", "code").mapInArrow(_fill, FILL_SCHEMA)


def masked_error(samples: DataFrame, channels: DataFrame, every: int = 20) -> DataFrame:
    """How good the filled values are: about one of `every` cells, chosen by hash, is hidden, and what is put into those that held a
    reading is compared with it. dataset, n_cells, and the mean absolute errors, in standard deviations of the dataset's channel, of
    the filled values and of the channel's mean."""
    from chronoloom.operators.series import channels_long, prepared

    chosen = lambda v, t: F.pmod(F.xxhash64("sample_id", v, t), F.lit(every)) == 0
    hide = F.transform("series", lambda c, v: F.transform(c, lambda x, t: F.when(~chosen(v, t), x)))
    filled = hot_deck(samples.withColumn("series", hide), channels).filter("field_name = 'x'").select("sample_id", "var_id", F.col("t_pos").alias("t"), F.col("value").alias("filled"))
    rows = prepared(samples, channels)
    truth = channels_long(rows).filter("value is not null").join(rows.select("sample_id", "dataset"), "sample_id")
    stats = truth.groupBy("dataset", "var_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    both = truth.filter(chosen(F.col("var_id"), F.col("t"))).join(filled, ["sample_id", "var_id", "t"]).join(stats, ["dataset", "var_id"]).filter("sd > 0")
    gap = lambda c: F.avg(F.abs(F.col(c) - F.col("value")) / F.col("sd"))
    return both.groupBy("dataset").agg(F.count("*").alias("n_cells"), gap("filled").alias("error_filled"), gap("mean").alias("error_mean"))
