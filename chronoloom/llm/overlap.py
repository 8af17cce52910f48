"""The same or nearly the same record in two splits, by a compressed full-text index of the evaluation records.

Readings become symbols, so a channel is a text; missing cells and implausible readings part its words. The step of the symbols
is a power of two between WIDE / 2 and WIDE standard deviations of the evaluation record's channel, so it is several times the tolerance;
channels of fewer than FEW readings are kept in a second grid as well, shifted by half a step, since a pair of readings that a border
parts in one is together in the other. Equal records of a split are collapsed to a class first.

Index: evaluation classes are indexed in shards of SHARD, once, and the indexes are written to the shared folder. For each channel,
step and grid a shard has a Burrows-Wheeler transform in a wavelet matrix of packed bits with counts per word, and every SAMPLE-th
place of the suffix array. Training classes are streamed through the shards in blocks of BLOCK, with the steps that are next to
their own: backward search finds all places of the SEED symbols that end at every EVERY-th position; of words that are shorter, on
either side, the places of the whole word. Matches of one pair and one misalignment are merged to maximal spans and counted. Pairs whose
spans cover enough are compared in symbols (readings that agree are at most one step apart), and what passes is joined with the
readings of both and compared reading by reading. Classes without any word of LEAST_WORD symbols can't be searched: they are
compared directly, in blocks. split_overlaps() opens the classes to their members at the end, by joins.

Defined results: a repeated sample_id counts once (with the smallest of its digests, should they differ); records of neither
split, without dataset, or with a null series are in no pair; channels with fewer than 5 comparable cells don't decide, and one must;
the standard deviation is that of the evaluation record's channel over its plausible readings; empty tables give no pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.distances import meet
from chronoloom.operators.spikes import channel_limits, chunks, clean_matrix, numeric_list, pad
from chronoloom.storage import materialize, release

SEED, LEAST_WORD, COVER, SHIFT, WIDE, SAMPLE, EVERY, FEW = 8, 3, 12, 3, 0.5, 8, 2, 24
MATCHES = 2_000_000
SHARD, BLOCK = 32_768, 4_096
AGREE, TOLERANCE, LEAST = 0.9, 0.05, 5
#: Symbols: the end of the text, a gap, then the steps. NEVER occurs in no text.
END, GAP, NEVER = 0, 1, -1


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plausible readings of each record as a flat list (channels x width, NaN elsewhere), and a digest of them."""
    for whole in batches:
        for b in chunks(whole):
            row, var, values, case = clean_matrix(b)
            values[case] = np.nan
            n = np.bincount(row, minlength=b.num_rows)
            width = values.shape[1]
            bounds = np.concatenate([[0], np.cumsum(n)])
            digests = []
            for i in range(b.num_rows):
                own = values[bounds[i] : bounds[i + 1]]
                used = int(np.flatnonzero(~np.isnan(own).all(0)).max(initial=-1)) + 1 if own.size else 0
                digests.append(xxhash.xxh3_128_digest(np.ascontiguousarray(np.nan_to_num(own[:, :used], nan=1e308)).tobytes() + bytes([len(own) % 251, used % 251])))
            cells = pa.ListArray.from_arrays(pa.array((bounds * width).astype(np.int32)), pa.array(values.ravel()))
            names = ["sample_id", "dataset", "split"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(digests, pa.binary()), pa.array(np.full(b.num_rows, width, np.int32)), cells], [*names, "digest", "width", "cells"])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the text in the order of their suffixes, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else 0
        key = rank * (n + 300) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class PackedBits:
    """Bits in words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        full = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        full[: len(bits)] = bits
        self.words = np.packbits(full, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)[:-1]]).astype(np.uint32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


class TextIndex:
    """Backward search over one text, whose last symbol is END and occurs nowhere else."""

    def __init__(self, text: np.ndarray) -> None:
        self.n = len(text)
        suffixes = suffix_array(text)
        bwt = text[suffixes - 1].astype(np.int64)
        size = int(text.max()) + 1
        self.depth = max(1, (size - 1).bit_length())
        self.levels, self.zeros = [], []
        rest = bwt
        for k in range(self.depth - 1, -1, -1):
            bit = (rest >> k) & 1 > 0
            self.levels.append(PackedBits(bit))
            self.zeros.append(int((~bit).sum()))
            rest = np.concatenate([rest[~bit], rest[bit]])
        #: Where a symbol's suffixes begin, less where its occurrences begin in the last level of the matrix.
        every = np.arange(size)
        first = np.searchsorted(np.sort(bwt), every)
        self.shift = first - self._follow(every, np.zeros(size, np.int64))
        marked = suffixes % SAMPLE == 0
        self.marked, self.places = PackedBits(marked), suffixes[marked].astype(np.int32)
        self.size = size
        if size <= 256:  # ranges of all pairs of symbols, with which every search begins
            a, b = np.divmod(np.arange(size * size), size)
            lo, hi = self.extend(b, np.zeros(len(b), np.int64)), self.extend(b, np.full(len(b), self.n))
            self.pairs = self.extend(a, lo).astype(np.int32), self.extend(a, hi).astype(np.int32)
        else:
            self.pairs = None

    def _follow(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = level.ones(i)
            i = np.where((c >> (self.depth - 1 - k)) & 1 > 0, zeros + one, i - one)
        return i

    def extend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Suffixes before the i-th of those that begin with symbol c, counted over all suffixes."""
        return self.shift[c] + self._follow(c, i)

    def back(self, row: np.ndarray) -> np.ndarray:
        """The suffix that is one symbol longer."""
        c = np.zeros(len(row), np.int64)
        i = row
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit, one = level.at(i), level.ones(i)
            c = 2 * c + bit
            i = np.where(bit, zeros + one, i - one)
        return self.shift[c] + i

    def _known(self, c: np.ndarray) -> np.ndarray:
        return (c > GAP) & (c < self.size)

    def ranges(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes (from, to) that begin with text[e - length + 1 .. e], for each end e that has any: (number of the end, from, to)."""
        who = np.flatnonzero(ends >= length - 1)
        last = text[ends[who]].astype(np.int64)
        ok = self._known(last)
        who, last = who[ok], last[ok]
        if length < 2 or self.pairs is None:
            lo, hi, first = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64), 0
        else:
            before = text[ends[who] - 1].astype(np.int64)
            ok = self._known(before)
            who, lo, hi = self._paired(who[ok], before[ok], last[ok])
            first = 2
        for step in range(first, length):
            who, lo, hi = self._further(text, ends, who, lo, hi, step)
        return who, lo, hi

    def _paired(self, who: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = a * self.size + b
        lo, hi = self.pairs[0][key].astype(np.int64), self.pairs[1][key].astype(np.int64)
        ok = hi > lo
        return who[ok], lo[ok], hi[ok]

    def _further(self, text: np.ndarray, ends: np.ndarray, who: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = ends[who] >= step
        who, lo, hi = who[ok], lo[ok], hi[ok]
        c = text[ends[who] - step].astype(np.int64)
        ok = self._known(c)
        who, lo, hi, c = who[ok], lo[ok], hi[ok], c[ok]
        lo, hi = self.extend(c, lo), self.extend(c, hi)
        ok = hi > lo
        return who[ok], lo[ok], hi[ok]

    def whole_words(self, text: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each of the lengths: (length, number of the end, from, to) of the suffixes that begin with a gap, text[e - length + 1 .. e]
        and a gap: words of this length that the indexed text has as a whole."""
        who = np.arange(len(ends))
        last = text[ends].astype(np.int64)
        ok = self._known(last)
        who, last = who[ok], last[ok]
        gap = np.full(len(who), GAP)
        if self.pairs is None:
            lo, hi = self.extend(gap, np.zeros(len(who), np.int64)), self.extend(gap, np.full(len(who), self.n, np.int64))
            lo, hi = self.extend(last, lo), self.extend(last, hi)
            ok = hi > lo
            who, lo, hi = who[ok], lo[ok], hi[ok]
        else:
            who, lo, hi = self._paired(who, last, gap)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            if step in lengths:
                gap = np.full(len(who), GAP)
                a, b = self.extend(gap, lo), self.extend(gap, hi)
                ok = b > a
                yield step, who[ok], a[ok], b[ok]
            who, lo, hi = self._further(text, ends, who, lo, hi, step)

    def places_of(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the range, position in the indexed text) of all suffixes of the ranges."""
        size = hi - lo
        row = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        out, todo, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        while len(todo):
            here = self.marked.at(row)
            out[todo[here]] = self.places[self.marked.ones(row[here])] + steps
            todo, row, steps = todo[~here], self.back(row[~here]), steps + 1
        return np.repeat(np.arange(len(lo)), size), out


def cube_of(width: np.ndarray, lens: np.ndarray, flat: np.ndarray, depth: int, steps: int) -> np.ndarray:
    """Lists of channels x own width as one array records x depth x steps."""
    out = np.full((len(lens), depth, steps), np.nan)
    start = np.cumsum(lens) - lens
    for w in np.unique(width):
        which = np.flatnonzero((width == w) & (lens > 0))
        if w == 0 or not len(which):
            continue
        m = pad(lens[which], np.concatenate([flat[start[i] : start[i] + lens[i]] for i in which]))
        d = min(m.shape[1] // w, depth)
        k = min(int(w), steps)
        out[which, :d, :k] = m[:, : d * w].reshape(len(which), d, w)[:, :, :k]
    return out


def _cube(t: pa.Table, name: str = "cells", width: str = "width") -> np.ndarray:
    lens, flat = numeric_list(t.column(name).combine_chunks())
    own = t.column(width).to_numpy().astype(np.int64)
    return cube_of(own, lens, flat, int((lens // np.maximum(own, 1)).max(initial=0)), int(own.max(initial=0)))


def deviations(x: np.ndarray) -> np.ndarray:
    """Standard deviation of each channel over its readings (NaN without any)."""
    held = ~np.isnan(x)
    count = held.sum(2)
    z = np.where(held, x, 0)
    mean = z.sum(2) / np.maximum(count, 1)
    sd = np.sqrt((np.where(held, z - mean[:, :, None], 0) ** 2).sum(2) / np.maximum(count, 1))
    return np.where(count > 0, sd, np.nan)


def scales(x: np.ndarray) -> np.ndarray:
    """Exponent of each channel's step; a channel of equal readings gets one of a millionth of their size."""
    sd = deviations(x)
    size = np.nanmax(np.abs(np.where(np.isnan(x), 0, x)), axis=2, initial=0)
    use = np.where(sd > 1e-9 * size, sd, 1e-6 * np.maximum(size, 1e-200))
    return np.floor(np.log2(WIDE * np.where(np.isfinite(use) & (use > 0), use, 1.0))).astype(np.int64)


def symbols(x: np.ndarray, exponent: np.ndarray | int, grid: int) -> np.ndarray:
    """Number of the step of each reading, NaN where there is none."""
    return np.floor(np.ldexp(x, -np.asarray(exponent)) + grid / 2)


def words_of(held: np.ndarray) -> np.ndarray:
    """Length of the word that ends at each cell of the last axis (0 where no word ends)."""
    at = np.arange(held.shape[-1])
    last_gap = np.maximum.accumulate(np.where(held, -1, at), axis=-1)
    ends = held & ~np.concatenate([held[..., 1:], np.zeros((*held.shape[:-1], 1), bool)], axis=-1)
    return np.where(ends, at - last_gap, 0)


class Shard:
    """The indexes of one shard of evaluation records."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.scale = ids, scales(x)
        self.levels = symbols(x, self.scale[:, :, None], 0)
        held = ~np.isnan(x)
        self.present = held.sum((1, 2))
        top = np.abs(np.where(held, self.levels, 0)).max(initial=0)
        if top < 32_000:  # two bytes a reading
            self.levels = np.where(held, self.levels, 32_767).astype(np.int16)
        gap = x.shape[2] + 1
        word = words_of(held)
        self.parts: dict[tuple[int, int, int], list] = {}
        for v in range(x.shape[1]):
            for e in np.unique(self.scale[:, v][held[:, v].any(1)]):
                rows = np.flatnonzero((self.scale[:, v] == e) & held[:, v].any(1))
                short = np.unique(word[rows, v])
                short = short[(short >= LEAST_WORD) & (short < SEED)]
                for g in (0, 1):
                    if g:
                        rows = rows[held[rows, v].sum(1) < FEW]
                    if not len(rows):
                        continue
                    q = symbols(x[rows, v], int(e), g)
                    known = np.unique(q[~np.isnan(q)])
                    text = np.full((len(rows), gap), GAP, np.int64)
                    text[:, :-1] = np.where(np.isnan(q), GAP, np.searchsorted(known, np.nan_to_num(q)) + 2)
                    self.parts[v, int(e), g] = [rows.astype(np.int32), short, known, TextIndex(np.concatenate([[GAP], text.ravel(), [END]]))]
        self.gap = gap

    def candidates(self, x: np.ndarray, most: int = MATCHES) -> Iterator[np.ndarray]:
        """Rows (row of x, row of the shard, misalignment) whose matches cover enough, for so many rows of x at a time as have about
        `most` matches together."""
        n, depth, width = x.shape
        own, held = scales(x), ~np.isnan(x)
        word, count = words_of(held), held.sum(2)
        found, total = [], np.zeros(n, np.int64)
        for (v, e, g), (rows, short, known, index) in self.parts.items():
            if v >= depth:
                continue
            near = np.flatnonzero((np.abs(own[:, v] - e) <= 1) & ((g == 0) | (count[:, v] < 2 * FEW)))
            if not len(near):
                continue
            q = symbols(x[near, v], e, g)
            at = np.clip(np.searchsorted(known, np.nan_to_num(q)), 0, len(known) - 1)
            text = np.full((len(near), width + 1), GAP, np.int64)
            text[:, :-1] = np.where(np.isnan(q), GAP, np.where(known[at] == q, at + 2, NEVER))
            flat = text.ravel()
            ends = np.flatnonzero(flat > GAP)
            own_words = np.concatenate([word[near, v], np.zeros((len(near), 1), int)], axis=1).ravel()
            hits = []
            for where, length in [(ends[ends % (width + 1) % EVERY == 0], SEED)] + [(np.flatnonzero(own_words == k), k) for k in range(LEAST_WORD, SEED)]:
                who, lo, hi = index.ranges(flat, where, length)
                hits.append((where[who], lo, hi, length, 0))
            if len(short):
                hits += [(ends[who], lo, hi, length, 1) for length, who, lo, hi in index.whole_words(flat, ends, short)]
            for end, lo, hi, length, closed in hits:
                if len(end):
                    row = near[end // (width + 1)]
                    order = np.argsort(row, kind="stable")
                    found.append((index, rows, v, g, length, closed, row[order], (end % (width + 1))[order], lo[order], hi[order]))
                    total += np.bincount(row, hi - lo, n).astype(np.int64)
        part = np.cumsum(total) // most
        k = 2 * SHIFT + 1
        for p in np.unique(part):
            first, last = np.searchsorted(part, p), np.searchsorted(part, p, side="right")
            got = []
            for index, rows, v, g, length, closed, row, end, lo, hi in found:
                a, b = np.searchsorted(row, first), np.searchsorted(row, last)
                who, place = index.places_of(lo[a:b], hi[a:b])
                place = place + closed - 1  # the indexed text begins with a gap
                begin = place % self.gap
                shift = begin - (end[a:b][who] - length + 1)
                ok = np.abs(shift) <= SHIFT
                pair = (row[a:b][who[ok]] * len(self.ids) + rows[place[ok] // self.gap]) * k + shift[ok] + SHIFT
                got.append(np.stack([pair, (v * 2 + g) * self.gap * 2 + end[a:b][who[ok]], np.full(len(pair), length)], axis=1))
            got = np.concatenate(got) if got else np.zeros((0, 3), np.int64)
            if not len(got):
                continue
            got = got[np.lexsort((-got[:, 2], got[:, 1], got[:, 0]))]
            line = got[:, 1] // (2 * self.gap)
            same = np.concatenate([[False], (got[1:, 0] == got[:-1, 0]) & (line[1:] == line[:-1])])
            step = np.concatenate([[0], got[1:, 1] - got[:-1, 1]])
            grown = np.where(same, np.minimum(step, got[:, 2]), got[:, 2])
            key, where = np.unique(got[:, 0], return_index=True)
            cover = np.add.reduceat(grown, where)
            key_row, key_test = key // k // len(self.ids), key // k % len(self.ids)
            enough = cover >= np.minimum(COVER, self.present[key_test] // 4)
            yield np.stack([key_row, key_test, key % k - SHIFT], axis=1)[enough]

    def alike(self, x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Which pairs may hold the same recording: readings that agree are at most one step apart."""
        out = np.zeros(len(pairs), bool)
        width, depth = min(x.shape[2], self.levels.shape[2]), min(x.shape[1], self.levels.shape[1])
        none = self.levels.dtype == np.int16
        for s in range(-SHIFT, SHIFT + 1):
            which = np.flatnonzero(pairs[:, 2] == s)
            lo, hi = max(0, -s), min(width, width - s)
            if hi <= lo:
                continue
            for k in range(0, len(which), 4096):
                part = which[k : k + 4096]
                test = pairs[part, 1]
                y = self.levels[test][:, :depth, lo + s : hi + s]
                a = np.floor(np.ldexp(x[pairs[part, 0]][:, :depth, lo:hi], -self.scale[test][:, :depth, None]))
                both = ~np.isnan(a) & ((y < 32_767) if none else ~np.isnan(y))
                n = both.sum(2)
                with np.errstate(invalid="ignore"):
                    close = (both & (np.abs(a - y) <= 1)).sum(2)
                decides = n >= LEAST
                out[part] = decides.any(1) & (~decides | (close >= AGREE * n - 1e-9)).all(1)
        return out


def agreeing(a: np.ndarray, b: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which pairs (row of a, row of b, misalignment) hold the same recording. a, b: records x channels x width."""
    sd = np.full(b.shape[:2], np.nan)
    held = ~np.isnan(b)
    count = held.sum(2)
    z = np.where(held, b, 0).astype(np.float64)
    mean = z.sum(2) / np.maximum(count, 1)
    sd = np.sqrt((np.where(held, z - mean[:, :, None], 0) ** 2).sum(2) / np.maximum(count, 1))
    out = np.zeros(len(pairs), bool)
    width = a.shape[2]
    for s in range(-SHIFT, SHIFT + 1):
        which = np.flatnonzero(pairs[:, 2] == s)
        lo, hi = max(0, -s), min(width, width - s)
        if hi <= lo:
            continue
        for k in range(0, len(which), 4096):
            part = which[k : k + 4096]
            x, y = a[pairs[part, 0]][:, :, lo:hi], b[pairs[part, 1]][:, :, lo + s : hi + s]
            gap = np.abs(x - y)
            both = ~np.isnan(gap)
            n = both.sum(2)
            with np.errstate(invalid="ignore"):
                close = (both & (gap <= (TOLERANCE + 1e-9) * sd[pairs[part, 1]][:, :, None])).sum(2)
            decides = n >= LEAST
            out[part] = decides.any(1) & (~decides | (close >= AGREE * n - 1e-9)).all(1)
    return out


def _indexed(t: pa.Table) -> pa.Table:
    ids = t.column("rep").to_numpy()
    order = np.argsort(ids)
    return pa.table({"dataset": t.column("dataset").slice(0, 1), "shard": t.column("shard").slice(0, 1), "index": pa.array([pickle.dumps(Shard(ids[order], _cube(t)[order]))], pa.binary())})


def _searched(train: pa.Table, shard: pa.Table) -> pa.Table:
    rows = [np.zeros((0, 3), np.int64)]
    if train.num_rows and shard.num_rows:
        index: Shard = pickle.loads(shard.column("index")[0].as_py())  # noqa: S301
        ids, x = train.column("rep").to_numpy(), _cube(train)
        if x.size:
            for pairs in index.candidates(x):
                pairs = pairs[index.alike(x, pairs)]
                rows.append(np.stack([ids[pairs[:, 0]], index.ids[pairs[:, 1]], pairs[:, 2]], axis=1))
    got = np.concatenate(rows)
    return pa.table({"train": pa.array(got[:, 0], pa.int64()), "test": pa.array(got[:, 1], pa.int64()), "shift": pa.array(got[:, 2].astype(np.int32))})


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """train, test of the joined candidates that hold the same recording."""
    for whole in batches:
        step = max(1, 4_000_000 // max(1, int(whole.column("width").to_numpy().max(initial=0)) * 64))
        for k in range(0, whole.num_rows, step):
            b = pa.Table.from_batches([whole.slice(k, step)])
            x, y = _cube(b), _cube(b, "t_cells", "t_width")
            depth, width = max(x.shape[1], y.shape[1]), max(x.shape[2], y.shape[2])
            x, y = (np.pad(z, ((0, 0), (0, depth - z.shape[1]), (0, width - z.shape[2])), constant_values=np.nan) for z in (x, y))
            at = np.arange(len(x))
            ok = pa.array(agreeing(x, y, np.stack([at, at, b.column("shift").to_numpy().astype(np.int64)], axis=1)))
            yield from b.select(["train", "test"]).filter(ok).to_batches()


def _directly(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """i, j of all pairs of two blocks that hold the same recording, by comparing each with each."""
    depth = max((len(c) // max(w, 1) for f in (x, y) for c, w in zip(f.vec, f.width, strict=True)), default=0)
    width = max(int(x.width.max()), int(y.width.max()))
    a, b = (cube_of(f.width.to_numpy(np.int64), f.vec.str.len().to_numpy(np.int64), np.concatenate(list(f.vec)), depth, width) for f in (x, y))
    found = [np.zeros((0, 2), np.int64)]
    for i in range(len(a)):
        j = np.arange(len(b))
        some = np.zeros(len(b), bool)
        for s in range(-SHIFT, SHIFT + 1):
            some |= agreeing(a, b, np.stack([np.full(len(b), i), j, np.full(len(b), s)], axis=1))
        found.append(np.stack([np.full(some.sum(), x.id.iloc[i]), y.id.to_numpy()[some]], axis=1))
    got = np.concatenate(found)
    return pd.DataFrame({"train": got[:, 0], "test": got[:, 1]})


def _searchable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes with whether a channel has a word that can be searched."""
    for b in batches:
        x = _cube(pa.Table.from_batches([b]))
        ok = (words_of(~np.isnan(x)) >= LEAST_WORD).any((1, 2)) if x.size else np.zeros(b.num_rows, bool)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok)], [*b.schema.names, "searchable"])


def records_of(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """sample_id, dataset, split, digest, width, cells of the records that can be in a pair."""
    rows = samples.filter("sample_id is not null and dataset is not null and split in ('train', 'test') and series is not null")
    wide = rows.select("sample_id", "dataset", "split", "series").join(channel_limits(channels), "dataset", "left").select("sample_id", "dataset", "split", "series", "lo", "hi", "code")
    return materialize(wide.mapInArrow(_records, "sample_id long, dataset string, split string, digest binary, width int, cells array<double>"), "records")


def class_overlaps(samples: DataFrame, channels: DataFrame, shard: int = SHARD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the classes that hold the same recording, by their representatives, and the members (sample_id, rep)."""
    records = records_of(samples, channels)
    cells = F.first(F.struct("width", "cells")).alias("c")
    classes = records.groupBy("dataset", "split", "digest").agg(F.min("sample_id").alias("rep"), cells).select("rep", "dataset", "split", "digest", "c.width", "c.cells")
    classes = materialize(classes.mapInArrow(_searchable, "rep long, dataset string, split string, digest binary, width int, cells array<double>, searchable boolean"), "classes")
    own = records.groupBy("sample_id").agg(F.min(F.struct("dataset", "split", "digest")).alias("k")).select("sample_id", "k.*")
    members = materialize(own.join(classes.select("dataset", "split", "digest", "rep"), ["dataset", "split", "digest"]).select("sample_id", "rep"), "members")
    release(records)
    counts = classes.groupBy("dataset").agg(F.greatest(F.ceil(F.count_if(F.col("split") == "train") / block), F.lit(1)).alias("blocks"), F.greatest(F.ceil(F.count_if(F.col("split") == "test") / shard), F.lit(1)).alias("shards"))  # one row per dataset
    placed = classes.filter("searchable").select("rep", "dataset", "split", "width", "cells").join(counts, "dataset")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    tests = placed.filter("split = 'test'").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")))
    index = materialize(tests.select("rep", "dataset", "shard", "width", "cells").groupBy("dataset", "shard").applyInArrow(_indexed, "dataset string, shard long, index binary"), "index")
    asked = placed.filter("split = 'train'").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("shard", every("shards")).select("rep", "dataset", "block", "shard", "width", "cells")
    held = index.join(counts, "dataset").withColumn("block", every("blocks")).select(F.col("dataset").alias("i_dataset"), F.col("shard").alias("i_shard"), F.col("block").alias("i_block"), "index")
    found = asked.groupBy("dataset", "shard", "block").cogroup(held.groupBy("i_dataset", "i_shard", "i_block")).applyInArrow(_searched, "train long, test long, shift int")
    a = classes.filter("split = 'train'").select(F.col("rep").alias("train"), "width", "cells")
    b = classes.filter("split = 'test'").select(F.col("rep").alias("test"), F.col("width").alias("t_width"), F.col("cells").alias("t_cells"))
    candidates = materialize(found, "candidates")
    release(index)
    pairs = candidates.join(a, "train").join(b, "test").mapInArrow(_compared, "train long, test long")
    rest = classes.filter("not searchable")
    if not rest.isEmpty():
        side = lambda df, s: df.filter(F.col("split") == s).select(F.col("rep").alias("id"), F.col("cells").alias("vec"), "width", "dataset")
        for train, test in ((side(classes, "train"), side(rest, "test")), (side(rest, "train"), side(classes.filter("searchable"), "test"))):
            pairs = pairs.unionByName(meet(train, test, _directly, "train long, test long", ["dataset"], rows=512))
    done = materialize(pairs.distinct(), "pairs")
    release(candidates)
    release(classes)
    return done, members


def split_overlaps(samples: DataFrame, channels: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """train_id, test_id of all pairs of one dataset that hold the same recording."""
    pairs, members = class_overlaps(samples, channels, shard, block)
    a, b = (members.select(F.col("rep").alias(c), F.col("sample_id").alias(f"{c}_id")) for c in ("train", "test"))
    return pairs.join(a, "train").join(b, "test").select("train_id", "test_id").distinct()


def noisy_copies(samples: DataFrame, channels: DataFrame, every: int = 20, noise: float = 0.049) -> DataFrame:
    """Copies of the training records whose id is divisible by `every`, as evaluation records with ids -1 - id: each plausible reading is
    moved by up to `noise` standard deviations of its channel, evenly, by a generator that is seeded with the id."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole):
                row, _, values, case = clean_matrix(b)
                ids = b.column("sample_id").to_numpy()
                clean = np.where(case, np.nan, values)
                sd = np.nan_to_num(deviations(clean[None])[0])
                out: list[list] = [[] for _ in ids]
                for k, r in enumerate(row):
                    move = np.random.default_rng([int(ids[r]), len(out[r])]).uniform(-noise, noise, values.shape[1]) * sd[k]
                    x = np.where(case[k], values[k], values[k] + move)
                    out[r].append([None if np.isnan(z) else float(z) for z in x])
                yield pa.RecordBatch.from_arrays([pa.array(-1 - ids), b.column("dataset"), pa.array(out, pa.list_(pa.list_(pa.float64())))], ["sample_id", "dataset", "series"])

    some = samples.filter((F.col("sample_id") % every == 0) & (F.col("split") == "train") & F.col("series").isNotNull()).dropDuplicates(["sample_id"])
    wide = some.select("sample_id", "dataset", "series").join(channel_limits(channels), "dataset").select("sample_id", "dataset", "series", "lo", "hi", "code")
    return wide.mapInArrow(kernel, "sample_id long, dataset string, series array<array<double>>").withColumn("split", F.lit("test"))


def measured_recall(samples: DataFrame, channels: DataFrame, every: int = 20) -> DataFrame:
    """Per dataset and kind, what the index finds of what comparing each with each finds. stated: the evaluation records whose id is
    divisible by `every` against all training records; noisy: copies disturbed nearly up to the limit against their originals."""
    cols = ["sample_id", "dataset", "split", "series"]
    found = split_overlaps(samples, channels)
    records = records_of(samples, channels).dropDuplicates(["sample_id"])
    side = lambda s: records.filter(F.col("split") == s).select(F.col("sample_id").alias("id"), F.col("cells").alias("vec"), "width", "dataset")
    true = meet(side("train"), side("test").filter(F.col("id") % every == 0), _directly, "train long, test long", ["dataset"], rows=512).withColumnsRenamed({"train": "train_id", "test": "test_id"})
    names = records.select(F.col("sample_id").alias("test_id"), "dataset")
    stated = true.join(found.withColumn("hit", F.lit(1)), ["train_id", "test_id"], "left").join(names, "test_id").select(F.lit("stated").alias("kind"), "dataset", "hit")
    copies = materialize(noisy_copies(samples, channels, every), "noisy")
    both = samples.filter("split = 'train'").select(*cols).unionByName(copies.select(*cols))
    again = split_overlaps(both, channels).filter("test_id = -1 - train_id").select(F.col("test_id").alias("sample_id"), F.lit(1).alias("hit"))
    noisy = copies.join(again, "sample_id", "left").select(F.lit("noisy").alias("kind"), "dataset", "hit")
    return stated.unionByName(noisy).groupBy("kind", "dataset").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_true"))


def overlap_report(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per dataset and split: samples, samples with a copy in the other split, pairs."""
    once = samples.filter("sample_id is not null and split in ('train', 'test')").groupBy("sample_id").agg(F.min(F.struct("dataset", "split")).alias("r")).select("sample_id", "r.*")
    hit = pairs.select(F.col("train_id").alias("sample_id")).unionByName(pairs.select(F.col("test_id").alias("sample_id"))).groupBy("sample_id").agg(F.count("*").alias("n_pairs"))
    return once.join(hit, "sample_id", "left").groupBy("dataset", "split").agg(F.count("*").alias("n_samples"), F.count("n_pairs").alias("n_overlapping"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"))
