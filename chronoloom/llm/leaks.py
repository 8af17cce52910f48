"""Passages of evaluation items in a corpus: latent semantic retrieval, then checks word by word.

Texts are brought to one form and cut into words. Documents are tiled into passages of PASSAGE words; any RUN = 13 words in a row
hold a whole tile (2 * PASSAGE - 1 = RUN). Items are cut into all their windows of PASSAGE words. TF-IDF counts passages of the whole corpus;
the terms are those of the items, since a passage can match in no other. A randomised SVD, distributed as sums over passages,
gives each term a place in a latent space; a passage is the sum of its terms.
Windows of the items are grouped around centres, each tile is compared, by cosine, with the windows of its nearest centres (all that
are within TIE of the nearest, more than rounding can part equal vectors). A tile that equals a window has the same vector, so one of these
centres and cosine 1: no run of 13 words can be missed by the search.
For paraphrases it is compared with the windows of every centre that may hold one near enough.
Candidates are then checked: the exact run of words around the tile, and for paraphrases the longest common subsequence and the
share of the answer's words.

Items are searched in blocks of about ITEMS, or of ITEM_CHARS characters, so what is broadcast is bounded; documents of any length are tiled as a whole and never
joined. Defined results: null, empty or short texts match nothing; each pair of document and item comes once, with its best
values; repeated items are found like any other; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.looks import Former
from chronoloom.storage import materialize

RUN, PASSAGE, RANK, ITEMS, ITEM_CHARS = 13, 7, 32, 20_000, 20_000_000
NEAR, CENTRES, TIE = 0.97, 128, 1e-3
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str, former: Former) -> list[str]:
    return WORDS.findall(former.canonical(text).lower())


class Items:
    """The items of one block: words as numbers, end to end, each item followed by -2."""

    def __init__(self, rows: list) -> None:
        former = Former()
        self.number: dict[str, int] = {}
        ids, flat, owner, start, answer = [], [], [], [], []
        for item, text in rows:
            w = words_of(text or "", former)
            ids.append(item)
            start.append(len(flat))
            flat += [self.number.setdefault(x, len(self.number)) for x in w] + [-2]
            owner += [len(ids) - 1] * (len(w) + 1)
            lines = (text or "").strip().split("\n", 1)
            answer.append(len(words_of(lines[0], former)) if len(lines) > 1 else 0)
        self.ids, self.flat, self.owner = np.array(ids, np.int64), np.array([-2, *flat], np.int32), np.array([0, *owner])
        self.start, self.stop = np.array(start, int) + 1, np.array([*start[1:], len(flat)], int)
        self.answer = np.array(answer, int)  # words before the answer: those of the first line, none if it is the only one
        n = max(len(self.flat) - PASSAGE + 1, 0)
        view = np.lib.stride_tricks.sliding_window_view(self.flat, PASSAGE) if n else np.zeros((0, PASSAGE), np.int32)
        self.at = np.flatnonzero((view >= 0).all(1))
        self.windows = view[self.at]


def tiles(lens: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole tiles of the documents (tiles x PASSAGE) and the place of their first words in flat."""
    n = lens // PASSAGE
    start = np.cumsum(lens) - lens
    doc = np.repeat(np.arange(len(lens)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = start[doc] + k * PASSAGE
    return flat[at[:, None] + np.arange(PASSAGE)[None, :]], at


def _numbered(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id and its words as numbers of the items' words, -1 for others."""
    sent = docs.sparkSession.sparkContext.broadcast(items.number)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former, number = Former(), sent.value
        get = number.get
        for b in batches:
            lens, flat = [], []
            for t in b.column(1).to_pylist():
                w = [get(x, -1) for x in words_of(t, former)]
                lens.append(len(w))
                flat += w
            offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.array(flat, np.int32)))], ["doc_id", "w"])

    return docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(kernel, "doc_id long, w array<int>")


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    a = b.column("w")
    return np.diff(a.offsets.to_numpy()).astype(np.int64), a.flatten().to_numpy()


def inverse_frequencies(numbered: DataFrame, items: Items) -> np.ndarray:
    """IDF of each term over all passages of the corpus."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size + 1, np.int64)
        for b in batches:
            m, _ = tiles(*_lists(b))
            m = np.sort(m, axis=1)
            m[:, 1:][m[:, 1:] == m[:, :-1]] = -1
            count += np.bincount(m[m >= 0], minlength=size + 1)
            count[size] += len(m)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], ["term", "n"])

    size = len(items.number)
    n = np.zeros(size + 1)
    for r in numbered.select("w").mapInArrow(kernel, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most the items' terms
        n[r.term] = r.n
    return np.log((1 + n[size]) / (1 + n[:size])) + 1


def _gram(numbered: DataFrame, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'(A q), A the matrix of passages and weighted terms: each batch adds its own, sums are made by term."""
    rank, size = q.shape[1], len(weight)
    places = numbered.sparkSession.sparkContext.broadcast((np.vstack([q * weight[:, None], np.zeros((1, rank))]).astype(np.float32)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = places.value
        total = np.zeros((size, rank))
        for b in batches:
            m, _ = tiles(*_lists(b))
            m = m[(m >= 0).any(1)]
            y = v[m].sum(1)
            term, row = m.ravel(), np.repeat(np.arange(len(m)), PASSAGE)
            order = np.argsort(term, kind="stable")
            order = order[np.searchsorted(term[order], 0) :]
            if len(order):
                where = np.flatnonzero(np.diff(term[order], prepend=-1))
                total[term[order][where]] += np.add.reduceat(y[row[order]], where, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *(pa.array(total[:, k]) for k in range(rank))], ["term", *(f"c{k}" for k in range(rank))])

    cols = [f"c{k}" for k in range(rank)]
    out = np.zeros((size, rank))
    sums = numbered.select("w").mapInArrow(kernel, "term int, " + ", ".join(f"{c} double" for c in cols)).groupBy("term").agg(*(F.sum(c).alias(c) for c in cols))
    got = sums.toPandas()  # terms of the items x rank
    out[got.term.to_numpy()] = got[cols].to_numpy()
    return out * weight[:, None]


def latent_terms(numbered: DataFrame, items: Items, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """Weighted place of each term in the latent space (terms x rank): randomised SVD with one power iteration."""
    size = len(items.number)
    idf = inverse_frequencies(numbered, items)
    r = min(rank, size)
    q, _ = np.linalg.qr(_gram(numbered, idf, np.random.default_rng(seed).standard_normal((size, r))))
    g = _gram(numbered, idf, q)
    value, turn = np.linalg.eigh((q.T @ g + g.T @ q) / 2)
    v = q @ turn[:, np.argsort(-value)]
    return (v * idf[:, None]).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Search:
    """Windows of the items in latent space, grouped around centres."""

    def __init__(self, items: Items, terms: np.ndarray, centres: int = CENTRES, seed: int = 4) -> None:
        self.items = items
        self.terms = np.vstack([terms, np.zeros((1, terms.shape[1]), np.float32)])
        w = self.place(items.windows)
        rng = np.random.default_rng(seed)
        self.centres = w[rng.permutation(len(w))[:centres]]
        for _ in range(6):
            near = (w @ self.centres.T).argmax(1)
            total = np.zeros_like(self.centres)
            np.add.at(total, near, w)
            self.centres = unit(np.where(np.bincount(near, minlength=len(total))[:, None] > 0, total, self.centres))
        near = (w @ self.centres.T).argmax(1)
        self.of = [np.flatnonzero(near == c) for c in range(len(self.centres))]
        self.w = w
        apart = np.arccos(np.clip((w * self.centres[near]).sum(1), -1, 1))
        self.reach = np.array([apart[of].max(initial=0.0) for of in self.of])

    def place(self, m: np.ndarray) -> np.ndarray:
        """Unit vector of each passage. Words are added in their order, one by one, so equal passages have equal vectors."""
        out = self.terms[m[:, 0]].copy()
        for k in range(1, m.shape[1]):
            out += self.terms[m[:, k]]
        return unit(out)

    def _once(self, m: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray] | None:
        """candidates() with equal passages, which a corpus is full of, searched once; None if there are none."""
        key = np.zeros(len(m), np.uint64)
        for k in range(m.shape[1]):
            key = (key ^ (m[:, k].astype(np.int64) + 2).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(first) == len(m) or (m[first][back] != m).any():  # nothing is repeated, or two passages share a key
            return None
        row, win = self.candidates(m[first], least)
        per = np.bincount(row, minlength=len(first))
        order, start = np.argsort(row, kind="stable"), np.cumsum(per) - per
        n = per[back]
        at = np.arange(n.sum()) + np.repeat(start[back] - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(m)), n), win[order][at]

    def candidates(self, m: np.ndarray, least: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
        """(row of m, window) with a cosine of at least `least`. From NEAR on, where passages are equal, a row is compared with the
        windows of its nearest centres; below, with those of every centre that may hold such a window by the angles."""
        if least < NEAR and (few := self._once(m, least)) is not None:
            return few
        x = self.place(m)
        near = x @ self.centres.T
        if least >= NEAR:
            probed = near >= near.max(1, keepdims=True, initial=-2) - TIE
        else:
            probed = np.arccos(np.clip(near, -1, 1)) - self.reach[None, :] <= np.arccos(least) + 5e-3  # for rounding in single precision
        parts = [np.flatnonzero(p) for p in probed.T]
        rows, wins = [], []
        for part, of in zip(parts, self.of, strict=True):
            step = max(1, 4_000_000 // max(1, len(of)))
            for k in range(0, len(part) if len(of) else 0, step):
                i, j = np.nonzero(x[part[k : k + step]] @ self.w[of].T >= least)
                rows.append(part[k + i])
                wins.append(of[j])
        return (np.concatenate(rows), np.concatenate(wins)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _extent(doc: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from doc[p], item[q] on, in the direction of step. Both begin and end with words that never agree."""
    n = np.zeros(len(p), int)
    live = np.arange(len(p))
    while len(live):
        live = live[doc[p[live] + step * n[live]] == item[q[live] + step * n[live]]]
        n[live] += 1
    return n


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence: one bit per word of a, in whole numbers of any length, one step per word of b that a
    has."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b[np.isin(b, a)].tolist():
        hit = row & masks[x]
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def leaks(docs: DataFrame, items: DataFrame, paraphrases: bool = False) -> DataFrame:
    """doc_id, item_id, longest_run of every document with at least RUN words of an item in a row; with paraphrases also pairs whose
    passages are near without such a run, with lcs_share and answer_share (shares of the item's words, of its answer's words)."""
    spark = docs.sparkSession
    rows = items.filter("item_id is not null and text is not null").select("item_id", "text")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-chars // ITEM_CHARS))
    out = None
    for k in range(blocks):
        block = Items(rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").collect())  # about ITEMS rows or ITEM_CHARS characters
        one = _leaks(docs, block, paraphrases) if len(block.windows) else spark.createDataFrame([], LEAK_SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out


LEAK_SCHEMA = "doc_id long, item_id long, longest_run int, lcs_share double, answer_share double"


def _leaks(docs: DataFrame, items: Items, paraphrases: bool) -> DataFrame:
    numbered = materialize(_numbered(docs, items), "words")
    sent = docs.sparkSession.sparkContext.broadcast(Search(items, latent_terms(numbered, items)))
    least = 0.9 if paraphrases else NEAR

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        it = search.items
        for b in batches:
            lens, flat = _lists(b)
            m, at = tiles(lens, flat)
            keep = (m < 0).sum(1) <= (2 if paraphrases else 0)  # a tile with a word of no item lies in none
            row, win = search.candidates(m[keep], least)
            p, q = at[keep][row], it.at[win]
            bounds = np.concatenate([[0], np.cumsum(lens)])
            doc = np.searchsorted(bounds, p, side="right") - 1
            fenced = np.full(len(flat) + len(lens) + 1, -3, np.int32)
            fenced[np.arange(len(flat)) + 1 + np.repeat(np.arange(len(lens)), lens)] = flat
            p = p + 1 + doc
            run = _extent(fenced, it.flat, p, q, 1) + _extent(fenced, it.flat, p - 1, q - 1, -1)
            key = doc.astype(np.int64) * len(it.ids) + it.owner[q]
            order = np.lexsort((-run, key))
            key, first, times = np.unique(key[order], return_index=True, return_counts=True)
            run = run[order][first] if len(first) else np.zeros(0, int)
            lcs, answer = np.full(len(key), np.nan), np.full(len(key), np.nan)
            good = run >= RUN
            if paraphrases:
                for i in np.flatnonzero(good | (times >= 3)):
                    d, e = divmod(int(key[i]), len(it.ids))
                    x, y = flat[bounds[d] : bounds[d + 1]], it.flat[it.start[e] : it.stop[e] + 1]
                    y = y[y >= 0]
                    lcs[i] = common_subsequence(y, x) / max(len(y), 1)
                    tail = y[it.answer[e] :]
                    answer[i] = np.isin(tail, x).mean() if len(tail) else 0.0
                good |= (lcs >= 0.6) & (answer >= 0.6)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            nan = [pa.array(z[good], pa.float64(), from_pandas=True) for z in (lcs, answer)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[key[good] // len(it.ids)], pa.int64()), pa.array(it.ids[key[good] % len(it.ids)]), pa.array(run[good].astype(np.int32)), *nan], [c.split()[0] for c in LEAK_SCHEMA.split(", ")])

    return numbered.mapInArrow(kernel, LEAK_SCHEMA)


def disturbed(items: DataFrame, every: int) -> DataFrame:
    """The items as documents with ids -1 - item_id, in which every so many words are replaced by a word that is foreign to all."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                parts = re.split(r"(\s+)", t)
                out.append("".join(f"zzq{k}" if k % 2 == 0 and k // 2 % every == every - 1 else x for k, x in enumerate(parts)))
            yield pa.RecordBatch.from_arrays([pa.array([-1 - i for i in b.column(0).to_pylist()], pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])

    return items.filter("item_id is not null and text is not null").select("item_id", "text").mapInArrow(kernel, "doc_id long, text string")


def paraphrase_recall(docs: DataFrame, items: DataFrame, every: int = 8) -> DataFrame:
    """One row: items, and of how many a copy with every so many words replaced was found among the documents, by a run of RUN words or as a
    paraphrase."""
    both = docs.select("doc_id", "text").unionByName(disturbed(items, every))
    found = leaks(both, items, paraphrases=True).filter("doc_id = -1 - item_id")
    n = items.filter("item_id is not null and text is not null").agg(F.count("*").alias("n_items"), F.lit(1).alias("_k"))
    got = found.agg(F.count("*").alias("n_found"), F.count_if(F.col("longest_run") < RUN).alias("n_without_run"), F.lit(1).alias("_k"))
    return n.join(got, "_k").select(F.lit(every).alias("every"), "n_items", "n_found", "n_without_run", (F.col("n_found") / F.col("n_items")).alias("recall"))
