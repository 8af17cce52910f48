"""Most similar vectors for every vector: hierarchical k-means tree, best-bin-first visits, calibrated recall.

Vectors of one dataset are compared by L1 distance. Equal vectors are collapsed to one class first (its representative is the
smallest sample_id), so that copies, however many, cost one row. Per dataset a tree is fitted on at most FIT_ROWS classes (a
documented, bounded sample, chosen by hash) and every class is put into a leaf. A leaf that then holds more than LEAF_ROWS is
split by a tree of its own, fitted on an executor, and so on until all leaves are small: the number of leaves grows with the rows,
the rows of a leaf do not. Neighbouring leaves with at most PAGE rows together are a page, the unit in which rows are held and compared,
while leaves, which are tighter, decide what is visited. Trees are sent to the workers in parts of at most TREE_BYTES (one dataset's at least), one pass over
the vectors per part; they hold about 1 / LEAF of the numbers of the vectors.

Search: every vector first meets the others of its own page, which bounds the distance of its k-th neighbour. A traversal then
takes nodes from a priority queue, nearest centre first, passes over what by centre and radius can hold nothing within that
bound, and yields leaves until a number of rows was visited that is calibrated per dataset: CALIBRATE vectors are compared with
all rows, and the visited rows are doubled until their recall reaches RECALL. Visitors of a page are cut into parts of VISITORS
by their number, and a leaf that could not be split into blocks of LEAF_ROWS, so no task holds more than a part and a block.

Defined results: a vector that is null, of another length than emb_len, or holds NaN or null is not usable, and neither is one
of a dataset without parameters; of repeated sample_ids the latest usable row counts; ties go to the smaller sample_id; a
dataset with one vector has no neighbours; empty tables give empty results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.distances import l1, meet
from chronoloom.storage import materialize, materialize_measured, release

FIT_ROWS, LEAF, PAGE, BRANCH, LEAF_ROWS, TREE_BYTES, VISITORS = 32_768, 48, 512, 8, 1_024, 128 << 20, 8_192
CALIBRATE, RECALL = 128, 0.999


def usable_vectors(ctrans: DataFrame, hyper: DataFrame) -> DataFrame:
    """sample_id, dataset, vec and the dataset's k_nearest, k_dis_high, eps, min_samples."""
    rows = ctrans.filter("sample_id is not null and c_trans is not null").select("sample_id", "dataset", "c_trans", "computed_at")
    par = hyper.select("dataset", "k_nearest", "k_dis_high", "eps", "min_samples", "emb_len")
    ok = ~F.exists("c_trans", lambda x: x.isNull() | F.isnan(x)) & (F.size("c_trans") == F.col("emb_len"))
    good = rows.join(par, "dataset").filter(ok)
    cols = ["dataset", "k_nearest", "k_dis_high", "eps", "min_samples", F.col("c_trans").alias("vec")]
    return good.groupBy("sample_id").agg(F.max_by(F.struct(*cols), F.struct("computed_at")).alias("r")).select("sample_id", "r.*")


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Label of each row; medians as centres would suit L1, means are as good a partition and cheaper."""
    centre = x[[rng.integers(len(x))]]
    gap = l1(x, centre)[:, 0]
    while len(centre) < k and gap.max() > 0:
        centre = np.vstack([centre, x[[rng.choice(len(x), p=gap / gap.sum())]]])
        gap = np.minimum(gap, l1(x, centre[-1:])[:, 0])
    for _ in range(rounds):
        label = l1(x, centre).argmin(1)
        total = np.zeros_like(centre)
        np.add.at(total, label, x)
        count = np.bincount(label, minlength=len(centre))
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return l1(x, centre).argmin(1)


class Tree:
    """Nodes of one dataset in arrays: centre of each node, children (-1 filled), leaf number (-1: inner node). radius, rows: of
    each leaf, once all rows are in; page: of each leaf, page_rows: of each page."""

    def __init__(self, x: np.ndarray, seed: int = 1, most: int = LEAF) -> None:
        rng = np.random.default_rng(seed)
        centre, kids, leaf, todo = [x.mean(0)], [[]], [-1], [(0, np.arange(len(x)))]
        leaves = 0
        while todo:
            node, rows = todo.pop()
            label = k_means(x[rows], min(BRANCH, -(-len(rows) // most) * 2), rng) if len(rows) > most else None
            if label is None or (label == label[0]).all():
                leaf[node], leaves = leaves, leaves + 1
                continue
            for v in np.unique(label):
                part = rows[label == v]
                kids[node].append(len(centre))
                centre.append(x[part].mean(0))
                kids.append([])
                leaf.append(-1)
                todo.append((kids[node][-1], part))
        self.centre, self.leaf, self.leaves = np.array(centre), np.array(leaf), leaves
        self.kids = np.full((len(kids), BRANCH), -1)
        for i, k in enumerate(kids):
            self.kids[i, : len(k)] = k
        self._settled()

    def _settled(self) -> None:
        self.node_of = np.empty(self.leaves, int)
        self.node_of[self.leaf[self.leaf >= 0]] = np.flatnonzero(self.leaf >= 0)
        self.radius, self.rows = np.zeros(self.leaves), np.zeros(self.leaves, np.int64)
        self.reach = np.full(len(self.leaf), np.inf)
        self.page, self.page_rows = np.arange(self.leaves), np.zeros(self.leaves, np.int64)
        self.low = self.high = np.zeros((0, 0), np.float32)

    def graft(self, leaf: int, sub: "Tree") -> None:
        """Put a tree in the place of a leaf: its first leaf takes the leaf's number, its others new ones."""
        at, n = int(self.node_of[leaf]), len(self.leaf)
        number = np.where(sub.leaf < 0, -1, np.where(sub.leaf == 0, leaf, self.leaves + sub.leaf - 1))
        kids = np.where(sub.kids < 0, -1, sub.kids + n - 1)
        self.kids = np.vstack([self.kids, kids[1:]])
        self.kids[at] = kids[0]
        self.leaf = np.concatenate([self.leaf, number[1:]])
        self.leaf[at] = number[0]
        self.centre = np.vstack([self.centre, sub.centre[1:]])
        self.leaves += sub.leaves - 1
        self._settled()

    def measured(self, most: int = 0) -> None:
        """How far from each node's centre its rows can lie, from the leaves upwards (children have larger numbers), and the pages: the
        largest nodes of at most so many rows."""
        self.reach = np.full(len(self.leaf), -np.inf)
        full = np.flatnonzero(self.rows > 0)
        self.reach[self.node_of[full]] = self.radius[full]
        for node in range(len(self.leaf) - 1, -1, -1):
            kids = self.kids[node][self.kids[node] >= 0]
            if len(kids):
                self.reach[node] = (np.abs(self.centre[kids] - self.centre[node]).sum(1) + self.reach[kids]).max()
        under = np.zeros(len(self.leaf), np.int64)
        under[self.node_of] = self.rows
        for node in range(len(self.leaf) - 1, -1, -1):
            under[node] += under[self.kids[node][self.kids[node] >= 0]].sum()
        root = np.full(len(self.leaf), -1)
        for node in range(len(self.leaf)):
            if root[node] < 0 and (under[node] <= most or self.leaf[node] >= 0):
                root[node] = node
            root[self.kids[node][self.kids[node] >= 0]] = root[node]
        _, first, self.page = np.unique(root[self.node_of], return_index=True, return_inverse=True)
        self.page = np.argsort(np.argsort(first))[self.page]  # numbered by their first leaves
        self.page_rows = np.bincount(self.page, self.rows).astype(np.int64)

    def put(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row, by always taking the nearest child, and the distance from the leaf's centre."""
        at = np.zeros(len(x), int)
        while (inner := self.leaf[at] < 0).any():
            rows = np.flatnonzero(inner)
            kids = self.kids[at[rows]]
            d = np.abs(self.centre[kids] - x[rows, None, :]).sum(2)
            d[kids < 0] = np.inf
            at[rows] = kids[np.arange(len(rows)), d.argmin(1)]
        return self.leaf[at], np.abs(self.centre[at] - x).sum(1)

    def visits(self, q: np.ndarray, most: float, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, leaf) in best-bin-first order of each row, until the leaves hold `most` rows (page_of() makes pages of them); without
        nodes that by their centre and reach can hold nothing within the row's distance. Every row has a priority queue of its own (a line of `key`
        and `node`); one step takes the nearest node of all queues at once."""
        n = len(q)
        key, node = np.zeros((n, 1)), np.zeros((n, 1), np.int32)
        live, seen = np.arange(n), np.zeros(n)
        rows, leaves = [], []
        while len(live):
            at = key.argmin(1)
            line = np.arange(len(live))
            near, top = key[line, at], node[line, at]
            key[line, at] = np.inf
            leaf = self.leaf[top]
            hit = (leaf >= 0) & np.isfinite(near)
            rows.append(live[hit])
            leaves.append(leaf[hit])
            seen[live[hit]] += self.rows[leaf[hit]]
            inner = np.flatnonzero((leaf < 0) & np.isfinite(near))
            if len(inner):
                kids = self.kids[top[inner]]
                far = np.abs(self.centre[kids] - q[live[inner], None, :]).sum(2)
                far[(kids < 0) | (far - self.reach[kids] > within[live[inner], None])] = np.inf
                new_key, new_node = np.full((len(live), BRANCH), np.inf), np.zeros((len(live), BRANCH), np.int32)
                new_key[inner], new_node[inner] = far, kids
                key, node = np.hstack([key, new_key]), np.hstack([node, new_node])
            keep = (seen[live] < most) & np.isfinite(near)
            if not keep.all():
                live, key, node = live[keep], key[keep], node[keep]
            if key.shape[1] > 64 and len(live):  # drop places that no queue uses any more
                used = max(int(np.isfinite(key).sum(1).max()), 1)
                if used < key.shape[1] // 2:
                    order = np.argsort(key, axis=1)[:, :used]
                    key, node = np.take_along_axis(key, order, 1), np.take_along_axis(node, order, 1)
        return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(leaves) if leaves else np.zeros(0, int)

    def page_of(self, row: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, page) of the visits (row, leaf), once each."""
        key = np.unique(row.astype(np.int64) * (len(self.page_rows) + 1) + self.page[leaf])
        return key // (len(self.page_rows) + 1), key % (len(self.page_rows) + 1)

    def boxed(self, leaf: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The box of each node from (parts of) those of the leaves; of one without rows it is empty."""
        self.low = np.full(self.centre.shape, np.inf, np.float32)
        self.high = -self.low
        np.minimum.at(self.low, self.node_of[leaf], low)
        np.maximum.at(self.high, self.node_of[leaf], high)
        for node in range(len(self.leaf) - 1, -1, -1):
            kids = self.kids[node][self.kids[node] >= 0]
            if len(kids):
                self.low[node], self.high[node] = self.low[kids].min(0), self.high[kids].max(0)

    def boxes_within(self, q: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, leaf) of the leaves whose box is within the row's distance, from the root downwards, all rows at once: no other leaf
        holds anything so near."""
        row, node = np.arange(len(q)), np.zeros(len(q), int)
        rows, leaves, most = [row[:0]], [row[:0]], within * (1 + 1e-12)
        while len(row):
            end = self.leaf[node] >= 0
            rows.append(row[end])
            leaves.append(self.leaf[node[end]])
            kids = self.kids[node[~end]]
            row, node = np.repeat(row[~end], (kids >= 0).sum(1)), kids[kids >= 0]
            gap = np.zeros(len(row))
            for k in range(q.shape[1]):
                x = q[row, k]
                gap += np.maximum(np.maximum(self.low[node, k] - x, x - self.high[node, k]), 0)
            near = gap <= most[row]
            row, node = row[near], node[near]
        return np.concatenate(rows), np.concatenate(leaves)

    def near_leaves(self, q: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Boolean, rows of q x leaves: those that may hold something within the distance, by the triangle inequality."""
        return (l1(q, self.centre[self.node_of]) - self.radius[None, :] <= within[:, None]) & (self.rows > 0)[None, :]


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _outward(x: np.ndarray, to: float) -> np.ndarray:
    """x in single precision, moved towards `to` so that rounding cannot lead away from it."""
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float32), np.float32(to))


def _chance(n: Column, wanted: int) -> Column:
    """Whether a row (by a hash of cid) is among about `wanted` of n."""
    return F.pmod(F.xxhash64("cid", F.lit(5)), F.lit(1 << 40)) < F.least(F.lit(1.0), F.lit(0.97 * wanted) / n) * float(1 << 40)


def _fitted(some: DataFrame, keys: list[str], most: int) -> list:
    """Rows of keys and the pickled tree fitted on each group; the groups are bounded samples."""

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("cid")
        return pd.DataFrame({**{k: [f[k].iloc[0]] for k in keys}, "tree": [pickle.dumps(Tree(stacked(f.vec), most=most))]})

    schema = ", ".join(f"{k} {t}" for k, t in some.dtypes if k in keys) + ", tree binary"
    return some.select(*keys, *(c for c in ("cid", "vec") if c not in keys)).groupBy(*keys).applyInPandas(fit, schema).collect()


class Index:
    """Classes of equal vectors, their members, and the tree of each dataset with all classes in its leaves."""

    def __init__(self, vectors: DataFrame, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS, leaf: int = LEAF) -> None:
        self.spark, self.leaf_rows, self.leaf = vectors.sparkSession, leaf_rows, leaf
        self.vectors = materialize(vectors, "vectors")
        self.params = [c for c in self.vectors.columns if c not in ("sample_id", "vec", "dataset")]
        classes = materialize(self.vectors.groupBy("dataset", "vec").agg(F.min("sample_id").alias("cid"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in self.params)), "classes")
        size = classes.groupBy("dataset").agg(F.count("*").alias("_size"))  # one row per dataset: its classes, not its copies
        some = classes.join(size, "dataset").filter(_chance(F.col("_size"), fit_rows))
        self.trees = {r.dataset: pickle.loads(r.tree) for r in _fitted(some, ["dataset"], leaf)}  # noqa: S301
        if lacking := [r.dataset for r in size.select("dataset").collect() if r.dataset not in self.trees]:
            raise RuntimeError(f"no tree was fitted for {lacking[:5]}, whose rows would be lost")
        self.rows = self._refined(classes, fit_rows)
        release(classes)

    def members(self) -> DataFrame:
        """sample_id, cid for every vector."""
        return self.vectors.select("sample_id", "dataset", "vec").join(self.rows.select("dataset", "vec", "cid"), ["dataset", "vec"]).select("sample_id", "cid")

    def _refined(self, classes: DataFrame, fit_rows: int) -> DataFrame:
        """All classes with their place, the leaf, and their page (column leaf). Leaves of more than leaf_rows are split by trees of their own
        until none can be split."""
        whole: set[tuple[str, int]] = set()  # leaves that a tree of their own did not split
        while True:
            rows = materialize(self._put(classes), "leaves")
            self.leaves = rows.groupBy("dataset", "leaf").agg(F.max("gap").alias("r"), F.count("*").alias("n")).toPandas()  # the leaves: rows / LEAF
            big = self.leaves[self.leaves.n > self.leaf_rows]
            big = big[[(d, k) not in whole for d, k in zip(big.dataset, big.leaf, strict=True)]]
            if big.empty:
                break
            crowd = self.spark.createDataFrame(big[["dataset", "leaf", "n"]].rename(columns={"n": "_size"}))
            some = rows.join(crowd, ["dataset", "leaf"]).filter(_chance(F.col("_size"), fit_rows))
            whole |= set(zip(big.dataset, big.leaf, strict=True))
            for r in _fitted(some, ["dataset", "leaf"], self.leaf):
                sub = pickle.loads(r.tree)  # noqa: S301
                if sub.leaves > 1:
                    self.trees[r.dataset].graft(r.leaf, sub)
                    whole.discard((r.dataset, r.leaf))
            release(rows)
        for d, g in self.leaves.groupby("dataset"):
            t = self.trees[d]
            t.radius[g.leaf], t.rows[g.leaf] = g.r * (1 + 1e-12) + 1e-300, g.n
            t.measured(PAGE)

        def paged(g: pd.DataFrame, tree: Tree) -> pd.DataFrame:
            return g.assign(place=g.leaf, leaf=tree.page[g.leaf.to_numpy()].astype(np.int32))

        out = materialize(self.over_trees(rows, paged, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", place int"), "pages")
        release(rows)
        return out

    def parts(self) -> Iterator[dict[str, Tree]]:
        """The trees in parts that are small enough to be broadcast."""
        part, size = {}, 0
        for name, tree in self.trees.items():
            more = tree.centre.nbytes + tree.low.nbytes + tree.high.nbytes
            if part and size + more > TREE_BYTES:
                yield part
                part, size = {}, 0
            part[name] = tree
            size += more
        if part:
            yield part

    def over_trees(self, df: DataFrame, kernel, schema: str) -> DataFrame:
        """df through kernel(frame, tree of its dataset) for each dataset of each batch, one pass per part of the trees."""
        out = None
        parts = list(self.parts())
        for part in parts:
            sent = self.spark.sparkContext.broadcast(part)

            def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                for f in frames:
                    for name, g in f.groupby("dataset", sort=False):
                        if name in sent.value:
                            yield kernel(g, sent.value[name])

            one = df.mapInPandas(run, schema)
            out = one if out is None else out.unionByName(one)
        return df.filter("false").mapInPandas(lambda frames: iter(()), schema) if out is None else out

    def _put(self, classes: DataFrame) -> DataFrame:
        def put(g: pd.DataFrame, tree: Tree) -> pd.DataFrame:
            leaf, gap = tree.put(stacked(g.vec))
            return g.assign(leaf=leaf.astype(np.int32), gap=gap)

        schema = ", ".join(f"{c} {t}" for c, t in classes.dtypes) + ", leaf int, gap double"
        return self.over_trees(classes, put, schema)

    def sizes(self) -> DataFrame:
        """dataset, leaf, cuts: blocks of each page."""
        return self.rows.groupBy("dataset", "leaf").agg(F.ceil(F.count("*") / self.leaf_rows).alias("cuts"))

    def leaves_table(self) -> DataFrame:
        """dataset, leaf: all pages."""
        return self.rows.select("dataset", "leaf").distinct()

    def blocked(self, df: DataFrame) -> DataFrame:
        """df (cid, dataset, leaf, ...) with the block of its leaf that a row is in."""
        return df.join(self.sizes(), ["dataset", "leaf"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("cuts"))).drop("cuts")

    def calibrate(self, recall: float = RECALL, queries: int = CALIBRATE) -> dict[str, float]:
        """Rows to visit per dataset: the least of LEAF, 2 LEAF, 4 LEAF ... at which the calibration vectors reach the recall. Their
        true neighbours come from all rows; what is farther than the cap is not counted."""
        size = self.rows.groupBy("dataset").agg(F.count("*").alias("_size"))
        chosen = self.rows.join(size, "dataset").filter(_chance(F.col("_size"), queries)).select("dataset", "cid", "vec", "k_nearest", "k_dis_high").toPandas()  # about `queries` per dataset
        ask = {name: (g.cid.to_numpy(), stacked(g.vec), int(g.k_nearest.iloc[0]), float(g.k_dis_high.iloc[0])) for name, g in chosen.groupby("dataset")}
        sent = self.spark.sparkContext.broadcast(ask)

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for name, g in f.groupby("dataset", sort=False):
                    if name not in sent.value:
                        continue
                    cid, q, k, cap = sent.value[name]
                    d = l1(q, stacked(g.vec))
                    d[cid[:, None] == g.cid.to_numpy()[None, :]] = np.inf
                    near = np.argsort(d, axis=1, kind="stable")[:, :k]
                    dist = np.take_along_axis(d, near, 1)
                    i, j = np.nonzero(dist <= cap)
                    yield pd.DataFrame({"dataset": name, "cid": cid[i], "leaf": g.place.to_numpy()[near[i, j]], "d": dist[i, j], "k": k})

        true = self.rows.select("dataset", "cid", "vec", "place").mapInPandas(partial, "dataset string, cid long, leaf int, d double, k int")
        rank = F.row_number().over(Window.partitionBy("cid").orderBy("d"))
        true = true.withColumn("rank", rank).filter("rank <= k").toPandas()  # k rows per calibration vector
        budget = {}
        for name, tree in self.trees.items():
            visit, total = float(LEAF), float(tree.rows.sum())
            if name in ask:
                cid, q, _, _ = ask[name]
                mine = true[true.dataset == name]
                row, leaf = tree.visits(q, np.inf, np.full(len(q), np.inf))
                order = np.argsort(row, kind="stable")
                row, leaf = row[order], leaf[order]
                cum = np.cumsum(tree.rows[leaf])
                before = cum - tree.rows[leaf] - np.concatenate([[0], cum])[np.searchsorted(row, row)]  # rows seen by this row of q before the leaf
                place = {(int(r), int(k)): b for r, k, b in zip(row, leaf, before, strict=True)}
                number = {c: i for i, c in enumerate(cid)}
                need = np.array([place[number[c], k] for c, k in zip(mine.cid, mine.leaf, strict=True)])
                while visit < total and len(need) and (need < visit).mean() < recall:
                    visit *= 2
            budget[name] = 2 * visit  # a margin of one widening over what the calibration vectors needed
        return budget

    def visiting(self, df: DataFrame, budget: dict[str, float], cap: str) -> DataFrame:
        """cid, dataset, leaf: the pages that each row of df (cid, dataset, vec, leaf, cap) visits, written once. The row's own page (column
        leaf) is left out, but for one of several blocks."""
        big = self.leaf_rows

        def visit(g: pd.DataFrame, tree: Tree) -> pd.DataFrame:
            q, within, name = stacked(g.vec), g[cap].to_numpy(float), g.dataset.iloc[0]
            row, leaf = tree.page_of(*tree.visits(q, budget[name], within))
            other = (leaf != g.leaf.to_numpy()[row]) | (tree.page_rows[leaf] > big)
            row, leaf = row[other], leaf[other]
            return pd.DataFrame({"cid": g.cid.to_numpy()[row], "dataset": name, "leaf": leaf.astype(np.int32)})

        return materialize(self.over_trees(df, visit, "cid long, dataset string, leaf int"), "visits")

    def reaching(self, df: DataFrame, cap: str, highest: dict[str, np.ndarray]) -> tuple[DataFrame, int]:
        """The rows of df (cid, dataset, vec, cap, comp) that visit any page, with leaves, the pages that they visit, written once; and how
        many visits these are. Visited is every page with a leaf whose box is within the cap and that holds a component (highest: the largest
        of each leaf) larger than the row's own."""
        if not all(t.low.size for t in self.trees.values()):
            release(self.own_leaf("1", cap, boxes=True))

        def visit(g: pd.DataFrame, tree: Tree) -> pd.DataFrame:
            row, leaf = tree.boxes_within(stacked(g.vec), g[cap].to_numpy(float))
            more = highest[g.dataset.iloc[0]][leaf] > g.comp.to_numpy()[row]
            row, leaf = tree.page_of(row[more], leaf[more])
            who, first = np.unique(row, return_index=True)
            return g.iloc[who].assign(leaves=pd.Series(np.split(leaf.astype(np.int32), first[1:])[: len(who)], g.index[who], dtype=object))

        schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", leaves array<int>"
        out, got = materialize_measured(self.over_trees(df, visit, schema), "visits", n=F.sum(F.size("leaves")))
        return out, got["n"] or 0

    def meeting(self, visits: DataFrame, ask: DataFrame | None, hold: DataFrame, kernel, schema: str) -> DataFrame:
        """kernel(visitors, rows) for each part of the visitors (visits: cid, dataset, leaf; ask: cid and what the kernel wants of them, or
        None if visits has it) of a page and each block of its rows (hold: cid, dataset, leaf, vec, ...)."""
        keys = ["dataset", "leaf", "block", "part"]
        load = visits.groupBy("dataset", "leaf").agg(F.ceil(F.count("*") / VISITORS).alias("parts")).join(self.sizes(), ["dataset", "leaf"])
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        ask = (visits if ask is None else visits.join(ask, "cid")).join(load, ["dataset", "leaf"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts"))).withColumn("block", every("cuts")).drop("parts", "cuts")
        held = hold.join(load, ["dataset", "leaf"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("cuts"))).withColumn("part", every("parts")).drop("parts", "cuts")
        names = held.columns
        held = held.toDF(*(f"r_{c}" for c in names))
        columns = [c.split()[0] for c in schema.split(", ")]

        def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            r.columns = names
            return kernel(q, r) if len(q) and len(r) else pd.DataFrame({c: [] for c in columns})

        return ask.groupBy(*keys).cogroup(held.groupBy(*(f"r_{c}" for c in keys))).applyInPandas(run, schema)

    def own_leaf(self, degree: str, cap: str, *others: str, boxes: bool = False) -> DataFrame:
        """cid, dataset, vec, leaf, bound and others of each class, with near: its nearest `degree` (a column) classes within the cap
        in its own page block, itself among them, as structs of d and cid; bound: the distance of the last of them, or the cap. boxes: the
        trees get the boxes of their leaves, and cid, dataset, leaf, place and block come without the vectors."""
        cols = ["cid", "dataset", "vec", "leaf", *others]
        out = ["cid", "dataset", "leaf", "place", "block"] if boxes else cols
        types = dict(self.rows.dtypes) | {"block": "bigint"}
        schema = ", ".join(f"{c} {types[c]}" for c in out) + ", bound double, gaps array<double>, ids array<bigint>" + ", low array<float>, high array<float>" * boxes

        def kernel(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("cid")
            x, ids, limit = stacked(g.vec), g.cid.to_numpy(), g[cap].to_numpy(float)
            k, gaps, who = int(g._degree.iloc[0]), [], []
            for a in range(0, len(g), 1024):
                d = l1(x[a : a + 1024], x)
                at = np.argsort(d, axis=1, kind="stable")[:, :k]
                gaps.append(np.take_along_axis(d, at, 1))
                who.append(ids[at])
            gaps, who = np.concatenate(gaps), np.concatenate(who)
            last = gaps[:, -1] if gaps.shape[1] == k else np.full(len(g), np.inf)
            n = (gaps <= limit[:, None]).sum(1)
            done = g[out].assign(bound=np.minimum(last, limit), gaps=[r[:m] for r, m in zip(gaps, n, strict=True)], ids=[r[:m] for r, m in zip(who, n, strict=True)])
            return done.assign(**leaf_boxes(x, g.place.to_numpy())) if boxes else done

        def leaf_boxes(x: np.ndarray, place: np.ndarray) -> dict[str, list]:
            """low and high of each leaf's rows, at the first of them, else None."""
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.diff(place[order], prepend=-1))
            ends = {"low": _outward(np.minimum.reduceat(x[order], first), -np.inf), "high": _outward(np.maximum.reduceat(x[order], first), np.inf)}
            at = dict(zip(order[first].tolist(), range(len(first)), strict=True))
            return {c: [v[at[i]] if i in at else None for i in range(len(x))] for c, v in ends.items()}

        cut = self.blocked(self.rows.select(*dict.fromkeys([*cols, "place", cap]), F.expr(degree).cast("int").alias("_degree")))
        done = cut.groupBy("dataset", "leaf", "block").applyInPandas(kernel, schema)
        near = F.zip_with("gaps", "ids", lambda d, c: F.struct(d.alias("d"), c.alias("near")))
        own = materialize(done.withColumn("near", near).drop("gaps", "ids"), "own")
        if boxes:
            ends = own.filter("low is not null").select("dataset", "place", "low", "high").toPandas()  # the leaves, once per block
            for d, g in ends.groupby("dataset"):
                self.trees[d].boxed(g.place.to_numpy(), stacked(g.low), stacked(g.high))
        return own

    def nearest(self, budget: dict[str, float]) -> DataFrame:
        """cid, near: for each class its k_nearest + 1 nearest classes within the cap (itself among them), as sorted structs of d and
        cid."""
        own = self.own_leaf("k_nearest + 1", "k_dis_high", "k_nearest")

        def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            r = r.sort_values("cid")
            k = int(q.k_nearest.iloc[0]) + 1
            x, ids, parts = stacked(r.vec), r.cid.to_numpy(), []
            for a in range(0, len(q), 1024):
                part = q.iloc[a : a + 1024]
                d = l1(stacked(part.vec), x)
                d[(d > part.bound.to_numpy()[:, None]) | (part.cid.to_numpy()[:, None] == ids[None, :])] = np.inf
                rows = np.flatnonzero(np.isfinite(d).any(1))
                near = np.argsort(d[rows], axis=1, kind="stable")[:, :k]
                dist = np.take_along_axis(d[rows], near, 1)
                i, j = np.nonzero(np.isfinite(dist))
                parts.append(pd.DataFrame({"cid": part.cid.to_numpy()[rows[i]], "d": dist[i, j], "near": ids[near[i, j]]}))
            return pd.concat(parts)

        visits = self.visiting(own.select("cid", "dataset", "vec", "leaf", "bound"), budget, "bound")
        more = self.meeting(visits, own.select("cid", "vec", "bound", "k_nearest"), self.rows.select("cid", "dataset", "leaf", "vec"), search, "cid long, d double, near long")
        lists = more.groupBy("cid").agg(F.collect_list(F.struct("d", "near")).alias("more"))  # at most the visits of one class times k
        both = own.select("cid", "near", "k_nearest").join(lists, "cid", "left")
        every = F.array_sort(F.array_distinct(F.concat("near", F.coalesce("more", F.array().cast("array<struct<d: double, near: bigint>>")))))
        done = materialize(both.select("cid", F.slice(every, F.lit(1), F.col("k_nearest") + 1).alias("near")), "lists")
        release(own)
        release(visits)
        return done


def neighbours(ctrans: DataFrame, hyper: DataFrame, budget: dict[str, float] | None = None) -> DataFrame:
    """sample_id, dataset, rank, near_id, d: the k_nearest nearest samples within the dataset's cap of every usable sample."""
    index = Index(usable_vectors(ctrans, hyper))
    return index_neighbours(index, budget or index.calibrate())


def index_neighbours(index: Index, budget: dict[str, float]) -> DataFrame:
    lists = index.nearest(budget)
    members = materialize(index.members(), "members")
    most = index.rows.agg(F.max("k_nearest")).first()[0] or 0
    few = members.withColumn("rank", F.row_number().over(Window.partitionBy("cid").orderBy("sample_id"))).filter(F.col("rank") <= int(most) + 1)
    ids = few.groupBy("cid").agg(F.array_sort(F.collect_list("sample_id")).alias("ids"))
    opened = lists.select("cid", F.explode("near").alias("e")).join(ids.withColumnRenamed("cid", "near"), F.col("e.near") == F.col("near")).select("cid", F.col("e.d").alias("d"), F.explode("ids").alias("near_id"))
    near = opened.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("d", "near_id"))).alias("near"))
    k = index.rows.select("cid", "dataset", "k_nearest")
    each = members.join(near, "cid").join(k, "cid")
    own = F.slice(F.filter("near", lambda x: x["near_id"] != F.col("sample_id")), F.lit(1), F.col("k_nearest"))
    return each.select("sample_id", "dataset", F.posexplode(own).alias("rank", "e")).select("sample_id", "dataset", (F.col("rank") + 1).alias("rank"), F.col("e.near_id").alias("near_id"), F.col("e.d").alias("d"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    return near.select(F.least("sample_id", "near_id").alias("sample_a"), F.greatest("sample_id", "near_id").alias("sample_b")).distinct()


def measured_recall(index: Index, near: DataFrame, every: int = 20) -> DataFrame:
    """Recall per dataset: the rows whose sample_id is divisible by `every`, against all rows, by brute force in blocks."""
    rows = index.vectors.withColumnRenamed("sample_id", "id")
    ask = rows.filter(F.col("id") % every == 0).select("id", "dataset", "vec", "k_nearest", "k_dis_high")

    def brute(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("id")
        d = l1(stacked(q.vec), stacked(r.vec))
        d[(q.id.to_numpy()[:, None] == r.id.to_numpy()[None, :]) | (d > q.k_dis_high.to_numpy()[:, None])] = np.inf
        k = int(q.k_nearest.iloc[0])
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist = np.take_along_axis(d, near, 1)
        i, j = np.nonzero(np.isfinite(dist))
        return pd.DataFrame({"sample_id": q.id.to_numpy()[i], "near_id": r.id.to_numpy()[near[i, j]], "d": dist[i, j], "k": k})

    all_near = meet(ask, rows.select("id", "dataset", "vec"), brute, "sample_id long, near_id long, d double, k long", ["dataset"])
    true = all_near.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy("d", "near_id"))).filter("rank <= k")
    hit = near.select("sample_id", "near_id", F.lit(1).alias("hit"), "dataset")
    names = index.vectors.select("sample_id", F.col("dataset").alias("dataset"))
    joined = true.join(names, "sample_id").join(hit.drop("dataset"), ["sample_id", "near_id"], "left")
    return joined.groupBy("dataset").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_true"))
