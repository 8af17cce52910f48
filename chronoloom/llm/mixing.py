"""Mixing sources to target weights.

Documents of a source are laid end to end by their tokens and packed into blocks of a fixed number of tokens. Every output shard
draws a multinomial number of slots per source; totals are corrected to the exact targets by a last shard. The i-th slot of a
source takes block perm(i mod blocks), with another pseudorandom permutation for each round, so that no block is used more than
max_repeats times; slots and blocks are joined by that index. A source's slots are taken in their order until its target is
reached, the last one in part; a source has a shortfall if all that was drawn from it is less than its target.

Order and offsets come from two-level running sums: a source with a third of all rows is spread over many buckets.

Defined results: sources are compared without case and outer blanks; documents with null source are left out of sizes, of the
total and of the mix; null or empty texts have 0 tokens and fill no block; a target source without documents has size 0 and
gets nothing; weights are used as given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.storage import materialize

BLOCK_TOKENS, SHARD_SLOTS, BUCKET_ROWS = 512, 256, 50_000
#: \w+|[^\w\s]+ with Unicode meaning, in the words of the JVM's regular expressions.
WORD, BLANK = r"\p{L}\p{N}_", r"\t-\r\x1c-\x20\x85\p{Z}"
TOKEN_PATTERN = rf"[{WORD}]+|[^{WORD}{BLANK}]+"


def source_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0)).cast("long")


def sizes_by_vocabulary(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """doc_id, source, n_tok by a public tokenizer's file (tokenizers library) instead of the pattern. The file is read where the query
    is made and sent to the workers: a vocabulary, of some megabytes."""
    with open(vocabulary_file, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(sent.value)
        t.encode_special_tokens = True
        for f in frames:
            n = [len(e.ids) for e in t.encode_batch(f.text.fillna("").tolist(), add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": f.doc_id, "source": f.source, "n_tok": n})

    return docs.filter("source is not null").select("doc_id", source_key(F.col("source")).alias("source"), "text").mapInPandas(kernel, "doc_id long, source string, n_tok long")


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.filter("source is not null").select("doc_id", source_key(F.col("source")).alias("source"), token_count(F.col("text")).alias("n_tok"))


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of value over the rows before each, within keys, in the order (bucket, *order). The bucket totals are
    summed first, so that a window holds the buckets of a key or the rows of a bucket, never all rows of a key."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_t"))
    base = totals.withColumn("_base", F.sum("_t").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("_t")).drop("_t")
    inner = F.sum(value).over(Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return df.withColumn("_in", inner).join(base, [*keys, bucket]).withColumn(out, F.col("_in") + F.col("_base")).drop("_in", "_base")


def permuted(i: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each seed, at i: a four-round Feistel network over the next power of four,
    walked until the image is below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = i.astype(np.uint64), np.ones(len(i), bool)
    limit = n.astype(np.uint64)
    with np.errstate(over="ignore"):
        while todo.any():
            hi, lo = x[todo] >> half[todo], x[todo] & mask[todo]
            for k in range(4):
                h = (lo ^ seed[todo].astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                hi, lo = lo, hi ^ ((h ^ (h >> np.uint64(32))) & mask[todo])
            x[todo] = (hi << half[todo]) | lo
            todo = x >= limit
    return x.astype(np.int64)


def mix_plan(sizes: DataFrame, targets: DataFrame, total: int, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per mix and source: total (of all sources), size, target, capacity, blocks, slots."""
    per = sizes.groupBy("source").agg(F.sum("n_tok").alias("size"))
    plan = targets.withColumn("source_key", source_key(F.col("source"))).join(per.withColumnRenamed("source", "source_key"), "source_key", "left").withColumn("total", F.lit(total))
    blocks = F.ceil(F.col("size") / block).cast("long")
    return (
        plan.withColumn("size", F.coalesce("size", F.lit(0)))
        .withColumn("target", F.col("weight") * F.col("budget_share") * F.col("total"))
        .withColumn("capacity", F.col("max_repeats") * F.col("size"))
        .withColumn("blocks", blocks)
        # One block of a source may be short in each round, so that many slots more are enough.
        .withColumn("slots", F.when(F.col("target") > 0, F.least(F.ceil(F.col("target") / block).cast("long") + F.col("max_repeats"), F.col("max_repeats") * F.col("blocks"))))
        .withColumn("shards", F.ceil(F.sum("slots").over(Window.partitionBy("mix_id")) / SHARD_SLOTS).cast("long"))
    )


def packed_blocks(sizes: DataFrame, rows: int, block: int = BLOCK_TOKENS) -> DataFrame:
    """source, block, doc_id, at, from_tok, to_tok: the pieces of documents in each block, from its token `at` on. rows: about how many
    rows sizes has."""
    buckets = max(16, rows // BUCKET_ROWS)
    laid = running_total(sizes.filter("n_tok > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))), ["source"], "bucket", ["doc_id"], "n_tok", "start")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tok") - 1) / block)
    pieces = laid.withColumn("block", F.explode(F.sequence(first, last)))
    a = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    b = F.least((F.col("block") + 1) * block - F.col("start"), F.col("n_tok"))
    return pieces.select("source", "block", "doc_id", F.greatest(F.col("start") - F.col("block") * block, F.lit(0)).alias("at"), a.alias("from_tok"), b.alias("to_tok"))


def drawn_slots(plan: DataFrame, seed: int = 11) -> DataFrame:
    """mix_id, source_key, shard, slot (number within the source), block, repeat."""

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for mix, shard, keys, share in zip(f.mix_id, f.shard, f.source_keys, f.shares, strict=True):
                p = np.asarray(share, float)
                n = np.random.default_rng([seed, int(mix), int(shard)]).multinomial(SHARD_SLOTS, p / p.sum())
                rows += [(mix, shard, k, int(c)) for k, c in zip(keys, n, strict=True) if c]
            yield pd.DataFrame(rows, columns=["mix_id", "shard", "source_key", "n"])

    live = plan.filter("slots > 0")
    per_mix = live.groupBy("mix_id").agg(F.max("shards").alias("shards"), F.array_sort(F.collect_list(F.struct("source_key", "slots"))).alias("s"))
    shards = per_mix.select("mix_id", F.col("s.source_key").alias("source_keys"), F.col("s.slots").alias("shares"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    drawn = shards.mapInPandas(counts, "mix_id int, shard long, source_key string, n long")
    total = drawn.groupBy("mix_id", "source_key").agg(F.sum("n").alias("n"))
    rest = live.join(total, ["mix_id", "source_key"], "left").select("mix_id", F.col("shards").alias("shard"), "source_key", (F.col("slots") - F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0")
    ranged = running_total(drawn.unionByName(rest).withColumn("bucket", F.floor(F.col("shard") / 4096)), ["mix_id", "source_key"], "bucket", ["shard"], "n", "start")
    slots = ranged.join(live.select("mix_id", "source_key", "slots", "blocks"), ["mix_id", "source_key"]).withColumn("slot", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1))).filter("slot < slots")
    slots = slots.withColumn("repeat", F.floor(F.col("slot") / F.col("blocks"))).withColumn("key", F.xxhash64(F.lit(seed), "mix_id", "source_key", "repeat"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = permuted((f.slot % f.blocks).to_numpy(np.int64), f.blocks.to_numpy(np.int64), f.key.to_numpy(np.int64))
            yield pd.DataFrame({"mix_id": f.mix_id, "source_key": f.source_key, "shard": f.shard, "slot": f.slot, "block": at, "repeat": f.repeat})

    return slots.select("mix_id", "source_key", "shard", "slot", "blocks", "repeat", "key").mapInPandas(place, "mix_id int, source_key string, shard long, slot long, block long, repeat long")


class Mix:
    """The mixing operator over sizes (doc_id, source, n_tok) and targets."""

    def __init__(self, sizes: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS, seed: int = 11) -> None:
        self.sizes = materialize(sizes, "sizes")
        self.rows, total = self.sizes.agg(F.count("*"), F.coalesce(F.sum("n_tok"), F.lit(0))).first()
        self.plan = materialize(mix_plan(self.sizes, targets, total, block), "plan")
        self.blocks = materialize(packed_blocks(self.sizes, self.rows, block), "blocks")
        self.slots = materialize(self._taken(drawn_slots(self.plan, seed)), "slots")

    def _taken(self, slots: DataFrame) -> DataFrame:
        """The slots up to each source's target, with the tokens taken from their blocks."""
        filled = self.blocks.groupBy(F.col("source").alias("source_key"), "block").agg(F.sum(F.col("to_tok") - F.col("from_tok")).alias("n"))
        held = slots.join(filled, ["source_key", "block"]).withColumn("bucket", F.floor(F.col("slot") / 4096))
        laid = running_total(held, ["mix_id", "source_key"], "bucket", ["slot"], "n", "start")
        want = self.plan.select("mix_id", "source_key", F.ceil("target").cast("long").alias("want"))
        return laid.join(want, ["mix_id", "source_key"]).filter("start < want").withColumn("take", F.least("n", F.col("want") - F.col("start"))).drop("bucket", "n", "start", "want")

    def records(self) -> DataFrame:
        """mix_id, shard, source, slot, repeat, doc_id, from_tok, to_tok: the mix, piece by piece."""
        b = self.blocks.withColumnRenamed("source", "source_key")
        end = F.least("to_tok", F.col("from_tok") + F.col("take") - F.col("at"))
        cut = self.slots.join(b, ["source_key", "block"]).filter("at < take").withColumn("to_tok", end)
        return cut.select("mix_id", "shard", F.col("source_key").alias("source"), "slot", "repeat", "doc_id", "from_tok", "to_tok")

    def report(self) -> DataFrame:
        """Per mix and source: target, size, capacity, tokens drawn, actual share, most repeats, shortfall and failed, both from what
        was drawn."""
        got = self.slots.groupBy("mix_id", "source_key").agg(F.sum("take").alias("drawn"), (F.max("repeat") + 1).alias("repeats"))
        out = self.plan.join(got, ["mix_id", "source_key"], "left").fillna(0, ["drawn", "repeats"])
        total = F.sum("drawn").over(Window.partitionBy("mix_id"))
        short = F.greatest(F.col("target") - F.col("drawn"), F.lit(0.0))
        return out.select("mix_id", "source", "weight", "max_repeats", "total", "size", "target", "capacity", "drawn", F.when(total > 0, F.col("drawn") / total).alias("actual_share"), "repeats", short.alias("shortfall"), (F.col("drawn") < F.col("target")).alias("failed"))
