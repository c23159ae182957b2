"""Mixing sources to target weights.

The words of a source's documents, put end to end, are packed into blocks of BLOCK words. The mix
is a sequence of slots: each source gets as many as its target needs, and each output shard draws
its source counts from a multinomial distribution over what the sources have left, so that the
totals come out at the targets (the last shard takes what remains, and the last slot of a source is
cut to the word). Slot s of a source with n blocks names block p(s mod n), where p is a
pseudorandom permutation of the n indices that belongs to the source and to the pass s div n. The
blocks are then joined by index with the documents that they overlap.

A target is at most twice its source's size, so a source is passed over twice at most, and no word
is taken more than twice.

Defined cases: a null text has size 0, and documents of size 0 are never taken; texts may be of any length; null is a
source, after all others; repeated rows are mixed each for itself; with equal doc_ids, or none, which of the rows
comes first is fixed by a hash of their size, so that they are spread; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.llm.common import cut, cut_table, fresh, mix, partitions, prefix_sums, row_keys, scope, small_batches, taken
from stripmill.operators.running import spread

BLOCK = 256
SHARDS = 64
WEIGHTS = (5, 2, 1)
#: Words to take in all, and of one source at most, by the words there are.
SHARE, MOST = 1.5, 2
SEED = 17
#: Sources whose totals are broadcast; with more of them they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def targets(sizes: list[int]) -> list[float]:
    """Words to take of each source, in order: SHARE of all words by the repeating weights, where
    what would exceed MOST times a source's size is shared among the others until none is above."""
    weights = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), SHARE * sum(sizes)
    while free:
        unit = left / sum(weights[k] for k in sorted(free))
        full = [k for k in sorted(free) if unit * weights[k] > MOST * sizes[k]]
        for k in full:
            out[k] = float(MOST * sizes[k])
            left -= out[k]
            free.discard(k)
        if not full:
            for k in free:
                out[k] = unit * weights[k]
            break
    return out


class Permutation:
    """Pseudorandom permutations of range(n): Feistel rounds, walked until inside the range."""

    def __init__(self, n: np.ndarray, key: np.ndarray):
        self.n, self.key = n.astype(np.uint64), key.astype(np.uint64)
        self.bits = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) for x in np.unique(n)], np.uint64)[np.unique(n, return_inverse=True)[1]]

    def _rounds(self, x: np.ndarray, at: np.ndarray, order: range) -> np.ndarray:
        half = self.bits[at]
        low_mask = (np.uint64(1) << half) - np.uint64(1)
        left, right = x >> half, x & low_mask
        for k in order:
            with np.errstate(over="ignore"):
                if order.step > 0:
                    left, right = right, left ^ (mix(right + self.key[at] * np.uint64(8) + np.uint64(k)) & low_mask)
                else:
                    left, right = right ^ (mix(left + self.key[at] * np.uint64(8) + np.uint64(k)) & low_mask), left
        return left << half | right

    def _walk(self, x: np.ndarray, order: range) -> np.ndarray:
        x = x.astype(np.uint64)
        at = np.arange(len(x))
        while len(at):
            x[at] = self._rounds(x[at], at, order)
            at = at[x[at] >= self.n[at]]
        return x.astype(np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, range(0, 4))

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, range(3, -1, -1))


class Plan:
    """Slots of the mix: for each source their number, words in the last one, and shards."""

    def __init__(self, sources: list[str | None], sizes: list[int]):
        self.sources, self.targets = sources, targets(sizes)
        size = np.array(sizes, np.int64)
        words = np.minimum(np.rint(self.targets).astype(np.int64), MOST * size)
        self.blocks = -(-size // BLOCK)
        self.last_words = size - (self.blocks - 1) * BLOCK
        self.slots, self.cut = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        there = np.flatnonzero(words)
        passes, rest = words[there] // size[there], words[there] % size[there]
        # where, in the unfinished pass, the source's short block comes
        short = Permutation(self.blocks[there], self.key(there, passes)).inverse(self.blocks[there] - 1)
        lost = BLOCK - self.last_words[there]
        # slots up to the word where the pass ends; behind the short block they stand `lost` words earlier
        slots = -(-rest // BLOCK)
        behind = rest > short * BLOCK + self.last_words[there]
        slots = np.where(behind, -(-(rest + lost) // BLOCK), slots)
        before = (slots - 1) * BLOCK - np.where(slots - 1 > short, lost, 0)
        self.slots[there] = passes * self.blocks[there] + slots
        self.cut[there] = np.where(slots > 0, rest - before, np.iinfo(np.int64).max)
        self.total = int(self.slots.sum())
        self.ends = np.cumsum(self.slots)
        self.shard_ends = np.cumsum(self.draw().T.ravel())

    @staticmethod
    def key(source: np.ndarray, pass_: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(np.asarray(source).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(pass_).astype(np.uint64) + np.uint64(SEED))

    def draw(self) -> np.ndarray:
        """Slots of each shard by source."""
        rng, left, out = np.random.default_rng(SEED), self.slots.copy(), np.zeros((SHARDS, len(self.slots)), np.int64)
        for shard in range(SHARDS):
            wanted = int(left.sum()) // (SHARDS - shard)
            if wanted:
                out[shard] = np.minimum(rng.multinomial(wanted, left / left.sum()), left)
                # a draw beyond what a source has left goes to those with most left
                for k in np.argsort(-(left - out[shard]), kind="stable"):
                    if not (lack := wanted - int(out[shard].sum())):
                        break
                    out[shard, k] += min(lack, left[k] - out[shard, k])
            left -= out[shard]
        return out

    def table(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(source, block, words taken, shard) of slots by their number in the whole mix."""
        source = np.searchsorted(self.ends, ids, side="right")
        slot = ids - (self.ends[source] - self.slots[source])
        n = self.blocks[source]
        block = Permutation(n, self.key(source, slot // n)).of(slot % n)
        words = np.where(block == n - 1, self.last_words[source], BLOCK)
        words = np.where(slot == self.slots[source] - 1, np.minimum(words, self.cut[source]), words)
        return source, block, words, np.searchsorted(self.shard_ends, ids, side="right") % SHARDS


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, the first column, gives way to its size, the last."""
    for batch in batches:
        sizes = [len(x.as_py().split()) if x.is_valid else 0 for x in batch.column(0).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64())], [*batch.schema.names[1:], "size"])


def _slots(plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            source, block, words, shard = p.table(ids)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, shard, source, block, words)], ["slot", "shard", "number", "block", "words"])

    return run


class Mixture:
    """The mix of a table of documents: `slots` (slot, shard, number, block, words) and `rows`, one
    for each document: doc_id, source_size, target, size, start (its place among its source's
    words), taken, copies (how often its first word is taken), and `keys`, columns of longs that come along and settle
    the order where doc_id and size don't."""

    def __init__(self, docs: DataFrame, keys: tuple[str, ...] = ()):
        spark = docs.sparkSession
        small_batches(spark)
        texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *keys)
        rows = cut(texts.mapInArrow(_sized, ", ".join(["doc_id long, source string", *[f"`{k}` long" for k in keys], "size long"])))
        found = sorted(((s is None, s or "", s, n) for s, n in rows.groupBy("source").agg(F.sum("size")).collect()), key=lambda x: x[:2])
        plan = Plan([x[2] for x in found], [x[3] for x in found])
        table = spark.createDataFrame([(k, s, n, t) for k, (_, _, s, n), t in zip(range(len(found)), found, plan.targets)], "number long, of string, source_size long, target double")
        table = F.broadcast(table) if len(found) <= BROADCAST_SOURCES else table
        rows = rows.join(table, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "number", "source_size", "target", "size", *keys)
        n = 4 * partitions(spark)
        # rows that nothing tells apart are one row until they have their places
        alike = ["number", "doc_id", "size", "source_size", "target", *keys]
        each = rows.where("size > 0").groupBy(*alike).agg(F.count("*").alias("_rows")).withColumn("_words", F.col("size") * F.col("_rows"))
        each = each.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(n)))
        each = prefix_sums(each, ["number"], "chunk", ["doc_id", "size", *keys], "_words", "_start_of")
        placed = spread(each, F.lit(0).cast("long"), "_rows", "_nth").withColumn("start", F.col("_start_of") + F.col("_nth") * F.col("size")).select(*alike, "start")
        shared = spark.sparkContext.broadcast(plan)
        self.slots = spark.range(plan.total).mapInArrow(_slots(shared), "slot long, shard long, number long, block long, words long")
        first, last = F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")
        pieces = placed.withColumn("b", F.explode(F.sequence(first, last)))
        low = F.greatest(F.col("start") - F.col("b") * BLOCK, F.lit(0))
        high = F.least(F.col("start") + F.col("size") - F.col("b") * BLOCK, F.lit(BLOCK))
        pieces = pieces.withColumn("low", low).withColumn("high", high).withColumnRenamed("number", "n")
        met = pieces.join(self.slots, (F.col("n") == F.col("number")) & (F.col("b") == F.col("block")), "left")
        words = F.when(F.col("words").isNotNull(), F.greatest(F.lit(0), F.least("high", "words") - F.col("low")))
        head = (F.col("b") == first) & (F.col("words") > F.col("low"))
        taken = met.groupBy("n", "start", "doc_id", "size", "source_size", "target", *keys).agg(F.coalesce(F.sum(words), F.lit(0)).alias("taken"), F.count(F.when(head, 1)).alias("copies"))
        out = ["doc_id", "size", "source_size", "target", "start", "taken", "copies", *keys]
        nothing = rows.where("size = 0").withColumns({"start": F.lit(None).cast("long"), "taken": F.lit(0).cast("long"), "copies": F.lit(0).cast("long")})
        self.rows = taken.select(*out).unionByName(nothing.select(*out))


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs."""
    return Mixture(docs).rows.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes its first word: none, once or twice. Rows are told apart by all their
    columns; of rows that are the same in all, one stands for the others and comes as often as all of them."""
    spark = docs.sparkSession
    one, two = fresh(docs, "_one"), fresh(docs, "_two")
    keyed = docs.withColumns(dict(zip((one, two), row_keys(docs))))
    with scope(spark) as keep:
        times = Mixture(keyed, (one, two)).rows.groupBy(one, two).agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).where("n > 0")
        return taken(keyed, (one, two), keep(cut_table(times)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
