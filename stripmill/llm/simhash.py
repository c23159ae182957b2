"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles. Distinct
fingerprints go to buckets by bits that two of them within the radius must share (with radius r
and m blocks of bits, any such pair agrees in m - r blocks), and each run of buckets is compared
bit-sliced: bit planes stand vertically, 64 pairs to a machine word, distances are kept in
carry-save counters of a few planes, and words are abandoned once all their pairs exceed the radius.
The fingerprints of a bucket over BUCKET are dealt anew, in the same way, by blocks of the bits that the bucket leaves
open, until the buckets are small or few bits are left open, which bounds their size.

For near-duplicates by shingle sets at a similarity of SIMILAR, fingerprints are linked in the same way; documents whose prints
are farther apart, as those of many such pairs are, meet by bands of min-hashes besides. Every link is verified on the sets: see
similar_components() and one_of_each().

Defined cases: null and empty texts have fingerprint zero and are linked like any other; rows
with equal texts, or repeated rows, each keep their row; a null doc_id takes part in links but is
never a component id unless nothing else is in the component (then the id is null); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.llm.common import components, cut, cut_table, fresh, hot_share, joined, mix, row_keys, scope, small_batches, taken

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
BLOCKS = 4
#: Buckets with more fingerprints are dealt anew; open bits with fewer values are not.
BUCKET, LEAST_OPEN = 1024, 1 << 8
#: Rows compared at once; a bucket is never cut.
CHUNK_ROWS = 1 << 17
_VOTES = 1 << 15
#: For the shingle sets of near-duplicates: words in a shingle, least similarity as a fraction, bands, and
#: min-hashes in a band.
WIDE_SHINGLE, SIMILAR, BANDS, BAND_ROWS = 5, (4, 5), 25, 5
#: Shingles of the documents that one task compares, about.
BLOCK_SHINGLES = 1 << 18


def majority(text: str | None, width: int = SHINGLE_WORDS, size: int = 1) -> np.ndarray:
    """64-bit words of the bits set in over half of the shingle hashes; zero for a text without words.
    ASCII letters are lower-cased and words end at ASCII white space: bytes.lower and bytes.split do
    both. Words after the first come from the same hashes, mixed anew."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(size, np.uint64)
    grams = zip(*(words[k:] for k in range(width))) if len(words) > width else [words]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), np.uint64, n)
    votes = np.zeros(64 * size, np.int64)
    for at in range(0, n, _VOTES):
        part = hashes[at : at + _VOTES]
        for k in range(size):
            with np.errstate(over="ignore"):
                bits = part if k == 0 else mix(part + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
            votes[64 * k : 64 * k + 64] += np.unpackbits(bits.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > n, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    return int(majority(text, width)[0])


def _fingerprints(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a long."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(width), "doc_id long, fp long")


def near_pairs(keys: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """For fingerprints in order of key: the first row of each one's group, groups being joined by
    pairs within a key that differ in at most `radius` bits. prints: a row of one or more words each."""
    n = len(prints)
    size = prints.size // max(1, n)
    label = np.arange(n)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows of the key from here on
    longest = int(sizes.max(initial=0))
    words = (n + 63) // 64
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, 8 * size), axis=1, bitorder="little").T
    bits = np.pad(bits, ((0, 0), (0, 64 * (words + 1 + (longest + 63) // 64) - n)))
    planes = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)
    del bits
    top = (radius + 1).bit_length()
    for d in range(1, longest):
        wanted = np.packbits(np.pad(left > d, (0, 64 * words - n)), bitorder="little").view(np.uint64)
        at = np.flatnonzero(wanted)
        alive = wanted[at]
        counters = [np.zeros(len(at), np.uint64) for _ in range(top)]
        step, shift = d // 64, np.uint64(d % 64)
        for p in range(64 * size):
            plane = planes[p]
            other = plane[at + step]
            if shift:
                other = (other >> shift) | (plane[at + step + 1] << np.uint64(64 - int(shift)))
            carry = plane[at] ^ other
            over = ~np.uint64(0)
            for k in range(top):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
                over = over & (counters[k] if (radius + 1) >> k & 1 else ~counters[k])
            alive &= ~over
            if p % 8 == 7:
                kept = np.flatnonzero(alive)
                if len(kept) < len(at):
                    at, alive, counters = at[kept], alive[kept], [c[kept] for c in counters]
                if not len(at):
                    break
        if len(at):
            word, bit = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little"))
            i = at[word] * 64 + bit
            j = i + d
            while True:
                li, lj = label[i], label[j]
                if (li == lj).all():
                    break
                np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
                while (label[label] != label).any():
                    label = label[label]
    return label


def _links(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def compare(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        label = near_pairs(keys, prints, radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(prints[linked].view(np.int64)), pa.array(prints[label[linked]].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            prints = np.r_[prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if len(keys) >= CHUNK_ROWS and keys[0] != keys[-1]:
                whole = int(np.searchsorted(keys, keys[-1]))
                yield compare(keys[:whole], prints[:whole])
                keys, prints = keys[whole:], prints[whole:]
        if len(keys):
            yield compare(keys, prints)

    return run


def _deals(bits: tuple[int, ...], radius: int, blocks: int) -> list[tuple[int, ...]]:
    """For every choice of blocks of the given bits that a pair within the radius may share: the bits left open."""
    edges = [len(bits) * k // blocks for k in range(blocks + 1)]
    parts = [bits[edges[k] : edges[k + 1]] for k in range(blocks)]
    return [tuple(b for k in open_ for b in parts[k]) for open_ in combinations(range(blocks), radius)]


def _mask(open_: tuple[int, ...]) -> int:
    """The bits that are not open, as a long."""
    shared = (1 << 64) - 1 - sum(1 << b for b in open_)
    return shared - (1 << 64) if shared >> 63 else shared


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of column fp that join all those within `radius`
    bits: a star for each group in a bucket, never all its pairs."""
    if blocks <= radius:
        raise ValueError("a pair within the radius must share a block")
    found, rows, level = [], prints.select("fp", F.lit(0).alias("at")), [tuple(range(64))]
    while True:
        # each row's bucket leaves the bits level[at] open; it goes to a bucket for each deal of these
        deals = [_deals(bits, radius, blocks) for bits in level]
        number = [sum(map(len, deals[:k])) for k in range(len(deals))]
        table = F.array(*[F.array(*[F.struct(F.lit(number[k] + n).alias("at"), F.lit(_mask(open_)).alias("mask")) for n, open_ in enumerate(deal)]) for k, deal in enumerate(deals)])
        dealt = rows.select("fp", F.explode(F.element_at(table, F.col("at") + 1)).alias("d"))
        dealt = dealt.select("fp", F.col("d.at").alias("at"), F.xxhash64(F.col("d.mask"), F.col("fp").bitwiseAND(F.col("d.mask"))).alias("key"))
        level = [open_ for deal in deals for open_ in deal]
        shared = cut_table(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        met = dealt.join(shared, "key")
        left = max(map(len, level))
        last = left < blocks or 1 << left <= LEAST_OPEN
        small = met if last else met.where(F.col("n") <= bucket)
        found.append(cut_table(small.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(radius), "a long, b long")))
        if last or shared.where(F.col("n") > bucket).isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows = cut_table(met.where(F.col("n") > bucket).select("fp", "at").distinct())


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs."""
    found = linked(cut(fingerprints(docs, width)), radius, blocks, bucket)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def linked(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row of prints (doc_id, fp), which are written; component_id is the smallest doc_id reachable."""
    spark = prints.sparkSession
    with scope(spark) as keep:
        share = hot_share(spark, prints.count())
        distinct = cut_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")))
        ids = components(links(distinct, radius, blocks, bucket))
        rooted = cut_table(distinct.join(ids, distinct.fp == ids.node, "left").select("fp", "first", "many", F.coalesce("root", "fp").alias("root")))
        least = rooted.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"), (F.count("*") > share).alias("hot"))
        by_print = joined(rooted, "root", cut_table(least), "of").select(F.col("fp").alias("of"), "component_id", (F.col("many") > share).alias("hot"))
        by_print = keep(cut_table(by_print))
    return joined(prints, "fp", by_print, "of").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's WIDE_SHINGLE-word shingles, words as in majority(); none for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*(words[k:] for k in range(WIDE_SHINGLE))) if len(words) > WIDE_SHINGLE else [words]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each of BANDS bands: the number of the band and its BAND_ROWS min-hashes, mixed."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(7).integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        least = np.min([(mix(shingles[at : at + 4096]) * factors).min(axis=1) for at in range(0, len(shingles), 4096)], axis=0).reshape(BANDS, BAND_ROWS)
        keys = np.arange(BANDS, dtype=np.uint64)
        for k in range(BAND_ROWS):
            keys = mix(mix(keys) + least[:, k])
    return keys


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(x.as_py()) for x in batch.column(2)]
        nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
        keys = pa.array([band_keys(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array(map(len, sets), pa.int64()), keys, pa.array(prints)], ["_row", "doc_id", "node", "n", "keys", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([shingle_set(x.as_py()).tobytes() for x in batch.column(4)], pa.binary())], ["comp", "node", "n", "blocks", "shingles"])


def similar_sets(sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """For each set the first one of its group, groups being those of `known` joined by pairs with a
    Jaccard similarity of SIMILAR or more. Pairs within a group are not compared."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    _, first, label = np.unique(known, return_index=True, return_inverse=True)
    label = first[label.reshape(-1)]
    _, gram = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    gram, owner = gram.reshape(-1), np.repeat(np.arange(n), sizes)
    holders = owner[np.argsort(gram, kind="stable")]
    begin = np.r_[0, np.cumsum(np.bincount(gram))]
    ends = np.cumsum(sizes)
    for i in range(n - 1):
        if (label[i + 1 :] == label[i]).all():
            if (label == label[i]).all():
                break
            continue
        mine = gram[ends[i] - sizes[i] : ends[i]]
        times = begin[mine + 1] - begin[mine]
        met = holders[np.repeat(begin[mine] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())]
        shared = np.bincount(met, minlength=n)
        near = np.flatnonzero((shared > 0) & (SIMILAR[1] * shared >= SIMILAR[0] * (sizes[i] + sizes - shared)))
        joined = np.unique(label[near])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return label


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that join the nodes of each run of rows (key, node, sub, shingles) as similar_sets does."""

    def compare(nodes: list[int], subs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        label = similar_sets(sets, np.array(subs, np.int64))
        at = np.array(nodes, np.int64)
        linked = np.flatnonzero(at != at[label])
        return pa.RecordBatch.from_arrays([pa.array(at[linked]), pa.array(at[label[linked]])], ["a", "b"])

    key, nodes, subs, sets = None, [], [], []
    for batch in batches:
        for k, node, sub, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if k != key and len(nodes) > 1:
                yield compare(nodes, subs, sets)
            if k != key:
                key, nodes, subs, sets = k, [], [], []
            nodes.append(node)
            subs.append(sub)
            sets.append(np.frombuffer(data.as_py(), np.uint64))
    if len(nodes) > 1:
        yield compare(nodes, subs, sets)


def _compared(rows: DataFrame) -> DataFrame:
    """Verified edges of rows (key, side, node, sub, shingles) with equal key; those of the first side are compared first."""
    return cut_table(rows.repartition("key").sortWithinPartitions("key", "side", "node").select("key", "node", "sub", "shingles").mapInArrow(_verified, "a long, b long"))


def _blocks(rows: DataFrame, by: str, bucket: int) -> DataFrame:
    """(of, blocks): into how many blocks the rows of each group are cut to keep to the bounds of a task."""
    many = F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count("*") / F.lit(bucket)), F.lit(1))
    return rows.groupBy(F.col(by).alias("of")).agg(many.cast("long").alias("blocks"))


def _within_blocks(rows: DataFrame) -> DataFrame:
    dealt = rows.withColumn("key", F.xxhash64("comp", F.pmod(F.xxhash64("node"), "blocks")))
    return _compared(dealt.select("key", F.lit(0).alias("side"), "node", F.col("node").alias("sub"), "shingles"))


def _with_sub(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with `sub`, their group by the edges, by a merge join: what grows with the documents is not broadcast."""
    found = components(edges).withColumnRenamed("node", "_node").hint("merge")
    return rows.join(found, F.col("node") == F.col("_node"), "left").select(*rows.columns, F.coalesce("root", "node").alias("sub"))


def verified_links(sets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that join all rows (comp, node, n, blocks, shingles) of equal comp whose shingle sets have a
    similarity of SIMILAR or more; blocks as _blocks() says.

    A comp within `bucket` documents and BLOCK_SHINGLES shingles is compared in one task. Larger ones are
    cut into blocks: first each block is compared within, then one member for each group found, to join
    copies across blocks. What is then outside the largest group of its comp is compared, block by block,
    with all of that comp; only pairs already in one group are left out."""
    edges = _within_blocks(sets)
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return edges
    large = cut_table(large)
    reps = cut_table(_with_sub(large, edges).where("node = sub").drop("sub", "blocks"))
    anew = cut_table(_blocks(reps, "comp", bucket))  # large groups only, each of BLOCK_SHINGLES shingles or `bucket` documents
    edges = edges.unionByName(_within_blocks(reps.join(anew, F.col("comp") == F.col("of")).drop("of")))
    rows = cut_table(_with_sub(large, edges))
    sizes = rows.groupBy("comp", "sub").agg(F.count("*").alias("size")).groupBy(F.col("comp").alias("c")).agg(F.max(F.struct("size", "sub"))["sub"].alias("main"), F.count("*").alias("subs"))
    rows = cut_table(rows.join(cut_table(sizes.where("subs > 1")), F.col("comp") == F.col("c")).drop("c", "subs"))
    main, rest = rows.where("sub = main"), rows.where("sub <> main")
    if rest.isEmpty():
        return edges
    of_main = _blocks(main, "comp", bucket).select(F.col("of").alias("m"), F.col("blocks").alias("mains"))
    of_rest = _blocks(rest, "comp", bucket).select(F.col("of").alias("r"), F.col("blocks").alias("rests"))
    grid = cut_table(of_main.join(of_rest, F.col("m") == F.col("r")).select(F.col("m").alias("of"), "mains", "rests"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    main = main.join(grid, F.col("comp") == F.col("of")).withColumn("x", F.pmod(F.xxhash64("node"), "mains")).withColumn("y", every("rests"))
    rest = rest.join(grid, F.col("comp") == F.col("of")).withColumn("mine", F.pmod(F.xxhash64("node"), "rests"))
    across = rest.withColumn("x", every("mains")).withColumn("y", F.col("mine"))
    among = rest.withColumn("other", every("rests")).withColumn("x", -1 - F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
    as_rows = lambda df, side: df.select(F.xxhash64("comp", "x", "y").alias("key"), F.lit(side).alias("side"), "node", "sub", "shingles")
    return edges.unionByName(_compared(as_rows(across, 0).unionByName(as_rows(among, 0)).unionByName(as_rows(main, 1))))


def candidates(distinct: DataFrame, prints: DataFrame) -> DataFrame:
    """(node, root), roots included, of the nodes whose fingerprints (node, fp) are linked within RADIUS, bit-sliced as linked() does, or
    that share one of their array `keys` of band keys, directly or through others."""
    near = linked(prints.select(F.col("node").alias("doc_id"), "fp")).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    banded = distinct.select("node", F.explode("keys").alias("key"))
    stars = cut_table(banded.groupBy(F.col("key").alias("of")).agg(F.min("node").alias("least"), F.count("*").alias("many")).where("many > 1").drop("many"))
    found = components(near.unionByName(banded.join(stars.hint("merge"), F.col("key") == F.col("of")).select(F.col("node").alias("a"), F.col("least").alias("b"))))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _grouped(numbered: DataFrame, bucket: int) -> DataFrame:
    """(_row, doc_id, n, root) of every row of numbered, root being one for each group of similar documents."""
    spark = numbered.sparkSession
    small_batches(spark)
    texts = numbered.select("_row", "doc_id", "text")
    with scope(spark) as keep:
        rows = cut_table(texts.mapInArrow(_sketched, "_row long, doc_id long, node long, n long, keys array<long>, fp long"))
        share = hot_share(spark, rows.count())
        distinct = cut_table(rows.groupBy("node").agg(F.min(F.struct("_row", "n", "keys")).alias("s"), (F.count("*") > share).alias("hot")).select("node", "s.*", "hot"))
        # equal sets may have several prints, as these count repeated shingles: each of them links
        found = candidates(distinct, cut_table(rows.select("node", "fp").distinct())).select(F.col("node").alias("_node"), "root")
        # what grows with the documents is never broadcast, not even where it is small: the plan is that of large inputs
        members = cut_table(distinct.join(found.hint("merge"), F.col("node") == F.col("_node")).select(F.col("root").alias("comp"), "node", "n", F.col("_row").alias("_of")))
        members = members.join(_blocks(members, "comp", bucket).hint("merge"), F.col("comp") == F.col("of")).drop("of")
        met = texts.join(members.hint("merge"), F.col("_row") == F.col("_of")).select("comp", "node", "n", "blocks", "text")
        sets = cut_table(met.mapInArrow(_sets, "comp long, node long, n long, blocks long, shingles binary"))
        ids = components(verified_links(sets, bucket)).withColumnRenamed("node", "of")
        ids = cut_table(distinct.select(F.col("node").alias("n1"), "hot").join(ids, F.col("n1") == F.col("of")).select("of", "root", "hot"))
        return keep(cut_table(joined(rows, "node", ids, "of").select("_row", "doc_id", "n", F.coalesce("root", "node").alias("root"))))


def _numbered(docs: DataFrame, *more: str) -> DataFrame:
    """(_row, doc_id, text, more) of docs with a number for each row, written so that the numbers stay."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return cut_table(rows)


def similar_components(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, component_id) of every row of docs, where documents are linked whose sets of
    WIDE_SHINGLE-word shingles have a Jaccard similarity of SIMILAR or more.

    Candidates have fingerprints within RADIUS, as in near_duplicates(), or share all BAND_ROWS min-hashes of one of BANDS bands,
    which pairs at a similarity of s miss with a chance of (1 - s ** BAND_ROWS) ** BANDS: 0.00005 at 0.8, less above. Every link is then verified
    on the shingle sets. No bucket is left out or cut: documents of a band key are joined to its least
    node, and the groups so joined are compared as verified_links() says."""
    rows = _grouped(_numbered(docs), bucket)
    share = hot_share(docs.sparkSession, rows.count())
    least = cut_table(rows.groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("component_id"), (F.count("*") > share).alias("hot")))
    return joined(rows, "root", least, "of").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of similar ones, all columns: that with the smallest doc_id, and of
    equal ids the first row; rows without doc_id only where no other of their group has one. Of texts without
    words, which are one group, none stays if another row of its doc_id does."""
    one, two = fresh(docs, "_one"), fresh(docs, "_two")
    keyed = docs.withColumns(dict(zip((one, two), row_keys(docs))))
    with scope(docs.sparkSession) as keep:
        numbered = _numbered(keyed, one, two)
        rows = _grouped(numbered, BUCKET)
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row", "n")
        first = cut_table(rows.groupBy("root").agg(F.min(order).alias("s")).select("s.*"))
        worded, bare = first.where("n > 0"), first.where("n = 0")
        bare = bare.join(worded.select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_anti")
        kept = worded.unionByName(bare).select(F.col("_row").alias("_kept"))
        # the rows that stay are found again by what they hold: of rows that are the same in all columns one stays
        same = numbered.groupBy(F.col(one).alias("_a"), F.col(two).alias("_b")).agg(F.count("*").alias("rows")).where("rows > 1")
        kept = numbered.join(kept.hint("merge"), F.col("_row") == F.col("_kept")).select(one, two)
        kept = kept.join(cut_table(same), (F.col(one) == F.col("_a")) & (F.col(two) == F.col("_b")), "left")
        kept = keep(cut_table(kept.select(one, two, F.lit(1).cast("long").alias("n"), F.coalesce("rows", F.lit(1)).alias("rows"))))
    return taken(keyed, (one, two), kept)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
