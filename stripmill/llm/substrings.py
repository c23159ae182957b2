"""Removal of repeated substrings: suffixes sorted bucket by bucket, long ties settled by ranks of a cover sample.

A string of LENGTH bytes is removed wherever it starts if it also starts anywhere else. Suffixes
matter only to that depth, and only those that may repeat: every string of LENGTH bytes contains
an anchor, the ANCHOR-gram with the smallest hash in it, and equal strings have it at the same
place. So the suffix buckets are the anchors that occur at least twice, and a bucket's suffixes are the
LENGTH-byte strings around its anchor, all of which lie in the anchor's context.

Equal contexts stand for each other: a context that occurs twice is repeated from end to end. The
distinct contexts of one bucket at a time (a batch of small ones together) are sorted like this. The
columns of the contexts, aligned at the anchor, are covered by cells of CELL bytes. As the
alignment of two suffixes in a bucket is known, every CELL-th column is a sufficient difference
cover. The cells' ranks are found first, by sorting them as bytes, and from them the ranks of the runs of
whole cells inside a suffix; then suffixes are compared by what is left, CELL bytes in the first
and last cell, with ties settled by the rank. Memory is bounded by the batch.

As a suffix has at least HALF bytes on one side of its anchor, buckets are dealt by the anchor with HALF
bytes to its left, for suffixes that have them, and with HALF to its right, for the others; contexts
that no other shares these with drop out. The suffixes of buckets with more than BUCKET contexts
are not sorted in one task but aggregated by two 64-bit hashes over the cluster. Equality of
anchors and contexts is by 64-bit hashes that must both agree.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; a repeated row, or an
equal text, counts as another place; a document without doc_id keeps its row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.llm.common import cut_table, mix, release, scope, small_batches

LENGTH = 200
#: Bytes of an anchor, a power of two; and of a cell, a divisor of LENGTH.
ANCHOR, CELL = 64, 40
#: Bytes of a string that may stand before its anchor; suffixes that have the same anchor.
REACH = LENGTH - ANCHOR
STARTS = REACH + 1
CELLS = -(-STARTS // CELL) + LENGTH // CELL
#: Bytes that a suffix has on one side of its anchor at least.
HALF = REACH // 2
#: Distinct contexts in a bucket above which its suffixes are aggregated by hash.
BUCKET = 1 << 14
#: Contexts sorted together, about.
BATCH = 1 << 14
#: Bytes of texts whose anchors are looked for together, about.
TOGETHER = 1 << 16


def gram_ranks(data: np.ndarray) -> np.ndarray:
    """32-bit hashes of all ANCHOR-grams, never zero, by which anchors are chosen."""
    h, factor, width = data.astype(np.uint32), 0x9E3779B1, 1
    with np.errstate(over="ignore"):
        while width < ANCHOR:
            h = h[:-width] * np.uint32(factor) + h[width:]
            factor, width = factor * factor % (1 << 32), 2 * width
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h ^= h >> np.uint32(shift)
            h *= np.uint32(by)
    return h | np.uint32(1)


def gram_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ANCHOR-grams at some places."""
    h = np.zeros(len(at), np.uint64)
    for word in np.lib.stride_tricks.sliding_window_view(data, ANCHOR)[at].view(np.uint64).T:
        h = mix(h ^ word) + np.uint64(ANCHOR)
    return h


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op, a minimum or maximum, over every window of the given width."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:n], x[width - have : width - have + n])


def anchors(data: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Places in texts that stand end to end whose rank is the smallest in some string of LENGTH bytes of a text; all
    of them, if equal. Every text has LENGTH bytes at least."""
    ranks = gram_ranks(data)
    least = _sliding(ranks, STARTS, np.minimum)
    end = 0
    for n in lengths:
        end += n
        least[end - LENGTH + 1 : end] = 0  # strings that go on in the next text
    around = np.zeros(STARTS - 1, np.uint32)
    return np.flatnonzero(_sliding(np.concatenate([around, least, around]), STARTS, np.maximum) == ranks)


def _key(doc: int | None, data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, 0 if doc is None else doc * 2 + 1 & (1 << 64) - 1)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


_ANCHORS_ROW = "key long, h array<long>, context array<long>, place array<int>"


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each text of LENGTH bytes or more; short texts are worked on together."""
    for batch in batches:
        rows, size = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (text.as_py() or "").encode()
            if len(data) >= LENGTH:
                rows.append((_key(doc, data), data))
                size += len(data)
            if size >= TOGETHER:
                yield _anchors_of(rows)
                rows, size = [], 0
        if rows:
            yield _anchors_of(rows)


def _anchors_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    data = np.frombuffer(b"".join(text for _, text in rows), np.uint8)
    lengths = [len(text) for _, text in rows]
    at = anchors(data, lengths)
    ends = np.cumsum(lengths)
    cuts = np.r_[0, np.searchsorted(at, ends)]
    place = at - np.repeat(ends - lengths, np.diff(cuts))
    contexts, hashed = [], xxhash.xxh64_intdigest
    for (_, text), first, last in zip(rows, cuts.tolist(), cuts[1:].tolist()):
        n = len(text)
        for p in place[first:last].tolist():
            # the ends of the text, if they are near, belong to the context
            contexts.append(hashed(text[max(0, p - REACH) : p + LENGTH], min(p, REACH) * (LENGTH + 1) + min(n - p, LENGTH)))
    offsets = pa.array(cuts, pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (_signed(gram_hashes(data, at)), _signed(contexts), pa.array(place, pa.int32()))]
    return pa.RecordBatch.from_arrays([_signed([key for key, _ in rows]), *lists], ["key", "h", "context", "place"])


_CONTEXT_ROW = "h long, context long, before int, bytes binary"


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the contexts that each text is to show."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for packed, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            data = unpack.decompress(packed.as_py())
            rows = [(w["h"], w["context"], min(w["place"], REACH), data[max(0, w["place"] - REACH) : w["place"] + LENGTH]) for w in wanted]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h", "context", "before", "bytes"])


def _ranks(rows: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of bytes."""
    return np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_inverse=True)[1]


def repeated(bucket: np.ndarray, side: np.ndarray, before: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """For distinct contexts of several buckets: which of their STARTS suffixes, of those on the
    bucket's side, also start in another context of the bucket."""
    n = len(contexts)
    length = np.fromiter(map(len, contexts), np.int64, n)
    text = np.zeros((n, CELLS * CELL), np.uint8)
    for k, (b, c) in enumerate(zip(before.tolist(), contexts)):
        text[k, REACH - b : REACH - b + len(c)] = np.frombuffer(c, np.uint8)
    # suffixes that lie in the document, and have HALF bytes to the left of the anchor or have not
    first = np.maximum(REACH - before, np.where(side == 0, 0, REACH - HALF + 1))
    last = np.minimum(REACH - before + length - LENGTH, np.where(side == 0, REACH - HALF, STARTS))
    out = np.zeros((n, STARTS), bool)
    group = np.unique(bucket, return_inverse=True)[1].astype(np.int64)
    cell = np.stack([_ranks(text[:, k * CELL : (k + 1) * CELL]) for k in range(CELLS)], axis=1)
    for k in range(-(-STARTS // CELL)):
        # rank of the whole cells between the first and the last of suffixes that start in cell k
        rank = group
        for j in range(k + 1, k + LENGTH // CELL):
            rank = np.unique(rank * n + cell[:, j], return_inverse=True)[1].astype(np.int64)
        tied = np.bincount(rank)[rank] > 1
        ends = np.concatenate([text[:, k * CELL : (k + 1) * CELL], text[:, (k + LENGTH // CELL) * CELL : (k + LENGTH // CELL + 1) * CELL]], axis=1)
        for start in range(k * CELL, min(STARTS, (k + 1) * CELL)):
            rows = np.flatnonzero(tied & (first <= start) & (start <= last))
            if len(rows) > 1:
                o = start - k * CELL
                left = np.empty((len(rows), CELL + 8), np.uint8)
                left[:, :CELL] = ends[rows, o : o + CELL]
                left[:, CELL:] = rank[rows].astype(">i8")[:, None].view(np.uint8)
                same = _ranks(left)
                out[rows, start] = np.bincount(same)[same] > 1
    return out


_SPAN_ROW = "h long, context long, low array<int>, high array<int>"


def _spans(marked: np.ndarray) -> tuple[list[int], list[int]]:
    """Covered stretches, as places from the anchor, by the suffixes that are marked."""
    at = np.flatnonzero(marked)
    new = np.r_[True, np.diff(at) > 1] if len(at) else np.zeros(0, bool)
    return (at[new] - REACH).tolist(), (at[np.r_[new[1:], True]] - REACH + LENGTH).tolist() if len(at) else []


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over contexts in order of their bucket."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        bucket, side, h, context, before, data = zip(*rows)
        marked = repeated(np.array(bucket, np.int64), np.array(side, np.int64), np.array(before, np.int64), list(data))
        return _spanned([(h[k], context[k], marked[k]) for k in np.flatnonzero(marked.any(axis=1)).tolist()])

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[:4] == rows[-1][:4]:
                continue  # shown by rows of equal key
            if len(rows) >= BATCH and row[0] != rows[-1][0]:
                yield settle(rows)
                rows = []
            rows.append(row)
    if rows:
        yield settle(rows)


def _spanned(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    rows = [(h, context, *_spans(marked)) for h, context, marked in found]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["h", "context", "low", "high"])


_SIDE_ROW = "bucket long, side int, h long, context long, before int, bytes binary"


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts under the anchor with HALF bytes to its left (side 0) and to its right (side 1)."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        rows = []
        for h, context, before, data in zip(*(c.to_pylist() for c in batch.columns)):
            parts = [data[before - HALF : before + ANCHOR] if before >= HALF else b"", data[before : before + ANCHOR + HALF]]
            rows += [(xxhash.xxh64_intdigest(x, side) - (1 << 63), side, h, context, before, data) for side, x in enumerate(parts) if len(x) == ANCHOR + HALF]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["bucket", "side", "h", "context", "before", "bytes"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every suffix of each context that has HALF bytes on its side of the anchor."""
    for batch in batches:
        for side, h, context, before, data in zip(*(c.to_pylist() for c in batch.columns)):
            first = REACH - before
            starts = [s for s in range(first, min(STARTS, first + len(data) - LENGTH + 1)) if (REACH - s >= HALF) == (side == 0)]
            both = [xxhash.xxh3_128_intdigest(data[s - first : s - first + LENGTH]) for s in starts]
            n = len(both)
            if n:
                yield pa.RecordBatch.from_arrays([_signed([x >> 64 for x in both]), _signed([x & (1 << 64) - 1 for x in both]), pa.array([h] * n, pa.int64()), pa.array([context] * n, pa.int64()), pa.array(starts, pa.int32())], ["w", "x", "h", "context", "start"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for h, context, starts in zip(*(c.to_pylist() for c in batch.columns)):
            marked = np.zeros(STARTS, bool)
            marked[starts] = True
            found.append((h, context, marked))
        yield _spanned(found)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for doc, packed, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data, kept, at, removed, n = unpack.decompress(packed.as_py()), hashlib.sha256(), 0, 0, 0
            end = -1
            for low, high in sorted((s["low"], min(s["high"], len(data))) for s in spans or ()):
                if low > end:
                    n += 1
                    kept.update(data[at:low])
                    removed += high - low
                    at = end = high
                elif high > end:
                    removed += high - end
                    at = end = high
            kept.update(data[at:])
            out.append((doc, len(data), removed, n, kept.hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [(x.as_py() or "").encode() for x in batch.column(1)]
        keys = [_key(doc, t) for doc, t in zip(batch.column(0).to_pylist(), texts)]
        yield pa.RecordBatch.from_arrays([_signed(keys), batch.column(0), pa.array([pack.compress(t) for t in texts], pa.binary())], ["key", "doc_id", "packed"])


def deduplicated(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs."""
    small_batches(docs.sparkSession)
    with scope(docs.sparkSession) as keep:
        return _deduplicated(docs, bucket, keep)


def _deduplicated(docs: DataFrame, bucket: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    anchored = cut_table(texts.mapInArrow(_anchored, _ANCHORS_ROW))  # read twice
    found = anchored.select("key", F.explode(F.arrays_zip("h", "context", "place")).alias("x")).select("x.h", "x.context", "key", "x.place")
    shared = cut_table(anchored.select(F.explode("h").alias("h")).groupBy(F.col("h").alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("of"))
    places = cut_table(found.join(shared, found["h"] == shared["of"]).select("h", "context", "key", "place"))
    release(anchored, shared)
    distinct = cut_table(places.groupBy("h", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("at")))
    mixed = cut_table(distinct.groupBy(F.col("h").alias("of")).agg(F.count("*").alias("n_contexts")).where("n_contexts > 1"))
    shown = distinct.join(mixed, distinct["h"] == mixed["of"])
    wanted = shown.groupBy(F.col("at.key").alias("of")).agg(F.collect_list(F.struct("h", "context", F.col("at.place").alias("place"))).alias("wanted"))
    packed = texts.mapInArrow(_packed, "key long, doc_id long, packed binary")
    # rows with equal keys have equal texts: either shows the context, and both may
    contexts = packed.join(cut_table(wanted), F.col("key") == F.col("of")).select("packed", "wanted").mapInArrow(_fetched, _CONTEXT_ROW)
    shows = cut_table(contexts)
    sides = shows.mapInArrow(_sides, _SIDE_ROW)
    several = F.min("context") != F.max("context")
    met = cut_table(sides.groupBy(F.col("bucket").alias("of")).agg(several.alias("several"), F.count("*").alias("n")).where("several").drop("several"))
    dealt = cut_table(sides.join(met, F.col("bucket") == F.col("of")).drop("of"))
    release(shows, met)
    rare = dealt.where(F.col("n") <= bucket).select("bucket", "side", "h", "context", "before", "bytes")
    stretches = rare.repartition("bucket").sortWithinPartitions("bucket", "side", "h", "context").mapInArrow(_sorted, _SPAN_ROW)
    often = dealt.where(F.col("n") > bucket).select("side", "h", "context", "before", "bytes").mapInArrow(_suffixes, "w long, x long, h long, context long, start int")
    # a string shows up once for each of its anchors: only equal anchors at equal places compare
    suffix = ["w", "x", "h", "start"]
    twice = cut_table(often.groupBy(*[F.col(c).alias(f"{c}2") for c in suffix]).agg(several.alias("several")).where("several").drop("several"))
    same = (F.col("w") == F.col("w2")) & (F.col("x") == F.col("x2")) & (F.col("h") == F.col("h2")) & (F.col("start") == F.col("start2"))
    starts = often.join(twice, same).groupBy("h", "context").agg(F.collect_set("start").alias("starts"))
    stretches = stretches.unionByName(starts.mapInArrow(_gathered, _SPAN_ROW))
    stretches = stretches.select("h", "context", F.explode(F.arrays_zip("low", "high")).alias("s")).select("h", "context", "s.low", "s.high")
    # what is repeated as a whole: REACH and LENGTH are cut to the document's ends below
    whole = distinct.where("n > 1").select("h", "context", F.lit(-REACH).alias("low"), F.lit(LENGTH).alias("high"))
    spans = cut_table(stretches.unionByName(whole).groupBy(F.col("h").alias("h2"), F.col("context").alias("c2")).agg(F.collect_set(F.struct("low", "high")).alias("spans")))
    met = places.join(spans, (F.col("h") == F.col("h2")) & (F.col("context") == F.col("c2"))).select("key", "place", F.explode("spans").alias("s"))
    of_doc = met.groupBy(F.col("key").alias("of")).agg(F.collect_set(F.struct(F.greatest(F.lit(0), F.col("place") + F.col("s.low")).alias("low"), (F.col("place") + F.col("s.high")).alias("high"))).alias("spans"))
    return packed.join(keep(cut_table(of_doc)), F.col("key") == F.col("of"), "left").select("doc_id", "packed", "spans").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
