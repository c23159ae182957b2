"""Document fingerprints that tell two versions' differing paragraphs: invertible Bloom lookup sketches.

A text is cut into paragraphs at line ends, and long lines further after words whose last bytes
hash to zero, so that an edit touches short pieces only and leaves the other cuts in place. Each
paragraph's 64-bit digest is added to three cells of a sketch, which hold a count, the sum of
digests and the sum of check hashes. Sketches of two versions subtract cell by cell; what the
versions share cancels out, and peeling cells that hold one digest recovers the differing digests.
If some cells are left the sketches were too small, and the pair is tried again with larger ones.

The fingerprint of a text is its sketch of BASE_CELLS cells as text. Likeness is the Jaccard
similarity of the two multisets of paragraphs, from the recovered difference.

Defined cases: a null text counts as empty; two texts without paragraphs are alike (1.0); rows with
equal doc_id follow each other in order of their packed text; null doc_ids come first; the document
after the last is the first, so a lone document follows itself; an empty table gives an empty
result; other columns are ignored.
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

from stripmill.llm.common import mix, partitions, small_batches

#: Cells of the sketch that serves as fingerprint; three tables of equal size.
BASE_CELLS = 12
#: Growth of the sketches from one attempt to the next.
GROWTH = 16
#: Words in a piece of a long line, on average.
PIECE_WORDS = 8
#: Sort buckets for each shuffle partition, so that partitions get about equally many.
BUCKETS = 8
#: Documents, and bytes of text, that are worked on together.
GROUP_ROWS, GROUP_BYTES = 128, 4 << 20
LEAST = -(1 << 63)


def paragraphs(data: bytes) -> list[bytes]:
    """Lines of a text, long ones cut after words whose last bytes hash to zero; no empty ones."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((b == 32) | (b == 10))
    if not len(at):
        return [data] if data else []
    last = np.concatenate([np.zeros(3, np.uint32), b.astype(np.uint32)])
    word = last[at] * np.uint32(7) + last[at + 1] * np.uint32(31) + last[at + 2] * np.uint32(131)
    end = at[(b[at] == 10) | ((word * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(PIECE_WORDS) == 0].tolist()
    return [x for i, j in zip([0, *(e + 1 for e in end)], [*end, len(data)]) if (x := data[i:j])]


def digests(data: bytes) -> np.ndarray:
    """Digests of the paragraphs as a set: a paragraph's repetitions get digests of their own."""
    found = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, paragraphs(data)), np.uint64))
    if len(found) > 1 and (found[1:] == found[:-1]).any():
        start = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        nth = np.arange(len(found)) - np.repeat(start, np.diff(np.r_[start, len(found)]))
        with np.errstate(over="ignore"):
            found = np.where(nth > 0, mix(found + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), found)
    return found


def _cells(items: np.ndarray, base: np.ndarray, third: np.ndarray, attempt: int) -> list[np.ndarray]:
    """The three cells of each item, in a sketch that begins at base and has three tables of `third` cells."""
    out = []
    for k in range(3):
        with np.errstate(over="ignore"):
            h = mix(items + np.uint64((3 * attempt + k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        out.append(base + k * third + (h % third.astype(np.uint64)).astype(np.int64))
    return out


def sketches(items: np.ndarray, owner: np.ndarray, third: np.ndarray, attempt: int = 0) -> list[np.ndarray]:
    """Sketches of several item sets, one after the other: counts, sums of items, sums of checks.
    owner: each item's set; third: cells in each of a set's three tables."""
    base = np.cumsum(3 * third) - 3 * third
    sketch = [np.zeros(int(3 * third.sum()), np.int64), np.zeros(int(3 * third.sum()), np.uint64), np.zeros(int(3 * third.sum()), np.uint64)]
    _add(sketch, _cells(items, base[owner], third[owner], attempt), items, np.ones(len(items), np.int64))
    return sketch


def _add(sketch: list[np.ndarray], cells: list[np.ndarray], items: np.ndarray, times: np.ndarray) -> None:
    count, total, checks = sketch
    check = mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    unsigned = times.astype(np.uint64)
    for at in cells:
        np.add.at(count, at, times)
        np.add.at(total, at, items * unsigned)
        np.add.at(checks, at, check * unsigned)


def peel(sketch: list[np.ndarray], third: np.ndarray, attempt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recovers what subtracted sketches hold: owners and items recovered, and whether each
    sketch was emptied. The sketches are used up."""
    count, total, checks = sketch
    sets = np.repeat(np.arange(len(third)), 3 * third)
    base = np.cumsum(3 * third) - 3 * third
    owners, items = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    look = np.flatnonzero(abs(count) == 1)
    # a sketch may hold a digest twice only by a collision of hashes: the bound ends such rounds
    for _ in range(64 + len(count)):
        sign = count[look]
        item = total[look] * sign.astype(np.uint64)
        pure = (abs(sign) == 1) & (mix(item ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * sign.astype(np.uint64) == checks[look])
        if not pure.any():
            break
        owner, item, sign = sets[look[pure]], item[pure], sign[pure]
        order = np.lexsort((item, owner))
        owner, item, sign = owner[order], item[order], sign[order]
        one = np.r_[True, (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])]
        owner, item, sign = owner[one], item[one], sign[one]
        owners.append(owner)
        items.append(item)
        cells = _cells(item, base[owner], third[owner], attempt)
        _add(sketch, cells, item, -sign)
        look = np.unique(np.concatenate(cells))
    rest = np.add.reduceat((count != 0) | (total != 0), base) if len(third) else np.zeros(0)
    return np.concatenate(owners), np.concatenate(items), rest == 0


def differences(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of digests that only one of the two sets has, for each pair of sets."""
    out = np.zeros(len(a), np.int64)
    todo, attempt, size = np.arange(len(a)), 0, BASE_CELLS
    while len(todo):
        sizes = np.array([len(a[k]) + len(b[k]) for k in todo])
        # enough for all digests of both, with room to peel; beyond that each attempt doubles
        third = np.maximum(BASE_CELLS // 3, -(-np.minimum(size, (sizes * 3 // 2 + BASE_CELLS) << max(0, attempt - 3)) // 3))
        sketch = [np.subtract(x, y) for x, y in zip(*(sketches(np.concatenate([s[k] for k in todo]), np.repeat(np.arange(len(todo)), [len(s[k]) for k in todo]), third, attempt) for s in (a, b)))]
        owners, _, done = peel(sketch, third, attempt)
        out[todo[done]] = np.bincount(owners, minlength=len(todo))[done]
        todo, attempt, size = todo[~done], attempt + 1, size * GROWTH
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    both = np.array([len(x) + len(y) for x, y in zip(a, b)], np.float64)
    differ = differences(a, b)
    return np.where(both == 0, 1.0, (both - differ) / np.maximum(both + differ, 1))


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    """The sketches of BASE_CELLS cells as text: in hexadecimal a cell's count (mod 2^16), sum of
    digests and the upper half of its sum of checks."""
    third = np.full(len(sets), BASE_CELLS // 3)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    count, total, checks = sketches(np.concatenate([*sets, np.zeros(0, np.uint64)]), owner, third)
    packed = np.zeros((len(sets) * BASE_CELLS, 14), np.uint8)
    packed[:, :2] = (count & 0xFFFF).astype(">u2")[:, None].view(np.uint8)
    packed[:, 2:10] = total.astype(">u8")[:, None].view(np.uint8)
    packed[:, 10:] = (checks >> np.uint64(32)).astype(">u4")[:, None].view(np.uint8)
    rows = packed.reshape(len(sets), -1) if len(sets) else packed
    return [row.tobytes().hex() for row in rows]


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(bounds: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with their sort bucket and packed text. The first rows of a bucket go to the bucket
    before as well, and those of the first bucket to the last, as the rows to look ahead at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        edges = np.array(bounds, np.int64)
        for batch in batches:
            place = batch.column(0).to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(edges, place, side="right") - 1
            ahead = np.flatnonzero(edges[bucket] == place)
            packed = pa.array([pack.compress((x.as_py() or "").encode()) for x in batch.column(2)], pa.binary())
            own = pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(np.zeros(len(place), bool)), batch.column(0), batch.column(1), packed], ["bucket", "ahead", "place", "doc_id", "packed"])
            yield own
            if len(ahead):
                at = pa.array(ahead)
                yield pa.RecordBatch.from_arrays([pa.array((bucket[ahead] - 1) % len(edges), pa.int64()), pa.array(np.ones(len(ahead), bool)), batch.column(0).take(at), batch.column(1).take(at), packed.take(at)], ["bucket", "ahead", "place", "doc_id", "packed"])

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in order of (bucket, ahead, place): each with its follower, a bounded group at a time."""

    def group(rows: list[tuple[int | None, str]], follower: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        changed = [edited(t, f).encode() for t, f in zip(texts, [*texts[1:], follower])]
        sets = [digests(t.encode()) for t in [*texts, follower]]
        new = [digests(t) for t in changed]
        columns = [[d for d, _ in rows], [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in changed], fingerprints(sets[:-1]), fingerprints(new), likeness(sets[:-1], new), likeness(sets[:-1], sets[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)

    unpack = zstandard.ZstdDecompressor()
    bucket, rows, held, closed = None, [], 0, False
    for batch in batches:
        for b, ahead, doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if b == bucket and closed:
                continue
            text = unpack.decompress(packed.as_py()).decode()
            if b != bucket:
                bucket, rows, held, closed = b, [], 0, False
            if ahead or len(rows) >= GROUP_ROWS or held > GROUP_BYTES:
                yield group(rows, text)
                rows, held, closed = [], 0, ahead
            if not ahead:
                rows.append((doc, text))
                held += len(text)


def compared(docs: DataFrame) -> DataFrame:
    """For every row of docs: length, digest of its edited text, both fingerprints and likenesses."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = BUCKETS * partitions(spark)
    least, quantiles = rows.agg(F.min("place"), F.percentile_approx("place", [k / n for k in range(1, n)], 20 * n)).first()
    if least is None:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    dealt = rows.mapInArrow(_dealt(sorted({least, *quantiles})), "bucket long, ahead boolean, place long, doc_id long, packed binary")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "ahead", "place", "packed")
    return ordered.select("bucket", "ahead", "doc_id", "packed").mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
