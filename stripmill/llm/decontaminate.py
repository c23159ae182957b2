"""Benchmark decontamination with the q-gram lemma.

Texts and benchmark items are compared as lower-cased words with one space between. An item of m
characters that occurs with at most e edits shares at least m - q + 1 - q e of its q-grams with the
document, on diagonals (place in the document less place in the item) that differ by at most e.
So shared q-grams are counted in overlapping bands of diagonals, each twice e + 1 wide and half over the
next; bands that reach the bound are verified by banded alignment, which finds the fewest edits
that turn the item into a part of the document.

The items' index goes to the workers by broadcast in slices of at most INDEX_CHARS characters;
with more items than fit, the documents are scanned once a slice.

Items of fewer than LEAST_WORDS words are found where their words stand one after another, without edits.

Defined cases: null or empty texts contain nothing; items that are null or have no word are not
looked for; equal items are each reported; of several occurrences in a document the one with fewest edits counts, then the first;
rows with equal doc_id are reported each; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.llm.common import mix, small_batches

Q = 8
#: Edits allowed, by the characters of the item.
EDITS = 0.1
#: Items with fewer words are matched exactly.
LEAST_WORDS = 5
#: Characters of items that are indexed at once.
INDEX_CHARS = 2_000_000
#: Characters of a document that are worked on at once, besides an overlap.
WINDOW = 1 << 20
#: Shared q-grams that are listed at once, about.
MATCHES = 1 << 20
_WORD = re.compile(r"\w+")
_BITS = 22


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray) -> np.ndarray:
    """Hashes of the Q-grams; Q is a power of two, so that halves can be put together."""
    h, factor, width = points.astype(np.uint64), 0x9E3779B97F4A7C15, 1
    with np.errstate(over="ignore"):
        while width < Q:
            h = h[:-width] * np.uint64(factor) + h[width:] if len(h) > width else h[:0]
            factor, width = factor * factor % (1 << 64), 2 * width
    return mix(h)


class Index:
    """q-grams of benchmark items, with the places where they stand."""

    def __init__(self, items: list[tuple[int, str]]):
        """items: ids with normalised texts."""
        self.ids = [i for i, _ in items]
        self.points = [_points(t) for _, t in items]
        length = np.array([len(p) for p in self.points], np.int64)
        # where the lemma would ask for less than one q-gram, fewer edits are allowed
        self.edits = np.minimum((length * EDITS).astype(np.int64), np.maximum(0, (length - Q) // Q))
        self.bound = length - Q + 1 - Q * self.edits
        self.short: dict[tuple[str, ...], list[int]] = {}
        for k, (_, t) in enumerate(items):
            if t.count(" ") + 1 < LEAST_WORDS:
                self.short.setdefault(tuple(t.split(" ")), []).append(k)
        within = {k for found in self.short.values() for k in found}
        grams = [_grams(p[:0] if k in within else p) for k, p in enumerate(self.points)]
        each = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(each, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.grams, self.first = np.unique(each[order], return_index=True)
        self.first = np.r_[self.first, len(each)]
        self.there = np.zeros(1 << _BITS, bool)
        self.there[self.grams >> np.uint64(64 - _BITS)] = True
        self.longest = int(length.max(initial=0))

    def found(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the items in a text, places in the normalised text."""
        text = normal(text)
        points = _points(text)
        best = self._verbatim(text)
        for at in range(0, max(1, len(points)), WINDOW):
            for item, start, end, edits in self._within(points[at : at + WINDOW + 2 * self.longest]):
                found = (edits, at + start, at + end)
                best[item] = min(best.get(item, found), found)
        return [(item, start, end, edits) for item, (edits, start, end) in sorted(best.items())]

    def _verbatim(self, text: str) -> dict[int, tuple[int, int, int]]:
        """(edits, start, end) of the first place of each short item."""
        best: dict[int, tuple[int, int, int]] = {}
        words = text.split(" ") if text and self.short else []
        for n in sorted({len(w) for w in self.short}) if words else []:
            at = 0
            for k, run in enumerate(zip(*(words[j:] for j in range(n)))):
                for item in self.short.get(run, ()):
                    best.setdefault(item, (0, at, at + len(self.points[item])))
                at += len(words[k]) + 1
        return best

    def _needless(self, points: np.ndarray) -> np.ndarray:
        """Places in the midst of a long stretch that repeats a period of up to Q characters: whatever aligns there aligns
        with the same edits nearer to the stretch's beginning."""
        out, edge = np.zeros(len(points), bool), 2 * self.longest + Q
        for period in range(1, Q + 1):
            differs = np.flatnonzero(points[period:] != points[:-period])
            begins, ends = np.r_[0, differs + 1 + period], np.r_[differs + period, len(points)]
            for low, high in zip(*(x[ends - begins > 2 * edge].tolist() for x in (begins, ends))):
                out[low + edge : high - edge] = True
        return out

    def _matches(self, grams: np.ndarray, needless: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place, diagonal) of all shared q-grams, at most about MATCHES at a time."""
        at = np.flatnonzero(self.there[grams >> np.uint64(64 - _BITS)])
        if needless is not None:
            at = at[~needless[at]]
        if not len(at) or not len(self.grams):
            return
        number = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        real = self.grams[number] == grams[at]
        at, number = at[real], number[real]
        times = self.first[number + 1] - self.first[number]
        upto = np.cumsum(times)
        cuts = np.r_[0, np.searchsorted(upto, np.arange(MATCHES, upto[-1] if len(upto) else 0, MATCHES), side="right"), len(at)]
        for low, high in zip(cuts.tolist(), cuts[1:].tolist()):
            if low < high:
                n = times[low:high]
                which = np.repeat(self.first[number[low:high]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                place = self.place[which].astype(np.int64)
                yield self.item[which].astype(np.int64), place, np.repeat(at[low:high], n) - place

    def _bands(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, band of diagonals, different q-grams of the item in it) where there are enough for the bound.

        q-grams that stand in a place and in the item many times match by the product, so matches are gone through in
        parts, three times: for the items with enough, for their bands with enough, and for the q-grams in these."""
        grams = _grams(points)
        parts = self._matches(grams)
        first = next(parts, None)
        if first is None:
            return []
        second = next(parts, None)
        # a single part, as usual, is kept; several are made anew each time
        needless = None if second is None else self._needless(points)
        again = (lambda: iter([first])) if second is None else (lambda: self._matches(grams, needless))
        count = np.zeros(len(self.ids), np.int64)
        for item, _, _ in again():
            count += np.bincount(item, minlength=len(count))
        enough = count >= self.bound
        if not enough.any():
            return []
        # each q-gram stands in two bands
        span = len(points) + self.longest + 4

        def coded() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for item, place, diagonal in again():
                kept = enough[item]
                item, place, diagonal = item[kept], place[kept], diagonal[kept]
                code = item * span + diagonal // (self.edits[item] + 1) + self.longest + 2
                yield np.r_[code, code - 1], np.r_[place, place]

        codes, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for code, _ in coded():
            code, size = np.unique(code, return_counts=True)
            codes, back = np.unique(np.r_[codes, code], return_inverse=True)
            sizes = np.bincount(back, np.r_[sizes, size], len(codes)).astype(np.int64)
        likely = codes[sizes >= self.bound[codes // span]]
        if not len(likely):
            return []
        pairs = np.zeros(0, np.int64)
        for code, place in coded():
            nth = np.minimum(np.searchsorted(likely, code), len(likely) - 1)
            real = likely[nth] == code
            pairs = np.unique(np.r_[pairs, nth[real] * (self.longest + 1) + place[real]])
        different = np.bincount(pairs // (self.longest + 1), minlength=len(likely))
        return [(c // span, c % span - self.longest - 2, n) for c, n in zip(likely.tolist(), different.tolist()) if n >= self.bound[c // span]]

    def _within(self, points: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of each item's first place with fewest edits."""
        best: dict[int, int] = {}
        seen: set[tuple[int, bytes]] = set()
        for k, band, n in self._bands(points):
            # a band that comes later must have fewer edits, which asks for more q-grams
            budget = min(int(self.edits[k]), best.get(k, len(points)) - 1)
            if budget < 0 or n < len(self.points[k]) - Q + 1 - Q * budget:
                continue
            low, high = band * int(self.edits[k] + 1), (band + 2) * int(self.edits[k] + 1) - 1
            # the same stretch of text before gave all that this one can
            stretch = k, points[max(0, low - budget) : high + budget + len(self.points[k])].tobytes()
            if stretch in seen:
                continue
            seen.add(stretch)
            aligned = align(self.points[k], points, low, high, budget)
            if aligned:
                best[k] = aligned[2]
                yield k, *aligned


def _edits(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int]:
    """(fewest edits, diagonal where they end) of the item against parts of text, on the diagonals low to high.

    Row r holds, for each diagonal d, the edits that turn the first r characters of the item into
    a part of text that ends before r + d. Beyond the text nothing matches."""
    far = len(item) + len(text) + 1
    at = np.arange(low, high + 1)
    cost = np.where((at >= 0) & (at <= len(text)), 0, far)
    part = np.full(len(at) + len(item), -1, np.int64)
    begin, end = max(0, low), min(len(text), low + len(part))
    part[begin - low : end - low] = text[begin:end]
    rank = np.arange(len(at))
    for r, c in enumerate(item.tolist()):
        new = cost + (part[r : r + len(at)] != c)  # keep or replace, along the diagonal
        np.minimum(new[:-1], cost[1:] + 1, out=new[:-1])  # leave out a character of the item
        new -= rank  # put in characters of the text: from any diagonal before, one edit each
        np.minimum.accumulate(new, out=new)
        new += rank
        cost = new
        if not r & 15 and cost.min() > budget:
            break
    k = int(cost.argmin())
    return int(cost[k]), int(at[k])


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the part of text with fewest edits from the item, over alignments that
    stay on diagonals low - budget to high + budget; None if it takes more than the budget."""
    edits, diagonal = _edits(item, text, low - budget, high + budget, budget)
    if edits > budget:
        return None
    end = min(len(text), diagonal + len(item))
    # the start is the end of the same alignment read backwards, which begins where text[:end] ends
    back = text[max(0, end - len(item) - budget) : end][::-1]
    _, diagonal = _edits(item[::-1], back, -budget, budget, budget) if len(back) else (0, 0)
    return end - min(len(back), max(0, diagonal + len(item))), end, edits


def indexes(items: DataFrame) -> list:
    """The benchmark's indexes as broadcasts, each of a bounded slice of the items."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // INDEX_CHARS)
    out = []
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        kept = [(r.item_id, t) for r in part if (t := normal(r.text))]
        if kept:
            out.append(spark.sparkContext.broadcast(Index(kept)))
    return out


def _scan(index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, index.value.ids[k], *place) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for k, *place in index.value.found(text.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "start_char", "end_char", "edits"])

    return run


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, edits) of every document with an item in it."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, start_char long, end_char long, edits long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for index in indexes(items):
        out = out.unionByName(rows.mapInArrow(_scan(index), schema))
    return out


def _without(parts: list, text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not any(p.value.found(x.as_py()) for p in parts) for x in batch.column(text)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any item of the benchmark, all columns."""
    small_batches(docs.sparkSession)
    parts = indexes(items)
    return docs.mapInArrow(_without(parts, docs.columns.index("text")), docs.schema) if parts else docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
