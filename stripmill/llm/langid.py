"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language would be asked once per language; here they are bit-sliced: entry h
of the table holds a bit for every language, so that the AND of an n-gram's entries gives all
languages that contain it. A language contains an n-gram if, in the training sample, its rate there
is at least SHARE of the highest rate in any language. For each language the hits over all n-grams
of the text are counted, the false positives that its filter makes are taken off, and the highest
count decides.

Training takes rows whose crc32 of doc_id as text, modulo 4, is not 2 and whose lang is not null.
The classifier is fitted to a sample of about SAMPLE_DOCS of them for each language, chosen by a
hash of doc_id, and to the SAMPLE_GRAMS n-grams that are most frequent in it; nothing else is bounded. Prediction sees the text only.

Defined cases: a text that is null or has no letter gets `und` and score 0; texts may be of any length, and all of a
text counts; a text with letters but
no known n-gram gets the most frequent language with score 0; with no labelled rows every
text gets `und`; a null doc_id is neither learnt from nor held out; equal counts go to the language
that is more frequent, then first by name; repeated rows each get a result; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.llm.common import mix, small_batches

UNKNOWN = "und"
#: Code points in the n-grams.
LENGTHS = (2, 3, 4)
#: Labelled documents for each language that the filters are fitted to, about.
SAMPLE_DOCS = 1500
#: An n-gram belongs to the languages that use it at least this often, by the language that uses it most.
SHARE = 0.5
#: Occurrences in the sample below which an n-gram is left out.
LEAST_COUNT = 3
#: Share of a text's n-grams that the winning language must contain for the text to count as known.
#: At sf0.1 (3000 documents) the least share was 0.54 in a learnt language; with one language left out of the
#: training, its documents had medians of 0.37 to 0.55, and two texts in other scripts under 0.07.
LEAST_SHARE = 0.4
#: Table entries for each n-gram, and entries that an n-gram sets.
ROOM, HASHES = 8, 3
#: n-grams of the sample that the filters are made of at most, the most frequent.
SAMPLE_GRAMS = 1 << 21
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Fractions and Roman numerals are word characters, but no letters."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def grams(text: str) -> np.ndarray:
    """64-bit hashes of all n-grams of the lower-cased text between two spaces."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n in LENGTHS:
            if len(points) >= n:
                h = np.full(len(points) - n + 1, n, np.uint64)
                for k in range(n):
                    h = h * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
                out.append(h)
    return mix(np.concatenate(out))


def _positions(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(k) * high) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """The table of language bitmasks, and what is needed to decide."""

    def __init__(self, languages: list[str], hashes: np.ndarray, masks: np.ndarray):
        """languages: most frequent first; masks: for each n-gram hash a row of 64-bit words."""
        self.languages = languages
        size = 1 << max(6, (ROOM * len(hashes)).bit_length())
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.tables = []
        for word in range(-(-len(languages) // 64)):
            table = np.zeros(size, kind)
            for at in _positions(hashes, size):
                np.bitwise_or.at(table, at, masks[:, word].astype(kind))
            self.tables.append(table)
        self.false = np.array([(np.count_nonzero(self.tables[k // 64] & self.tables[0].dtype.type(1 << k % 64)) / size) ** HASHES for k in range(len(languages))])

    def counts(self, text: str) -> np.ndarray:
        """For each language the text's n-grams that it contains, less the false positives."""
        hashes = grams(text)
        at = _positions(hashes, len(self.tables[0]))
        found = []
        for table in self.tables:
            mask = table[at[0]]
            for p in at[1:]:
                mask = mask & table[p]
            found += [np.count_nonzero(mask & mask.dtype.type(1 << k)) for k in range(min(64, len(self.languages) - len(found)))]
        return np.maximum(0, (np.array(found) - len(hashes) * self.false) / (1 - self.false))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not has_letter(text):
            return UNKNOWN, 0.0
        counts = self.counts(text)
        best = int(counts.argmax())
        return self.languages[best], float(counts[best] / counts.sum()) if counts[best] else 0.0

    def known(self, text: str | None) -> bool:
        """Whether the text is in one of the languages: the winner contains LEAST_SHARE of its n-grams."""
        if not self.languages or not text or not has_letter(text):
            return False
        return bool(self.counts(text).max() >= LEAST_SHARE * len(grams(text)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of each sampled text with their numbers."""
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            hashes, counts = np.unique(grams(text.as_py()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), k, np.int32)), pa.array(hashes.view(np.int64)), pa.array(counts, pa.int64())], ["language", "gram", "n"])


def fit(docs: DataFrame) -> Filters:
    """Filters learnt from a bounded sample of the labelled rows of docs that aren't held out."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where((F.crc32("id") % 4 != 2) & F.col("lang").isNotNull())
    known = sorted(((n, lang) for lang, n in rows.groupBy("lang").agg(F.count("*")).collect()), key=lambda x: (-x[0], x[1]))
    languages = [lang for _, lang in known]
    if not languages:
        return Filters([], np.zeros(0, np.uint64), np.zeros((0, 1), np.uint64))
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    bar = F.create_map(*[F.lit(x) for n, lang in known for x in (lang, min(1.0, SAMPLE_DOCS / n))])
    chance = (F.xxhash64("id") % (1 << 30) + (1 << 30)) / float(1 << 31)
    sample = rows.where(F.col("text").isNotNull() & (chance < bar[F.col("lang")])).select(number[F.col("lang")].alias("language"), "text")
    each = sample.mapInArrow(_counted, "language int, gram long, n long").groupBy("gram", "language").agg(F.sum("n").alias("n"))
    each = each.groupBy("gram").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("by")).where(F.col("n") >= LEAST_COUNT)
    each = each.orderBy(F.col("n").desc(), "gram").limit(SAMPLE_GRAMS)
    table = each.select("gram", F.map_keys("by").alias("k"), F.map_values("by").alias("n")).toArrow()
    hashes = table.column(0).to_numpy().view(np.uint64)
    lengths = np.diff(np.r_[0, np.cumsum(np.fromiter(map(len, table.column(1)), np.int64, len(hashes)))])
    gram = np.repeat(np.arange(len(hashes)), lengths)
    language = table.column(1).combine_chunks().flatten().to_numpy()
    count = table.column(2).combine_chunks().flatten().to_numpy().astype(np.float64)
    rate = count / np.maximum(1, np.bincount(language, count, len(languages)))[language]
    most = np.zeros(len(hashes))
    np.maximum.at(most, gram, rate)
    masks = np.zeros((len(hashes), -(-len(languages) // 64)), np.uint64)
    kept = rate >= SHARE * most[gram]
    np.bitwise_or.at(masks, (gram[kept], language[kept] // 64), np.uint64(1) << (language[kept] % 64).astype(np.uint64))
    return Filters(languages, hashes, masks)


def _predicted(filters) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [filters.value.predict(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predicted(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs."""
    spark = docs.sparkSession
    filters = spark.sparkContext.broadcast(fit(docs))
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predicted(filters), "doc_id long, held_out boolean, lang_pred string, score double")


def _known(filters, text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([filters.value.known(x.as_py()) for x in batch.column(text)], pa.bool_()))

    return run


def known_documents(docs: DataFrame) -> DataFrame:
    """The documents in one of the learnt languages, all columns: not `und`, and of whose n-grams the language contains LEAST_SHARE or more."""
    spark = docs.sparkSession
    filters = spark.sparkContext.broadcast(fit(docs))
    small_batches(spark)
    return docs.mapInArrow(_known(filters, docs.columns.index("text")), docs.schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
