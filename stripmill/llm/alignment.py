"""Two tokenizers' tokens of the same texts, aligned by the bytes that they cover.

All texts of an Arrow batch stand one after the other in one space of bytes, in which every token of either tokenizer has an
end. The ends of both are counted once over that space; where both have one, a group of tokens that belong together is cut off.
Between two neighbouring ends, whosesoever, lies a stretch that exactly one token of each covers: these stretches are the links. Prefix
sums of the counts give the number of every token, group and link at any byte, and their differences
between the bytes at which a document begins and ends the document's own numbers.

How often two tokens are linked in all documents is summed by Spark from each document's distinct pairs, which are written
once. The counts come back to the documents by joins with slices of the pairs, each broadcast: a slice holds about PAIRS
of them, whatever the number of documents, and the number of slices is bounded by the product of the
vocabularies. So no document's pair is shuffled, and no pair, however frequent, meets in one task.

Both tokenizers leave a single space between two other characters to what follows it, so a text without other spaces is a
row of words that each begin with a space, and tokens of a word are kept for its next occurrence, within WORDS. Other
texts are encoded whole.

Defined cases: texts that are null or empty, or whose tokens of either side don't give back its bytes after a space, have
no tokens: zeros, and an empty digest; rows are independent, so ties, repeated rows and null ids
are no special case, but every repetition counts; strings of special tokens are plain text; an empty table gives an empty
result; columns that are asked for pass through, and the new ones take other names if theirs are taken.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripmill.llm.common import cut_table, fresh, scope, small_batches
from stripmill.llm.tokencount import byte_signs

VOCABULARIES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of tokens that are broadcast at once, about 64 bytes each.
PAIRS = 1 << 20
#: Characters of the words whose tokens are kept in a worker, and the longest of such words.
WORDS, LONGEST = 1 << 22, 64
NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for length[0] numbers; then the same from start[1], and so on."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class Side:
    """One tokenizer: ids of texts after a space, and the bytes of each id."""

    def __init__(self, pieces: list[bytes], encode):
        self.pieces, self.encode = pieces, encode
        self.length = np.array([len(p) for p in pieces], np.int64)

    def whole(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.pieces.__getitem__, ids)) == text


def byte_level(source: str) -> Side:
    """A tokenizer whose tokens are written with the signs of byte_signs()."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(source)
    library.encode_special_tokens = True
    of_sign = {sign: byte for byte, sign in enumerate(byte_signs())}
    tokens = [library.id_to_token(k) or "" for k in range(library.get_vocab_size())]
    pieces = [bytes(map(of_sign.__getitem__, t)) if all(c in of_sign for c in t) else t.encode() for t in tokens]
    return Side(pieces, lambda texts: [e.ids for e in library.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)])


def of_pieces(model: bytes) -> Side:
    """A tokenizer of pieces, which puts a space before a text by itself; <0xHH> stands for a byte."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [bytes([int(library.id_to_piece(k)[3:5], 16)]) if library.is_byte(k) else library.id_to_piece(k).replace("▁", " ").encode() for k in range(library.vocab_size())]
    return Side(pieces, lambda texts: library.encode(texts, num_threads=1))


class Aligner:
    def __init__(self, a: Side, b: Side):
        self.sides = a, b
        # ids as digits, padded with zero bytes, with room for a sign after them
        self.width = len(str(max(len(a.pieces), len(b.pieces)))) + 1
        self.digits = np.array([str(k) for k in range(max(len(a.pieces), len(b.pieces)))], f"S{self.width}").view(np.uint8).reshape(-1, self.width)
        self.n_digits = (self.digits > 0).sum(axis=1)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.held = 0
        self.good = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.start = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.many = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def _learn(self, units: list[str]) -> None:
        """Tokens of units, which get the next numbers."""
        good = np.ones(len(units), bool)
        for k, side in enumerate(self.sides):
            found = side.encode(units)
            good &= [side.whole(ids, f" {u}".encode()) for ids, u in zip(found, units)]
            many = np.array([len(x) for x in found], np.int64)
            self.start[k] = np.r_[self.start[k], len(self.ids[k]) + np.cumsum(many) - many]
            self.many[k] = np.r_[self.many[k], many]
            self.ids[k] = np.r_[self.ids[k], np.array([i for ids in found for i in ids], np.int64)]
        self.good = np.r_[self.good, good]

    def units(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units that the texts consist of, and how many there are of each text."""
        if self.held > WORDS:
            self.forget()
        out: list[int] = []
        counts = []
        new: list[str] = []
        known = len(self.good)
        for text in texts:
            if not text:
                counts.append(0)
                continue
            apart = text[0] != " " and text[-1] != " " and "  " not in text
            words = text.split(" ") if apart else [text]
            numbers = list(map(self.words.get, words))
            if None in numbers:
                for at, (word, n) in enumerate(zip(words, numbers)):
                    if n is None and (n := self.words.get(word)) is None:
                        n = known + len(new)
                        new.append(word)
                        self.held += len(word) + 16
                        if len(word) <= LONGEST:
                            self.words[word] = n
                    numbers[at] = n
            out += numbers
            counts.append(len(words))
        if new:
            self._learn(new)
        return np.array(out, np.int64), np.array(counts, np.int64)

    def aligned(self, texts: list[str | None]) -> dict[str, list | np.ndarray]:
        """Of each text NAMES, and the distinct pairs (code, n) of linked tokens with offsets by text; the code is b * size of A + a."""
        units, counts = self.units(texts)
        last = np.cumsum(counts)
        bad = np.r_[0, np.cumsum(~self.good[units])]
        # texts of which all units give back their bytes
        sound = (counts > 0) & (bad[last] == bad[last - counts])
        units = units[np.repeat(sound, counts)]
        of_text = np.repeat(np.arange(int(sound.sum())), counts[sound])
        ids, ends, text_ends, tokens = [], [], [], []
        for k, side in enumerate(self.sides):
            many = self.many[k][units]
            mine = self.ids[k][ragged(self.start[k][units], many)]
            end = np.cumsum(side.length[mine])
            n = np.bincount(of_text, weights=many, minlength=int(sound.sum())).astype(np.int64)
            ids.append(mine)
            ends.append(end)
            tokens.append(n)
            text_ends.append(end[np.cumsum(n) - 1])
        size, a_ids, b_ids = int(ends[0][-1]) if len(ends[0]) else 0, *ids
        a_end, b_end = (np.bincount(e, minlength=size + 1) for e in ends)
        cut = (a_end > 0) & (b_end > 0)
        a_upto, b_upto, cut_upto = np.cumsum(a_end), np.cumsum(b_end), np.cumsum(cut)
        stretch = np.flatnonzero((a_end > 0) | (b_end > 0))
        a_of, b_of = a_upto[stretch] - a_end[stretch], b_upto[stretch] - b_end[stretch]
        stop = text_ends[0]
        groups = np.diff(cut_upto[stop], prepend=0)
        links = np.diff(np.searchsorted(stretch, stop, side="right"), prepend=0)
        digests = self._digests(a_ids, b_ids, ends, cut, cut_upto, a_upto, b_upto, stop)
        codes, n, pairs = self._pairs(b_ids[b_of] * len(self.sides[0].pieces) + a_ids[a_of], links)
        out: dict[str, list | np.ndarray] = {}
        at = np.flatnonzero(sound)
        for name, values in zip([*NAMES[:4], "pairs"], [*tokens, groups, links, pairs]):
            out[name] = np.zeros(len(texts), np.int64)
            out[name][at] = values
        out["groups_sha256"] = [""] * len(texts)
        for k, d in zip(at.tolist(), digests):
            out["groups_sha256"][k] = d
        return out | {"code": codes, "n": n}

    def _digests(self, a_ids, b_ids, ends, cut, cut_upto, a_upto, b_upto, stop) -> list[str]:
        """Each text's groups in writing: those tokens of a group that A has, then those that B has."""
        where = np.r_[0, np.flatnonzero(cut)]
        in_group = [cut_upto[e - 1] for e in ends]
        total = len(a_ids) + len(b_ids)
        merged, sign = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        a_at = np.arange(len(a_ids)) + b_upto[where[in_group[0]]]
        b_at = np.arange(len(b_ids)) + a_upto[where[in_group[1] + 1]]
        merged[a_at], merged[b_at] = a_ids, b_ids
        sign[a_at[cut[ends[0]]]], sign[b_at[cut[ends[1]]]] = ord("|"), ord(";")
        signs = self.digits[merged]
        length = self.n_digits[merged]
        signs[np.arange(total), length] = sign
        flat = signs.reshape(-1)
        written = memoryview(np.ascontiguousarray(flat[flat > 0]))
        upto = np.r_[0, np.cumsum(length + 1)]
        text_end = upto[a_upto[stop] + b_upto[stop]].tolist()
        # without the sign after a text's last group
        return [hashlib.sha256(written[low : high - 1]).hexdigest() for low, high in zip([0, *text_end], text_end)]

    def _pairs(self, codes: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct codes of each text, how often each occurs, and how many each text has."""
        of_text = np.repeat(np.arange(len(links)), links)
        span = len(self.sides[0].pieces) * len(self.sides[1].pieces)
        key, n = np.unique(of_text * span + codes, return_counts=True)
        return key % span, n, np.bincount(key // span, minlength=len(links))


_ready: dict[tuple[int, int], Aligner] = {}


def aligner(a: str, b: bytes) -> Aligner:
    """The aligner, once for each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(a), hash(b)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Aligner(byte_level(a), of_pieces(b))
    return _ready[key]


def _aligning(sources, text: str, keep: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(*sources.value)
        for batch in batches:
            found = work.aligned(batch.column(batch.schema.get_field_index(text)).to_pylist())
            offsets = pa.array(np.r_[0, np.cumsum(found["pairs"])], pa.int32())
            pairs = pa.StructArray.from_arrays([pa.array(found["code"], pa.int64()), pa.array(found["n"], pa.int32())], ["code", "n"])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            own = [pa.array(found[n], pa.string() if n == NAMES[-1] else pa.int64()) for n in NAMES]
            yield pa.RecordBatch.from_arrays([*kept, *own, pa.ListArray.from_arrays(offsets, pairs)], names=[*keep, *names])

    return run


def links(docs: DataFrame, keep: list[str], text: str = "text", paths: tuple[str, str] | None = None) -> tuple[DataFrame, list[str], int]:
    """The columns `keep` of docs with, under the names returned, NAMES and an array of distinct links (code, n), where
    the code is the id in B times the number of ids in A, which is returned too, plus the id in A."""
    spark = docs.sparkSession
    small_batches(spark)
    a, b = paths or tuple(map(public_tokenizers.path, VOCABULARIES))
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        given = f.read(), g.read()
    sources = spark.sparkContext.broadcast(given)  # as large as the vocabularies' files
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    names = [fresh(rows, n) for n in [*NAMES, "links"]]
    own = fresh(rows, "text_")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(own))
    pair = T.ArrayType(T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.IntegerType())]))
    types = [T.LongType()] * 4 + [T.StringType(), pair]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != own], *[T.StructField(n, t) for n, t in zip(names, types)]])
    return rows.mapInArrow(_aligning(sources, own, keep, names), schema), names, len(byte_level(given[0]).pieces)


def pair_counts(each: DataFrame, size_a: int) -> DataFrame:
    """(code, count, best) of the pairs in each (code, n): links that hold the pair, and whether no pair with its token of B has more."""
    counts = each.groupBy("code").agg(F.sum("n").alias("count"))
    of_b = F.expr(f"code div {size_a}")
    most = counts.groupBy(of_b.alias("_b")).agg(F.max("count").alias("_most"))
    return counts.join(most, of_b == F.col("_b")).select("code", "count", (F.col("count") == F.col("_most")).alias("best"))


def aligned(docs: DataFrame, keep: list[str], text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """The columns `keep` of docs with NAMES and n_best, count_sum: links whose pair is the most frequent of its token of B, and the sum of
    their pairs' counts."""
    with scope(docs.sparkSession) as stays:
        found, names, size_a = links(docs, keep, text, paths)
        row = fresh(found, "_row")
        table = stays(cut_table(found.withColumn(row, F.monotonically_increasing_id())))
        each = table.select(F.col(row).alias("_of"), F.explode(names[-1]).alias("link")).select("_of", "link.code", "link.n")
        counts = stays(cut_table(pair_counts(each, size_a)))
        slices = max(1, -(-counts.count() // PAIRS))
        edges = counts.agg(F.percentile_approx("code", [k / slices for k in range(1, slices)], 100 * slices)).first()[0] if slices > 1 else []
        parts = []
        for low, high in zip([None, *edges], [*edges, None]):
            inside = (F.lit(True) if low is None else F.col("code") > low) & (F.lit(True) if high is None else F.col("code") <= high)
            met = each.where(inside).join(F.broadcast(counts.where(inside)), "code")  # about PAIRS rows
            parts.append(met.groupBy("_of").agg(F.sum(F.when(F.col("best"), F.col("n"))).alias("best"), F.sum(F.col("n") * F.col("count")).alias("total")))
        sums = reduce(DataFrame.unionByName, parts).groupBy("_of").agg(F.sum("best").alias("best"), F.sum("total").alias("total"))
        sums = sums.select(F.col("_of").alias(fresh(table, "_of")), F.struct("best", "total").alias(fresh(table, "_sums")))
        of, said = sums.columns
        new = [F.coalesce(F.col(said)[c], F.lit(0)).cast("long").alias(fresh(table, n)) for c, n in (("best", "n_best"), ("total", "count_sum"))]
        met = table.drop(names[-1]).join(sums, F.col(row) == F.col(of), "left")
        return met.select(*[F.col(f"`{c}`") for c in keep], *names[:-1], *new)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return aligned(docs, ["doc_id"])
