"""Conversations with broken structure, repaired by the cheapest edits.

A conversation is sound if the initials of its roles read `(s?(ua)+)?` and none of its turns is blank, repeated or cut off. Edits:
Keep costs 0; Rerole to user or assistant 3; Delete 4, which blank and repeated turns need; Insert an empty turn of
user or assistant 3; and a cut-off turn that stays adds 3. Of the cheapest edits those are taken whose initials, in order, are the least in ASCII.

Each turn takes one macro edit: a run of inserts, then what happens to the turn. Their codes (D, ID, IIK, ...) are
prefix-free, so two rows of as many codes compare as their first different codes do, and the edits may be found turn by turn:
after each turn a layer holds, for every state of the grammar, the least cost to get there and, in place of the text of edits, its rank among
the layer's. The texts' order in the next layer follows from these ranks and one code. Layers less their least cost are few, so each
is made once, with its successors and the pointers back, and a conversation is a walk through numbered layers; going
back along the pointers gives the text of edits.

Rows are put in order by ranges of (conv_id, turn) and numbered; CHUNK of them are worked on together. What a chunk holds of a conversation is a run,
which is summed up as a map: for each state that it may be entered in and left in, the cost and the edits. A conversation's maps are put together in
order, so that a large one doesn't meet in one task. A last pass over the texts, in order, applies the edits, one turn at a time: a digest of a
whole conversation can't be had otherwise.

Defined cases: nulls in role and text count as one space, and a null conv_id is one conversation of its own; turns of null stand first; rows of one turn stand in order of
their role, the beginning of their text and a digest, equal rows follow each other; a role of another initial can't be
kept; a conversation without rows gives zeros, no edits and the digest of no text; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripmill.llm.common import cut_table, hot_share, joined, partitions, scope, small_batches

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: Numbers of rows whose bits above these are the same are worked on together.
CHUNK_BITS = 12
#: Characters of a text that its order among texts of one turn and role goes by, before a digest.
BEGINNING = 32
#: White space: what a blank text consists of.
SPACES = "\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D"

#: States of the grammar: nothing yet, after a system turn, after a user's, after an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Where an inserted or reroled turn leads, and whose it is.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: A turn's kind: its initial, and whether it must go or is cut off.
INITIALS, MUST_GO, IS_CUT_OFF = "sua", 4, 8
_NEVER = 1 << 60


def _kept(state: int, initial: int) -> int | None:
    """State after a turn of that initial is kept."""
    return {(NOTHING, 0): SYSTEM, (NOTHING, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}.get((state, initial))


def _macros(state: int, kind: int) -> Iterator[tuple[str, int, int]]:
    """(code, state after, cost) of every macro edit of a turn."""
    price = CUT_OFF if kind & IS_CUT_OFF else 0
    for inserts in range(3):
        before, paid = "I" * inserts, INSERT * inserts
        yield before + "D", state, paid + DELETE
        if not kind & MUST_GO:
            yield before + "R", NEXT[state], paid + REROLE + price
            if (after := _kept(state, kind & 3)) is not None:
                yield before + "K", after, paid + KEEP + price
        state = NEXT[state]


def _ending(state: int) -> tuple[str, int] | None:
    """Inserts after the last turn, and their cost."""
    n = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
    return "I" * n, INSERT * n


class Layers:
    """All layers that occur, numbered. A layer is a tuple of (cost, rank) for each state, with the least cost 0; None where a state isn't
    reached, or costs so much more than another that it can't be on a cheapest way."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.layers: list[tuple] = []
        #: by number * 16 + kind: the next layer, what it costs more, and (state before, code) of each of its states
        self.next: dict[int, tuple[int, int, tuple]] = {}
        self.begin = [self._of([(0, 0) if s == k else None for s in STATES]) for k in STATES]

    def _of(self, layer: list) -> int:
        n = self.number.setdefault(tuple(layer), len(self.layers))
        if n == len(self.layers):
            self.layers.append(tuple(layer))
        return n

    def step(self, n: int, kind: int) -> tuple[int, int, tuple]:
        key = n * 16 + kind
        if (known := self.next.get(key)) is None:
            best: list = [None] * len(STATES)
            for state, held in enumerate(self.layers[n]):
                if held is not None:
                    for code, after, price in _macros(state, kind):
                        way = (held[0] + price, held[1], code, state)
                        if best[after] is None or way < best[after]:
                            best[after] = way
            # whatever may follow nothing or a system turn may follow an assistant's, if a system turn still to come is deleted
            if (last := best[ASSISTANT]) is not None:
                for state, more in ((NOTHING, DELETE), (SYSTEM, 0)):
                    if best[state] is not None and best[state][0] > last[0] + more:
                        best[state] = None
            least = min(w[0] for w in best if w is not None)
            order = sorted({w[1:3] for w in best if w is not None})
            layer = [None if w is None else (w[0] - least, order.index(w[1:3])) for w in best]
            known = self.next[key] = self._of(layer), least, tuple(None if w is None else (w[3], w[2]) for w in best)
        return known


def run_map(layers: Layers, kinds: list[int], enter: Iterable[int]) -> list[tuple[int, int, int, int, str]]:
    """(state before, state after, cost, rank, edits) of a run of turns; ranks compare the edits of one state before."""
    out = []
    for state in enter:
        n, total, back = layers.begin[state], 0, []
        for kind in kinds:
            n, more, pointers = layers.step(n, kind)
            total += more
            back.append(pointers)
        for after, held in enumerate(layers.layers[n]):
            if held is not None:
                at, codes = after, []
                for pointers in reversed(back):
                    at, code = pointers[at]
                    codes.append(code)
                out.append((state, after, total + held[0], held[1], "".join(reversed(codes))))
    return out


def put_together(maps: Iterable[list[tuple[int, int, int, int, str]]]) -> tuple[int, str]:
    """Cost and edits of a conversation from its runs' maps in order."""
    # of each state the cost and rank so far, and the way there as a chain
    held: dict[int, tuple] = {NOTHING: (0, 0, None)}
    for run in maps:
        best: dict[int, tuple] = {}
        for before, after, cost, rank, edits in run:
            if before in held:
                way = (held[before][0] + cost, held[before][1], rank, before, edits)
                if after not in best or way[:3] < best[after][:3]:
                    best[after] = way
        order = sorted({w[1:3] for w in best.values()})
        held = {s: (w[0], order.index(w[1:3]), (held[w[3]][2], w[4])) for s, w in best.items()}
    # codes have been equally many, so an ending decides only between edits that are equal, which ranks don't allow
    cost, _, ending, chain = min((c + _ending(s)[1], rank, _ending(s)[0], chain) for s, (c, rank, chain) in held.items())
    pieces = [ending]
    while chain is not None:
        chain, edits = chain
        pieces.append(edits)
    return cost, "".join(reversed(pieces))


# Rows ---------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that a hash of conv_id and turn chooses: dropped, emptied, without full stops, twice,
    or with the role user."""
    rows = _plain(conversations)
    name = F.concat(*[F.coalesce(x, F.lit(" ")) for x in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])
    rows = rows.withColumn("_fault", F.crc32(name) % 20).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, F.lit("")).when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def _plain(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def _ordered(rows: DataFrame) -> list[Column]:
    """What rows of a conversation are in order of, after _plain() or damaged()."""
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")
    key = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), said).cast("binary"))
    return [F.col("turn"), F.col("role"), F.substring("text", 1, BEGINNING).alias("beginning"), key.alias("key")]


def _flagged(rows: DataFrame) -> DataFrame:
    """(chunk, pos, conv_id, turn, kind, fault) of all rows, numbered in order; fault is 1 for a blank turn, 2 for a repeated and 3 for a cut-off one."""
    spark = rows.sparkSession
    body = F.expr(f"trim(TRAILING '{SPACES}' FROM text)")
    initial = F.expr(f"locate(substring(role, 1, 1), '{INITIALS}') - 1")
    initial = F.when((F.col("role") == "") | (initial < 0), F.lit(3)).otherwise(initial)
    facts = rows.select("conv_id", *_ordered(rows), initial.cast("int").alias("initial"), (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open"))
    sort = ["conv_id", "turn", "role", "beginning", "key"]
    numbered = facts.repartitionByRange(partitions(spark), *sort).sortWithinPartitions(*sort).select(F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "initial", "blank", "open", "key")
    table = cut_table(numbered)
    first = table.groupBy("key").agg(F.min("pos").alias("low"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("key").alias("of"), "low", (F.col("n") > hot_share(spark, table.count())).alias("hot"))
    met = joined(table, "key", first, "of")
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("low"), 2).when(F.col("open"), 3).otherwise(0)
    kind = F.col("initial") + F.when(fault.isin(1, 2), MUST_GO).when(fault == 3, IS_CUT_OFF).otherwise(0)
    return met.select(F.shiftright("pos", CHUNK_BITS).alias("chunk"), "pos", "conv_id", "turn", kind.cast("int").alias("kind"), fault.cast("int").alias("fault"))


_MAP = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("before", T.IntegerType()), ("after", T.IntegerType()), ("cost", T.LongType()), ("rank", T.IntegerType()), ("edits", T.StringType()))]))
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_RUN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("chunk", T.LongType()), *[T.StructField(n, T.LongType()) for n in (*_COUNTS, "turns", "first_turn", "last_turn")], T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("map", _MAP)])
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (chunk, conv_id, turn, kind, fault) rows, which are in order of their numbers."""
    layers = Layers()

    def runs() -> Iterator[tuple]:
        for chunk, members in groupby(_rows(batches), key=lambda r: r[0]):
            for k, (conv, turns) in enumerate(groupby(members, key=lambda r: r[1])):
                held = [r[2:] for r in turns]
                faults = [r[2] for r in held]
                given = [r[0] for r in held if r[0] is not None]
                initials = [r[1] & 3 for r in held]
                illegal = sum(p not in _LEGAL for p in zip(initials, initials[1:]))
                # only a chunk's first run may have begun before
                found = run_map(layers, [r[1] for r in held], STATES if k == 0 else (NOTHING,))
                said = [dict(zip(("before", "after", "cost", "rank", "edits"), f)) for f in found]
                yield conv, chunk, faults.count(1), faults.count(2), faults.count(3), illegal, len(set(given)), min(given, default=None), max(given, default=None), initials[0], initials[-1], said

    yield from _batches(runs(), _arrow(_RUN))


_PLAN = T.StructType([T.StructField("conv_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("gaps", *_COUNTS, "cost")], T.StructField("audit", T.StringType())])


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their runs, which are in order."""

    def plans() -> Iterator[tuple]:
        for conv, runs in groupby(_rows(batches), key=lambda r: r[0]):
            counts, turns, low, high, last, maps = [0] * 4, 0, None, None, None, []
            for _, _, *own, distinct, first_turn, last_turn, first, final, said in runs:
                counts = [a + b for a, b in zip(counts, own)]
                counts[3] += last is not None and (last, first) not in _LEGAL
                turns += distinct - (high is not None and first_turn == high)
                low, high, last = first_turn if low is None else low, high if last_turn is None else last_turn, final
                maps.append([(m["before"], m["after"], m["cost"], m["rank"], m["edits"]) for m in said])
            gaps = 0 if low is None else high - low + 1 - turns
            yield conv, gaps, *counts, *put_together(maps)

    yield from _batches(plans(), _arrow(_PLAN))


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations in rows (conv_id, turn, role, text)."""
    flagged = _flagged(rows).repartition("chunk").sortWithinPartitions("chunk", "pos")
    runs = flagged.select("chunk", "conv_id", "turn", "kind", "fault").mapInArrow(_summed_up, _RUN)
    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_planned, _PLAN)


_PLAN_FIELDS = [f.name for f in _PLAN.fields[1:]]


def _stream(rows: DataFrame, planned: DataFrame, ids: DataFrame) -> DataFrame:
    """For each conversation its id, then its plan, then its rows in order."""
    nothing = {n: F.lit(None).cast(t) for n, t in (("turn", "long"), ("role", "string"), ("beginning", "string"), ("key", "string"), ("text", "string"), *((f.name, f.dataType) for f in _PLAN.fields[1:]))}

    def part(df: DataFrame, what: int, *given: Column) -> DataFrame:
        found = df.select("conv_id", *given)
        return found.select("conv_id", F.lit(what).alias("what"), *[F.col(n) if n in found.columns else c.alias(n) for n, c in nothing.items()])

    parts = part(ids.distinct(), 0).unionByName(part(planned, 1, *map(F.col, _PLAN_FIELDS))).unionByName(part(rows, 2, *_ordered(rows), F.col("text")))
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "what", "turn", "role", "beginning", "key")
    return ordered.select("conv_id", "what", "role", "text", *_PLAN_FIELDS)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list, Iterator[tuple[str, str, str]]]]:
    """(conv_id, plan, repaired turns) of a _stream(); the turns (edit, role, text) must be read before the next conversation."""
    for conv, members in groupby(_rows(batches), key=lambda r: r[0]):
        plan = [0] * 6 + [""]
        row = next(members, None)
        while row is not None and row[1] < 2:
            if row[1] == 1:
                plan = list(row[4:])
            row = next(members, None)
        yield conv, plan, _repaired(plan[-1], row, members)


def _repaired(audit: str, row: tuple | None, members: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    state = NOTHING
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield edit, ROLE[state], ""
            continue
        role, text = row[2], row[3]
        row = next(members, None)
        if edit == "D":
            continue
        state = NEXT[state] if edit == "R" else _kept(state, INITIALS.index(role[0]))
        yield edit, ROLE[state] if edit == "R" else role, text


_TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = ((conv, k, *turn) for conv, _, turns in _conversations(batches) for k, turn in enumerate(turns))
    yield from _batches(found, _arrow(_TURNS), 256)


_DIGEST = T.StructType([*_PLAN.fields, T.StructField("repaired_sha256", T.StringType())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple]:
        for conv, plan, turns in _conversations(batches):
            digest = hashlib.sha256()
            for k, (_, role, text) in enumerate(turns):
                digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            yield conv, *plan, digest.hexdigest()

    yield from _batches(found(), _arrow(_DIGEST))


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, edit, role, text): the turns of the repaired conversations, numbered from 0, with the edit that made each, K, R or I."""
    small_batches(conversations.sparkSession)
    rows = _plain(conversations)
    with scope(conversations.sparkSession) as stays:
        planned = stays(cut_table(plans(rows)))
    return _stream(rows, planned, rows.select("conv_id")).mapInArrow(_turns, _TURNS)


def digests(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """For each conversation in ids (conv_id): its faults, the cost and initials of the edits, and the SHA-256 of what they make of its rows."""
    small_batches(rows.sparkSession)
    with scope(rows.sparkSession) as stays:
        planned = stays(cut_table(plans(rows)))
    return _stream(rows, planned, ids).mapInArrow(_digested, _DIGEST)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return digests(damaged(given), _plain(given).select("conv_id"))
