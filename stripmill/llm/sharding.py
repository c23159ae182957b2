"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal text are linked. All documents start in shards by a hash, which knows no
links. Then, in rounds, the members of each group of links vote by bytes for a shard, and members
elsewhere ask to move there. How many bytes may go from each shard to each other follows from what
asks to and from the shards' capacity quotas for linked documents: moves out make room for moves in. So cut
links become fewer in every round while no shard's linked documents grow past its quota. At last, unlinked
documents, which may stand anywhere, move from shards above the mean to shards below it, smallest first.

Law `bytes`: a document's size is the UTF-8 bytes of its text plus 8, and shards get nearly equal sums.

Running sums are taken in two levels (prefix_sums), so neither a shard nor a group of equal texts,
however large, meets in one task. Groups above their share of the rows are fewer than that many shares:
their results are broadcast, so that no join gathers such a group either.

Defined cases: a null text counts as empty, and all such are equal texts; repeated rows each get a
slot; rows without doc_id and those of groups above their share, which may repeat one doc_id, start in shards by their
place, all others by doc_id and text; of shards with equal
votes a group takes one by a hash; equal sizes are told apart by doc_id, then by the text's hash; a text may be of any
length; an empty table gives an empty result; a single document larger than a shard's share leaves that shard above
the mean, and so does a group without room; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.llm.common import cut, cut_table, partitions, prefix_sums, scope

SHARDS = 24
ROUNDS = 4
SEED = 11
#: Steps in which the moves between shards are fitted to their capacity, at most.
FITTING = 500
#: What a shard may hold of linked documents above the mean of all.
SLACK = 0.01
OVERHEAD = 8


def _lookup(values: list[float], at: Column) -> Column:
    """values[at]; as many as there are shards, or pairs of shards."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at + 1).cast("int"))


def _loads(rows: DataFrame, shards: int) -> list[int]:
    """Bytes of each shard: one row for each shard comes to the driver."""
    found = {r[0]: int(r[1]) for r in rows.groupBy("shard").agg(F.sum("size")).collect()}
    return [found.get(k, 0) for k in range(shards)]


def _placed(nodes: DataFrame, chunks: int, shards: int) -> DataFrame:
    """Nodes with `alone` (no equal text), `hot` (in a group above its share), `by`, by which they are spread, as ids may be
    missing or repeated, and the shards they start in."""
    n = nodes.count()
    groups = cut_table(nodes.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("_n")).where("_n > 1"))
    hot = F.broadcast(groups.where(F.col("_n") > max(1000, n // chunks)).select(F.col("_g").alias("_h")))  # at most `chunks` rows
    rows = nodes.join(hot, F.col("g") == F.col("_h"), "left").withColumn("hot", F.col("_h").isNotNull()).drop("_h")
    rows = _keyed(rows).join(groups, (F.col("_k") == F.col("_g")) & ~F.col("hot"), "left").withColumn("alone", F.col("_g").isNull() & ~F.col("hot")).drop("_g", "_n", "_k")
    by = F.when(F.col("doc_id").isNull() | F.col("hot"), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id", "g"))
    return rows.withColumn("by", by).withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "by"), F.lit(shards)).cast("int"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with _k, by which they are joined with results of groups: the group, but rows of hot groups, which are joined
    by broadcast, are spread."""
    return rows.withColumn("_k", F.when(F.col("hot"), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("g")))


def cut_links(rows: DataFrame) -> int:
    """Members of groups outside the shard that most of their group's bytes are in."""
    parts = rows.where("not alone").groupBy("g", "shard").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    per = parts.groupBy("g").agg((F.sum("n") - F.max(F.struct("w", "n"))["n"]).alias("cut"))
    return int(per.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0])


def flows(asked: dict[tuple[int, int], int], loads: list[int], capacity: float) -> list[list[float]]:
    """Bytes that may go from shard to shard: as many as ask to, less where a shard would pass its capacity after
    all moves; as less moving in there leaves more behind elsewhere, until it holds for all."""
    n = len(loads)
    out = [[float(asked.get((i, j), 0)) for j in range(n)] for i in range(n)]
    for _ in range(FITTING):
        after = [loads[j] + sum(out[i][j] - out[j][i] for i in range(n)) for j in range(n)]
        over = [j for j in range(n) if after[j] > capacity + 1 and any(out[i][j] for i in range(n))]
        for j in over:
            inflow = sum(out[i][j] for i in range(n))
            keep = max(0.0, 1 - (after[j] - capacity) / inflow)
            for i in range(n):
                out[i][j] *= keep
        if not over:
            break
    return out


def _propagate(rows: DataFrame, chunks: int, shards: int) -> DataFrame | None:
    """One round of moves towards the shards that groups vote for; None if nothing asks to move."""
    votes = rows.where("not alone").groupBy("g", "hot", "shard").agg(F.sum("size").alias("w"))
    best = F.max(F.struct("w", F.xxhash64("g", "shard").alias("tie"), "shard"))["shard"]
    cast = cut_table(votes.groupBy(F.col("g").alias("_g"), F.col("hot").alias("_hot")).agg(best.alias("to"), F.count("*").alias("parts")).where("parts > 1").drop("parts"))
    if cast.isEmpty():
        return None
    of_hot = F.broadcast(cast.where("_hot").select(F.col("_g").alias("_h"), F.col("to").alias("_to")))
    of_cold = cast.where("not _hot").select("_g", "to")
    asked = _keyed(rows).join(of_hot, (F.col("g") == F.col("_h")) & F.col("hot"), "left").join(of_cold, (F.col("_k") == F.col("_g")) & ~F.col("hot"), "left")
    asked = asked.withColumn("to", F.coalesce("_to", "to")).drop("_h", "_to", "_g", "_k").withColumn("asks", F.col("to").isNotNull() & (F.col("to") != F.col("shard")))
    asked = cut(asked)
    total, loads = sum(_loads(rows, shards)), _loads(rows.where("not alone"), shards)
    wish = {(r[0], r[1]): int(r[2]) for r in asked.where("asks").groupBy("shard", "to").agg(F.sum("size")).collect()}  # a row for each two shards
    quota = [x for row in flows(wish, loads, (1 + SLACK) * total / shards) for x in row]
    # members of a group stand together, but for those of a hot one, so that groups move as a whole
    movers = asked.where("asks").withColumn("chunk", F.pmod(F.xxhash64("g", F.when(F.col("hot"), F.col("by"))), F.lit(chunks)))
    movers = prefix_sums(movers, ["shard", "to"], "chunk", ["g", "size", "doc_id", "by"], "size", "before")
    fits = F.col("before") + F.col("size") <= _lookup(quota, F.col("shard") * shards + F.col("to"))
    movers = movers.withColumn("shard", F.when(fits, F.col("to")).otherwise(F.col("shard")))
    return asked.where("not asks").select(*rows.columns).unionByName(movers.select(*rows.columns))


def _levelled(rows: DataFrame, shards: int) -> DataFrame:
    """Unlinked documents, smallest first, move from shards above the mean into the gaps of others."""
    loads = _loads(rows, shards)
    mean = sum(loads) / shards
    over, gap = [max(0.0, x - mean) for x in loads], [max(0.0, mean - x) for x in loads]
    # chunks ascend with the size; a size that many documents have is spread
    step = F.floor(F.log2("size") * 8).cast("long")
    chosen = rows.where("alone").withColumn("chunk", step * 64 + F.pmod(F.xxhash64("by"), F.lit(64)))
    chosen = prefix_sums(chosen, ["shard"], "chunk", ["size", "doc_id", "g", "by"], "size", "before")
    moves = F.col("before") + F.col("size") <= _lookup(over, F.col("shard"))
    chosen = cut(chosen.withColumn("moves", moves).drop("before"))
    movers = prefix_sums(chosen.where("moves").withColumn("chunk", F.pmod(F.xxhash64("by"), F.lit(256))), [], "chunk", ["doc_id", "size", "g", "by"], "size", "before")
    ends, end = [], 0.0
    for x in gap:
        end += x
        ends.append(end)
    middle = F.col("before") + F.col("size") / 2
    to = F.lit(max(range(shards), key=gap.__getitem__))
    for k in range(shards - 1, -1, -1):
        if gap[k]:
            to = F.when(middle < ends[k], F.lit(k)).otherwise(to) if ends[k] < end else F.lit(k)
    movers = movers.withColumn("shard", to)
    return rows.where("not alone").unionByName(chosen.where("not moves").select(*rows.columns)).unionByName(movers.select(*rows.columns))


def started(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, crc, g, hot, alone, by, shard) of every row of docs, before any move; g is one for equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    nodes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("g"))
    nodes = cut(nodes.withColumn("g", F.xxhash64("g", "crc", "size")))
    return cut(_placed(nodes, 4 * partitions(docs.sparkSession), shards))


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs."""
    chunks = 4 * partitions(docs.sparkSession)
    with scope(docs.sparkSession):
        rows = started(docs, shards)
        for _ in range(rounds):
            moved = _propagate(rows, chunks, shards)
            if moved is None:
                break
            rows = cut(moved)
        rows = cut(_levelled(rows, shards))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("by"), F.lit(chunks))).withColumn("one", F.lit(1).cast("long"))
    rows = prefix_sums(rows, ["shard"], "chunk", ["doc_id", "g", "by"], "one", "slot")
    return rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
