"""A matrix that is inspected once and multiplied many times.

It is cut into tiles: pieces of dense blocks, stored as cells, and bounded parts of the other blocks' entries. Tiles stand in
places, each the work of one task: columns are cut into ranges of at most `span`, so that a task holds a bounded part of the vector, however long that
is; and each range's tiles are dealt to as many places as its work asks for, so that a column or a range with most of the entries
takes many tasks. Tiles are dealt in order of their work, forth and back over the places (in as many rounds of their own as LIST asks for), so that a
place has no more than its share and one tile a round.

The tiles are written once, bucketed by place. A product sends each place its part of the vector and reads the bucket beside
it: of the matrix nothing is shuffled, however often it is multiplied.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripmill.operators.blocks import packed
from stripmill.operators.interval import binned
from stripmill.operators.kernel import CELLS, by_columns, doubles, groups, lists, multiplied, numbers
from stripmill.sources.scratch import kept, removed, scratch

#: Cells or entries of a place, at most but for one tile a round; entries of a tile; columns of a range.
PLACE, ENTRIES, SPAN = 1 << 24, 1 << 20, 1 << 20
#: Tiles that are put in order in one task.
LIST = 1 << 16


@dataclass(frozen=True)
class Saved:
    """tiles (place, r0, r1, c0, c1, cells, i, j, v): a dense tile has cells, another arrays of entries. spans (range, lo, hi, base, places): the columns
    that a range's tiles meet, and its places, from base on."""

    tiles: DataFrame
    spans: DataFrame
    table: str
    folders: tuple[str, ...]

    def drop(self) -> None:
        self.tiles.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")
        for folder in self.folders:
            removed(self.tiles.sparkSession, folder)


def ranked(units: DataFrame, key: str, work: str, order: list[str], many: int) -> DataFrame:
    """units with `round` and `rank`: in each of `many` rounds of a key, chosen by a hash, the place in falling order of work."""
    dealt = units.withColumn("round", F.pmod(F.xxhash64(*order), F.lit(many)))
    return dealt.withColumn("rank", F.row_number().over(Window.partitionBy(key, "round").orderBy(F.desc(work), *order)) - 1)


def placed(units: DataFrame, order: list[str], target: int) -> tuple[DataFrame, DataFrame]:
    """Units (range, work, order) with `place`, and (range, base, places, work).

    A range has as many places as target goes into its work. Dealing forth and back, a round's places differ by no more than its largest unit, so a place has at
    most target and one unit of each round."""
    per = kept(units.groupBy("range").agg(F.sum("work").alias("work"), F.count("*").alias("n")).withColumn("places", F.expr(f"cast(ceil(work / {target}D) as long)")))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    per = kept(per.withColumn("base", F.coalesce(F.sum("places").over(before), F.lit(0))))
    rounds = -(-(per.agg(F.max("n")).first()[0] or 0) // LIST) or 1
    found = ranked(units, "range", "work", order, rounds).join(per.select("range", "base", "places"), "range")
    # rounds begin at different places
    turn = F.col("rank") % (2 * F.col("places"))
    at = F.when(turn < F.col("places"), turn).otherwise(2 * F.col("places") - 1 - turn)
    place = F.col("base") + (at + F.col("round")) % F.col("places")
    return found.withColumn("place", place).drop("round", "rank", "base", "places"), per


@contextmanager
def saving(members: DataFrame, chosen: DataFrame, span: int = SPAN, place: int = PLACE) -> Iterator[Saved]:
    """save(), dropped at the end."""
    found = save(members, chosen, span, place)
    try:
        yield found
    finally:
        found.drop()


def save(members: DataFrame, chosen: DataFrame, span: int = SPAN, place: int = PLACE) -> Saved:
    """Tiles of a matrix whose members and split blocks are given; both are read several times and should be stored."""
    spark = members.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sparse = chosen.where("not is_dense").select("a", "b", F.expr(f"cast(ceil(nnz / {ENTRIES}D) as long)").alias("parts"))
    rest = members.join(sparse, ["a", "b"]).withColumn("range", F.expr(f"j div {span}")).withColumn("part", F.pmod(F.xxhash64("i", "j"), "parts"))
    tile = ["a", "b", "range", "part"]
    dense = packed(members, chosen).withColumn("range", F.expr(f"c0 div {span}"))
    dense_folder = scratch(spark)
    dense.write.parquet(f"{dense_folder}/rows")
    dense = spark.read.schema(dense.schema).parquet(f"{dense_folder}/rows")
    units = rest.groupBy(*tile).agg(F.count("*").alias("work"), F.min("j").alias("lo"), (F.max("j") + 1).alias("hi"))
    units = units.unionByName(dense.select("a", "b", "range", (-1 - F.col("first")).alias("part"), F.col("size").alias("work"), F.col("c0").alias("lo"), F.col("c1").alias("hi")))
    units = kept(units)
    total = units.agg(F.sum("work")).first()[0] or 0
    where, per = placed(units, tile[:2] + tile[3:], max(1, min(place, total // buckets)))
    where = kept(where)
    spans = kept(units.groupBy("range").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(per, "range").select("range", "lo", "hi", "base", "places"))
    entries = rest.join(where.select(*tile, "place"), tile).repartition(buckets, "place")
    lists_ = entries.groupBy("place", *tile).agg(F.collect_list(F.struct("i", "j", "v")).alias("e"))
    nothing = F.lit(None)
    tiles = lists_.select("place", *[nothing.cast("long").alias(n) for n in ("r0", "r1", "c0", "c1")], nothing.cast("binary").alias("cells"), F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.col("e.v").alias("v"))
    cells = dense.withColumn("part", -1 - F.col("first")).join(where.select(*tile, "place"), tile).repartition(buckets, "place")
    tiles = tiles.unionByName(cells.select("place", "r0", "r1", "c0", "c1", "cells", *[nothing.cast(f"array<{t}>").alias(n) for n, t in (("i", "bigint"), ("j", "bigint"), ("v", "double"))]))
    table, folder = f"saved_{uuid.uuid4().hex}", scratch(spark)
    tiles.write.bucketBy(buckets, "place").sortBy("place").option("path", f"{folder}/tiles").format("parquet").saveAsTable(table)
    removed(spark, dense_folder)
    return Saved(spark.table(table), spans, table, (folder,))


def _product(width: int):
    def run(tiles: pa.Table, x: pa.Table) -> pa.Table:
        j = x["j"].to_numpy()
        order = np.argsort(j)
        j = j[order]
        xs = x["xs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[order]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in tiles.to_batches():
            dense = pa.compute.is_valid(batch.column(batch.schema.get_field_index("cells")))
            for rows in (batch.filter(dense),):
                shapes = np.stack([numbers(rows, "r1") - numbers(rows, "r0"), numbers(rows, "c1") - numbers(rows, "c0")], axis=1).astype(np.int64)
                for part in groups(shapes.prod(axis=1) + shapes.sum(axis=1) * width, CELLS):
                    mine = rows.slice(part.start, part.stop - part.start)
                    cells, begin = doubles(mine.column(mine.schema.get_field_index("cells")))
                    c0 = numbers(mine, "c0").astype(np.int64)
                    low, high = np.searchsorted(j, c0), np.searchsorted(j, numbers(mine, "c1"))
                    from_ = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist())])
                    for _, i, y in multiplied(numbers(mine, "r0").astype(np.int64), shapes[part], cells, begin[:-1], j[from_] - np.repeat(c0, high - low), high - low, xs[from_], np.zeros(len(c0), np.int64)):
                        found.append((i, y))
            rows = batch.filter(pa.compute.invert(dense))
            (i, _), (at, _), (v, _) = lists(rows, "i"), lists(rows, "j"), lists(rows, "v")
            step = max(1, CELLS // width)
            for low in range(0, len(i), step):
                found.append(_entries(i[low : low + step], at[low : low + step], v[low : low + step], j, xs))
        if not found:
            return pa.table({"i": pa.array([], pa.int64()), "ys": pa.array([], pa.list_(pa.float64()))})
        i, y = _added(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        return pa.table({"i": pa.array(i, pa.int64()), "ys": pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * width, pa.int32()), pa.array(y.reshape(-1)))})

    return run


def _added(i: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of y summed for each i."""
    order = np.argsort(i, kind="stable")
    i = i[order]
    begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    return i[begin], np.add.reduceat(y[order], begin) if len(i) else y


def _entries(i: np.ndarray, at: np.ndarray, v: np.ndarray, j: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.searchsorted(j, at)
    there = np.flatnonzero((k < len(j)) & (j[np.minimum(k, max(0, len(j) - 1))] == at)) if len(j) else np.zeros(0, np.int64)
    return _added(i[there], v[there, None] * xs[k[there]])


def product(saved: Saved, x: DataFrame, width: int = 1) -> DataFrame:
    """(i, y) for x (j, x); for x (j, xs) with arrays of the given width, (i, k, y). Rows of the matrix that meet no row of x have none."""
    value = F.array(F.col("x").cast("double")) if "x" in x.columns else F.col("xs").cast("array<double>")
    near = binned(x.select("j", value.alias("xs")), "j", saved.spans, ["base", "places"])
    sent = near.select(F.explode(F.sequence("base", F.col("base") + F.col("places") - 1)).alias("place"), "j", "xs")
    parts = saved.tiles.groupBy("place").cogroup(sent.groupBy("place")).applyInArrow(_product(width), "i long, ys array<double>")
    if "x" in x.columns:
        return parts.groupBy("i").agg(F.sum(F.col("ys")[0]).alias("y"))
    return by_columns(parts).groupBy("i", "k").agg(F.sum("y").alias("y"))


def chained(saved: Saved, x: DataFrame, times: int, scale: float = 1.0) -> DataFrame:
    """(i, y) after `times` products, each with the last one's result, times scale, as its vector. Vectors are written, so
    that a lost executor costs one product at most."""
    for k in range(times):
        y = product(saved, x).select("i", (F.col("y") * scale).alias("y"))
        y = kept(y)
        x = y.select(F.col("i").alias("j"), F.col("y").alias("x"))
    return y


def loads(saved: Saved) -> DataFrame:
    """(place, work, tiles) of all places."""
    return saved.tiles.groupBy("place").agg(F.sum(F.coalesce(F.length("cells") / 8, F.size("v"))).cast("long").alias("work"), F.count("*").alias("tiles"))
