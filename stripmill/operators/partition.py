"""Cutting rows and columns into strips by the similarity of neighbours.

A cut stands before slice k depending on slices k-1 and k only, so all cuts are one query. Entries are dealt once to tiles of
TILE slices by ACROSS places; those at a tile's border go to the tile beside it as well (the halo), so that each entry finds
its neighbours in its own tile, where the next one along the slice's direction or a diagonal is one row away in order. A slice with
most of the entries takes many tiles. Sums by slice follow; strips are a running sum of cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripmill.functions.scatter import scattered
from stripmill.functions.similarity import Similarity, best_shift_or_zero
from stripmill.operators.interval import Uniform
from stripmill.operators.coo import Matrices, Matrix, keys_of, slices
from stripmill.operators.running import running_sum, tasks
from stripmill.sources.scratch import kept


# Partitions by hand of six public matrices, as boundaries of row strips and of column strips.
_BCSSTK04 = [0, 5, 11, 17, 24, 30, 35, 42, 45, 54, 60, 65, 71, 77, 84, 90, 95, 101, 108, 114, 120, 125, 132]
_BCSPWR06 = [0, 208, 288, 340, 392, 445, 500, 576, 840, 995, 1032, 1088, 1118, 1154, 1236, 1296, 1340, 1356, 1424, 1454]
MANUAL_STRIPS = {
    "bcsstk04": (_BCSSTK04, _BCSSTK04),
    "bcspwr06": (_BCSPWR06, _BCSPWR06),
    "bibd_12_5": ([0, 10, 20, 30, 40, 66], [0, 118, 203, 260, 295, 315, 330, 360, 414, 470, 504, 540, 595, 631, 651, 666, 701, 721, 736, 756, 771, 792]),
    "bibd_12_4": ([0, 10, 20, 30, 37, 45, 66], [0, 45, 81, 109, 130, 165, 201, 250, 265, 285, 313, 334, 349, 359, 369, 390, 425, 460, 480, 495]),
    "bibd_9_5": ([0, 8, 15, 20, 26, 36], [0, 15, 35, 55, 70, 90, 105, 120, 126]),
    "bibd_11_5": ([0, 10, 19, 35, 55], [0, 30, 50, 82, 103, 205, 335, 462]),
}


#: Slices, and places across them, of a tile.
TILE, ACROSS = 32, 1 << 12


def neighbours(entries: DataFrame, keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """(keys, k, n, d0, df, db) of every slice k with entries (keys, k, p, v): how many they are, and their products with those of slice k+1 at the
    same place, one before and one after. Entries of a slice must have places of their own. Tiles are dealt to as many tasks as there are entries for,
    which are counted if `parts` is not given."""
    if parts is None:
        entries = kept(entries)  # a file's rows are counted without reading them
        parts = tasks(entries.count())
    tile = lambda k, p: F.struct(F.expr(f"({k}) div {TILE}").alias("tk"), F.expr(f"({p}) div {ACROSS}").alias("tp"))
    home = tile("k", "p")
    # where the entries stand that this one is a neighbour of: only at a tile's border is that another tile
    seen = F.array_distinct(F.array(home, *[tile("k - 1", f"p + {s}") for s in (-1, 0, 1)]))
    # what is shuffled are numbers; whether an entry is at home follows from them
    spread_ = entries.select(*keys, "k", "p", "v", F.explode(seen).alias("tile")).select(*keys, "k", "p", "v", "tile.tk", "tile.tp")
    dealt = spread_.repartition(max(2, parts), *keys, "tk", "tp")
    dealt = dealt.select("*", ((F.col("tk") == home["tk"]) & (F.col("tp") == home["tp"])).alias("own"))
    for name, line in (("d0", F.col("p")), ("df", F.col("p") + F.col("k")), ("db", F.col("p") - F.col("k"))):
        along = Window.partitionBy(*keys, "tk", "tp", line).orderBy("k")
        dealt = dealt.withColumn(name, F.when(F.lead("k").over(along) == F.col("k") + 1, F.lead("v").over(along) * F.col("v")))
    return dealt.where("own").groupBy(*keys, "k").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("d0", "df", "db")])


def similarities(matrix: Matrix | Matrices, axis: str, similarity: Similarity, parts: int | None = None) -> DataFrame:
    """(k, na, nb, sim) for every k from 1: slice k-1 against slice k; sim is null if undefined. Here and below, `parts` tells the tasks for entries that
    are cheap to read twice, which are then not written for being counted.

    Of Matrices, here and below, with their matrix_id: many are cut in one query."""
    keys, other = keys_of(matrix), "i" if axis == "j" else "j"
    entries = matrix.df.where("v <> 0").select(*keys, F.col(axis).alias("k"), F.col(other).alias("p"), "v")
    found = neighbours(entries, keys, parts)
    before = found.select(*keys, (F.col("k") + 1).alias("k"), F.col("n").alias("na"), "d0", "df", "db")
    here = found.select(*keys, "k", F.col("n").alias("nb"))
    met = slices(matrix, axis).where("k > 0").join(before, [*keys, "k"], "left").join(here, [*keys, "k"], "left")
    met = met.fillna(0, ["d0", "df", "db", "na", "nb"])
    columns = [F.col(c) for c in ("d0", "df", "db", "na", "nb")]
    return met.select(*keys, "k", "na", "nb", similarity(*columns).alias("sim"))


def cuts_everywhere(matrix: Matrix | Matrices, axis: str, threshold: float, similarity: Similarity, parts: int | None = None) -> DataFrame:
    """(k, cut): cut where neighbours are less similar than the threshold; never between two empty ones."""
    found = similarities(matrix, axis, similarity, parts)
    return found.select(*keys_of(matrix), "k", F.coalesce(F.col("sim") < threshold, F.lit(False)).alias("cut"))


def cuts_between_runs(matrix: Matrix | Matrices, axis: str, threshold: float, similarity: Similarity = best_shift_or_zero, parts: int | None = None) -> DataFrame:
    """As cuts_everywhere, but a run of empty slices is one strip of its own."""
    found = similarities(matrix, axis, similarity, parts)
    begins = (F.col("na") == 0) & (F.col("nb") > 0)
    differs = (F.col("na") > 0) & (F.coalesce("sim", F.lit(0.0)) < threshold)
    return found.select(*keys_of(matrix), "k", (begins | differs).alias("cut"))


def strips(cuts: DataFrame, n: int | DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, strip, lo, hi) from cuts (keys, k, cut) over slices 0 to n-1; with keys, n is a table (keys, n)."""
    sizes = n if isinstance(n, DataFrame) else cuts.sparkSession.range(1).select(F.lit(n).alias("n"))
    first = sizes.where("n > 0").select(*keys, F.lit(0).cast("long").alias("k"), F.lit(False).alias("cut"))
    marks = first.unionByName(cuts.select(*keys, "k", "cut")).withColumn("c", F.col("cut").cast("long"))
    numbered = running_sum(marks, "k", "c", "strip", keys)
    return numbered.groupBy(*keys, "strip").agg(F.min("k").alias("lo"), (F.max("k") + 1).alias("hi"))


def strips_at(spark: SparkSession, boundaries: list[int]) -> DataFrame:
    """(strip, lo, hi) by hand: boundaries from 0 to the size."""
    if sorted(set(boundaries)) != list(boundaries):
        raise ValueError("boundaries must rise")
    return spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(zip(boundaries, boundaries[1:]))], "strip long, lo long, hi long")


def strips_by_hand(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """Row and column strips of one of the matrices in MANUAL_STRIPS."""
    rows, columns = MANUAL_STRIPS[name]
    return strips_at(spark, rows), strips_at(spark, columns)


def strips_uniform(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """(strip, lo, hi) of equal width; parts must divide n."""
    return Uniform(n, parts).table(spark)


def strips_random(spark: SparkSession, n: int, parts: int, seed: int = 0) -> DataFrame:
    """(strip, lo, hi) with parts - 1 distinct random cuts, the same for the same seed."""
    if not 2 <= parts <= n:
        raise ValueError("parts must be from 2 to n")
    chosen = spark.range(1, n).orderBy(scattered("id", seed), "id").limit(parts - 1)
    marks = spark.range(1, n).join(chosen.withColumn("cut", F.lit(True)), "id", "left").select(F.col("id").alias("k"), F.coalesce("cut", F.lit(False)).alias("cut"))
    return strips(marks, n)


def partitioned(matrix: Matrix | Matrices, threshold: float = 0.2, similarity: Similarity = best_shift_or_zero, cutter=cuts_between_runs, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Row and column strips; the cutter and the similarity may be the user's."""
    keys = keys_of(matrix)
    size = lambda of: matrix.dims.select(*keys, F.col(of).alias("n")) if keys else getattr(matrix, of)
    known = {"parts": parts} if parts else {}
    return tuple(strips(cutter(matrix, axis, threshold, similarity, **known), size(of), keys) for axis, of in (("i", "rows"), ("j", "columns")))
