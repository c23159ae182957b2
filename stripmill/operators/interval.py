"""Which strip an index lies in: an interval join without a row for each index.

Uniform strips need arithmetic only. Others are sent to bins of the index, about as many as there are strips, so that the join is an equi-join
on the bin with a table of about three rows a strip. Up to FEW strips are counted and the table is broadcast, so that entries stay where they are; beyond
that Spark knows its size and decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.operators.running import spread

#: Strips whose bins are broadcast.
FEW = 1 << 12


@dataclass(frozen=True)
class Uniform:
    """`parts` strips of equal width over the indexes 0 to n - 1; parts must divide n."""

    n: int
    parts: int

    def __post_init__(self):
        if self.parts < 1 or self.n % self.parts:
            raise ValueError(f"{self.parts} strips do not divide {self.n}")

    @property
    def width(self) -> int:
        return self.n // self.parts

    def table(self, spark: SparkSession) -> DataFrame:
        """(strip, lo, hi)."""
        return spark.range(self.parts).select(F.col("id").alias("strip"), (F.col("id") * self.width).alias("lo"), ((F.col("id") + 1) * self.width).alias("hi"))


def located(points: DataFrame, index: str, strips: DataFrame | Uniform, names: tuple[str, str, str], keys: tuple[str, ...] = (), few: int = FEW) -> DataFrame:
    """The points inside of a strip, with the strip's number and bounds under the three names. Strips (keys, strip, lo, hi) of
    one key must not overlap."""
    name, low, high = names
    at = F.col(index)
    if isinstance(strips, Uniform):
        k = F.expr(f"`{index}` div {max(1, strips.width)}")
        return points.where((at >= 0) & (at < strips.n)).select("*", k.alias(name), (k * strips.width).alias(low), ((k + 1) * strips.width).alias(high))
    strips = strips.where("lo < hi")
    if not keys:
        edges = strips.select("strip", "lo", "hi").limit(few + 1).collect()
        if len(edges) <= few:
            bin_ = max(1, sum(e.hi - e.lo for e in edges) // max(1, len(edges)))
            rows = [(b, *e, e.lo, e.hi) for e in edges for b in range(e.lo // bin_, (e.hi - 1) // bin_ + 1)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 6
            bins = points.sparkSession.createDataFrame(pa.table(columns, names=["_bin", name, "_lo", "_hi", low, high]))
            return _joined(points, index, F.broadcast(bins), list(names), bin_)
    return binned(points, index, strips.select(*keys, "lo", "hi", F.col("strip").alias(name), F.col("lo").alias(low), F.col("hi").alias(high)), list(names), keys)


def binned(points: DataFrame, index: str, ranges: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """The points with the columns of each range (keys, lo, hi, ...) that they lie in; ranges may overlap."""
    size = ranges.agg(F.sum(F.col("hi") - F.col("lo")).alias("n"), F.count("*").alias("many")).first()
    bin_ = max(1, (size.n or 0) // max(1, size.many))
    return _joined(points, index, _bins(ranges, columns, bin_, keys), columns, bin_, keys)


def _bins(ranges: DataFrame, columns: list[str], width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    of = ranges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), *columns)
    return spread(of, F.expr(f"_lo div {width}"), F.expr(f"(_hi - 1) div {width} + 1"), "_bin")


def _joined(points: DataFrame, index: str, bins: DataFrame, columns: list[str], width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    cond = (F.expr(f"`{index}` div {width}") == F.col("_bin")) & (F.col(index) >= F.col("_lo")) & (F.col(index) < F.col("_hi"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return points.join(bins, cond).select(*points.columns, *columns)
