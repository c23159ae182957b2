"""Running sums and index ranges over long dense domains without a single-task window or an unbounded array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places summed in one task, and numbers in an array.
CHUNK = 1 << 16
#: Rows that one task sorts or gathers, about.
TASK_ROWS = 1 << 18


def tasks(rows: int) -> int:
    """Tasks for as many rows: they grow in number with the rows, and not in size."""
    return max(1, -(-rows // TASK_ROWS))


def running_sum(df: DataFrame, order: str, value: str | list[str], out: str | list[str], keys: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Adds the inclusive running sum of `value` in order of the integer column `order`, within keys;
    of several values at once if lists are given.

    Two levels: the sums of chunks of `order` are added up, which takes a row per chunk, and each
    chunk's own running sum starts from there."""
    pairs = list(zip([value], [out])) if isinstance(value, str) else list(zip(value, out))
    part = F.expr(f"`{order}` div {chunk}")
    rows = df.withColumn("_part", part)
    totals = rows.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_total_{o}") for v, o in pairs])
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_at"), *[F.coalesce(F.sum(f"_total_{o}").over(before), F.lit(0)).alias(f"_base_{o}") for _, o in pairs])
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cond = F.col("_part") == F.col("_at")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    summed = rows.withColumns({f"_within_{o}": F.sum(v).over(inside) for v, o in pairs}).join(base, cond)
    return summed.select(*df.columns, *[(F.col(f"_within_{o}") + F.col(f"_base_{o}")).alias(o) for _, o in pairs])


def spread(df: DataFrame, low: str | Column, high: str | Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """A row for each integer `out` from low to before high, by way of arrays of at most `chunk` numbers."""
    low, high = (F.col(c) if isinstance(c, str) else c for c in (low, high))
    bounded = df.withColumns({"_low": low, "_high": high}).where("_low < _high")
    starts = bounded.withColumn("_start", F.explode(F.sequence("_low", F.col("_high") - 1, F.lit(chunk).cast("long"))))
    return starts.withColumn(out, F.explode(F.sequence("_start", F.least("_high", F.col("_start") + chunk) - 1))).drop("_low", "_high", "_start")
