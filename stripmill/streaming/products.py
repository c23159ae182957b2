"""Products of a matrix whose entries arrive as a stream.

Sums are associative, so plain entries need no more than a running aggregation. Where an entry may be corrected, delivered again or arrive
out of order, each place (i, j) has its own state: of all its entries the one with the greatest number. One with the same or a
smaller number changes nothing, so neither repetition nor order matters. What changes is written with each batch, under the batch's
number, so that a batch that is run again after a failure writes the same again; the product is the sum over the places' last states. The state
goes with the stream's checkpoint, and a stream that is stopped goes on where it was.

latest() keeps a row of state for each place for good. closed() cuts time into periods, of which each is a matrix of its own: it is given out once
when the watermark has passed it, and its state is given up; entries that come later are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.operators.product import spmv


def running_spmv(entries: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) over a stream of entries (i, j, v), for update or complete output: sums are
    associative, so each batch adds to its rows. The state holds a row for each row of the matrix."""
    return spmv(entries, x)


def latest(entries: DataFrame, x: DataFrame) -> DataFrame:
    """(i, j, nth, y) for update output, from a stream of entries (i, j, v, nth) of which the one with the greatest nth holds at each
    place, the greatest of equal ones; y is what it gives to the product."""
    last = F.max(F.struct("nth", (F.col("v") * F.col("x")).alias("y"))).alias("last")
    return entries.join(x, "j").groupBy("i", "j").agg(last).select("i", "j", "last.nth", "last.y")


def closed(entries: DataFrame, x: DataFrame, period: str, delay: str) -> DataFrame:
    """(start, i, j, nth, y) for append output: as latest(), for each period of the entries' time ts, once the latest ts is `delay` beyond its end."""
    last = F.max(F.struct("nth", (F.col("v") * F.col("x")).alias("y"))).alias("last")
    met = entries.withWatermark("ts", delay).join(x, "j").groupBy(F.window("ts", period).alias("w"), "i", "j").agg(last)
    return met.select(F.col("w.start").alias("start"), "i", "j", "last.nth", "last.y")


def written_until_now(changes: DataFrame, path: str, mode: str = "update") -> None:
    """Writes what has changed below path/changes, from where the last call for this path ended."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    query = changes.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def summed(spark: SparkSession, path: str, schema: str = "i long, j long, nth long, y double") -> DataFrame:
    """(i, y) after all that written_until_now() has written of latest(); with a start in the schema, (start, i, y) of closed()."""
    changes = spark.read.schema(schema).parquet(f"{path}/changes")
    keys = [c for c in changes.columns if c in ("start", "i")]
    last = changes.groupBy(*keys, "j").agg(F.max(F.struct("nth", "y"))["y"].alias("y"))
    return last.groupBy(*keys).agg(F.sum("y").alias("y"))
