"""Helpers shared by the training-data operators."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripmill.operators.running import spread

#: Rows an Arrow batch may hold: with documents of up to megabytes, a batch stays in bounds.
BATCH_ROWS = 256
_FACTORS = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of x."""
    with np.errstate(over="ignore"):
        for factor in _FACTORS:
            x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(33))


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches sent to Python workers, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir where the cluster names one, else one below the warehouse, which
    executors share as well."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            named = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoint-{uuid.uuid4().hex}"
            _at_exit(spark, named)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def _files(spark: SparkSession, path: str):
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return of, of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the session's JVM ends."""
    of, files = _files(spark, path)
    files.mkdirs(of)
    files.deleteOnExit(of)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: a lost executor costs only the work since here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_of_thread = threading.local()


def _scopes() -> list[list[str]]:
    """Open scopes of this thread, with the tables made in each: queries in other threads have their own."""
    if not hasattr(_of_thread, "scopes"):
        _of_thread.scopes = []
    return _of_thread.scopes


def cut_table(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table, so that Spark knows its size: it broadcasts the table only
    below spark.sql.autoBroadcastJoinThreshold and otherwise joins by shuffle. The table goes with the scope
    that it was made in, or with the session's JVM."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _at_exit(spark, path)
    df.write.option("compression", "zstd").parquet(f"{path}/rows")
    if _scopes():
        _scopes()[-1].append(path)
    out = spark.read.schema(df.schema).parquet(f"{path}/rows")
    out._path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables of cut_table() that nothing will read again."""
    for table in tables:
        of, files = _files(table.sparkSession, table._path)
        files.delete(of, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are removed at the end, but for those that the function given here has marked."""
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._path)
        return table

    _scopes().append([])
    try:
        yield keep
    finally:
        for path in _scopes().pop():
            if path not in kept:
                of, files = _files(spark, path)
                files.delete(of, True)
            elif _scopes():
                _scopes()[-1].append(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keys(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns, maps left out: rows with equal ones are the same row, or as good as."""
    of = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(F.lit(seed), *of) for seed in (1, 2)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_share(spark: SparkSession, rows: int) -> int:
    """Rows of one key above which the key is hot: there are fewer than 4 * partitions() such keys."""
    return max(1000, rows // (4 * partitions(spark)))


def joined(rows: DataFrame, key: str, table: DataFrame, of: str) -> DataFrame:
    """rows with the columns of table, null where it has no row for the key; table has one row for each key, a long or a string, and a
    column `hot` that marks keys with more than hot_share() of the rows.

    Hot keys' few rows of the table are broadcast, and the rows that they meet are spread in the join of the others, so
    no key meets in one task."""
    others = [c for c in table.columns if c not in (of, "hot")]
    what = F.struct(*others)
    few = F.broadcast(table.where("hot").select(F.col(of).alias("_hot"), what.alias("_few")))
    many = table.where("not hot").select(F.col(of).alias("_cold"), what.alias("_many"))
    met = rows.join(few, F.col(key) == F.col("_hot"), "left")
    met = met.withColumn("_by", F.when(F.col("_hot").isNotNull(), F.xxhash64(F.monotonically_increasing_id()).cast(rows.schema[key].dataType)).otherwise(F.col(key)))
    met = met.join(many, (F.col("_by") == F.col("_cold")) & F.col("_hot").isNull(), "left").withColumn("_found", F.coalesce("_few", "_many"))
    return met.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in others])


def taken(keyed: DataFrame, names: tuple[str, str], times: DataFrame) -> DataFrame:
    """Rows of keyed, without its columns `names` of row_keys(), as often as the table times (names, n, rows) says: n times
    in all for the `rows` rows that are the same. One of these stands for the others, found by partial
    aggregation, as the same row may stand in a large share of the table."""
    columns = [f"`{c}`" for c in keyed.columns if c not in names]
    n = fresh(keyed, "_n")
    times = times.withColumnRenamed("n", n)
    single, several = times.where("rows = 1").drop("rows"), times.where("rows > 1").drop("rows")
    out = keyed.join(single, list(names)).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*columns)
    if several.isEmpty():
        return out
    each = keyed.join(several, list(names), "left_semi").groupBy(*names).agg(F.first(F.struct(*columns)).alias("row"))
    return out.unionByName(spread(each.join(several, list(names)), F.lit(0).cast("long"), n, n).select("row.*"))


def prefix_sums(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds, for each row, the sum of `value` over the rows before it within `keys`, where rows are
    ordered by (chunk, order).

    Two levels: sums per (keys, chunk) are added up first (a row per chunk, not per document), then
    running sums within each chunk start from there. So no key, however hot, meets in one task.
    """
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_chunk_sum"))
    before = (Window.partitionBy(*keys) if keys else Window).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, chunk, F.coalesce(F.sum("_chunk_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_within", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    cond = rows[chunk].eqNullSafe(base[chunk])
    for k in keys:
        cond = cond & rows[k].eqNullSafe(base[k])
    kept = [rows[c] for c in df.columns]
    return rows.join(base, cond).select(*kept, (rows["_within"] + base["_base"]).alias(out))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs, as a table (node, root) with root the smallest node.

    Alternates large-star and small-star steps until the edges are a star around each smallest
    node. Every step is one partial aggregation and one equi-join; each result is written. No component is
    gathered anywhere, nor are the edges of a large star in one task.
    """
    spark = edges.sparkSession
    now = cut_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, n = None, now.count()
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"), (F.count("*") > hot_share(spark, 2 * n)).alias("hot")).select(F.col("a").alias("u"), F.least("a", "low").alias("m"), "hot")
        large = joined(both.where("b > a"), "a", low, "u").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_table(large.where("a <> b").distinct())
        # here a > b in every row, so a node's neighbours below it are its rows
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, now = now, cut_table(small.where("a <> b").distinct())
        release(before, large)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._path = now._path
            return out
        seen, n = state, state.n
