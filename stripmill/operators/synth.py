"""Synthetic block matrices, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripmill.functions.scatter import scattered
from stripmill.operators.coo import Matrix
from stripmill.operators.partition import strips_random, strips_uniform
from stripmill.operators.running import spread

#: Ones in a sparse block.
SPARSE_ONES = 10


def generated(spark: SparkSession, rows: int, columns: int, row_parts: int, column_parts: int, dense: int, percent_zeros: int, sparse: int, uniform: bool = True, seed: int = 0) -> tuple[Matrix, DataFrame, DataFrame]:
    """A matrix with `dense` blocks that have exactly the given percentage of zeros and `sparse`
    blocks of SPARSE_ONES ones, with its row and column strips."""
    total = row_parts * column_parts
    if dense + sparse > total:
        raise ValueError("more blocks asked for than there are")
    if rows % row_parts or columns % column_parts:
        raise ValueError("strips do not divide the matrix")
    cut = strips_uniform if uniform else lambda s, n, p: strips_random(s, n, p, seed)
    high, wide = cut(spark, rows, row_parts), cut(spark, columns, column_parts)
    by = scattered("id", seed + 1)
    chosen = spark.range(total).orderBy(by, "id").limit(dense + sparse)
    ranked = chosen.join(spark.range(total).orderBy(by, "id").limit(dense).withColumn("first", F.lit(True)), "id", "left").select("id", F.col("first").isNotNull().alias("is_dense"))
    placed = ranked.select("id", "is_dense", F.expr(f"id div {column_parts}").alias("a"), (F.col("id") % column_parts).alias("b"))
    placed = placed.join(high.select(F.col("strip").alias("a"), F.col("lo").alias("r0"), F.col("hi").alias("r1")), "a").join(wide.select(F.col("strip").alias("b"), F.col("lo").alias("c0"), F.col("hi").alias("c1")), "b")
    size = (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))
    ones = F.when(F.col("is_dense"), size - F.expr(f"((r1 - r0) * (c1 - c0) * {percent_zeros}) div 100")).otherwise(F.least(F.lit(SPARSE_ONES), size))
    cells = spread(placed.withColumn("ones", ones), F.lit(0).cast("long"), size, "pos")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(scattered("pos", f"id + {seed}"), "pos"))
    kept = cells.withColumn("nth", nth).where(F.col("nth") <= F.col("ones"))
    df = kept.select((F.col("r0") + F.col("pos") % (F.col("r1") - F.col("r0"))).alias("i"), (F.col("c0") + F.expr("pos div (r1 - r0)")).alias("j"), F.lit(1.0).alias("v"))
    return Matrix(df, rows, columns), high, wide


def constant_vector(spark: SparkSession, n: int, value: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("j"), F.lit(value).alias("x"))


def constant_matrix(spark: SparkSession, n: int, width: int, value: float = 1.0) -> DataFrame:
    return spark.range(n * width).select(F.expr(f"id div {width}").alias("j"), (F.col("id") % width).alias("k"), F.lit(value).alias("x"))
