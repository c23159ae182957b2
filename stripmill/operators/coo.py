"""Coordinate matrices: rows (i, j, v), absent means zero, duplicates add up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.operators.running import running_sum, spread


@dataclass(frozen=True)
class Matrix:
    """A coordinate DataFrame (i long, j long, v double) with its dimensions, which the entries alone
    do not tell: last rows or columns may be empty."""

    df: DataFrame
    rows: int
    columns: int


@dataclass(frozen=True)
class Matrices:
    """Many matrices in one table: entries (matrix_id, i, j, v) and their dimensions (matrix_id, rows, columns)."""

    df: DataFrame
    dims: DataFrame


#: The columns that keep the matrices of Matrices apart.
KEYS = ("matrix_id",)


def from_dense(spark: SparkSession, values: list[list[float]]) -> Matrix:
    found = [(i, j, float(v)) for i, row in enumerate(values) for j, v in enumerate(row) if v]
    return Matrix(spark.createDataFrame(found, "i long, j long, v double"), len(values), len(values[0]) if values else 0)


def built(entries: DataFrame, parts: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each coordinate: duplicates add up, in as many tasks as `parts` says, or in Spark's own number of them."""
    dealt = entries.repartition(parts, *keys, "i", "j") if parts else entries
    return dealt.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def distinct(entries: DataFrame) -> DataFrame:
    """Without exact duplicates of a whole triple."""
    return entries.select("i", "j", "v").distinct()


def last_wins(entries: DataFrame, order: str) -> DataFrame:
    """One row for each coordinate: of duplicates the last by the column `order`, of equally late ones the largest."""
    return entries.groupBy("i", "j").agg(F.max(F.struct(order, "v"))["v"].alias("v"))


def nonzero(entries: DataFrame) -> DataFrame:
    return entries.where("v <> 0")


def pattern(entries: DataFrame) -> DataFrame:
    """1 wherever there is a nonzero."""
    return nonzero(entries).select("i", "j", F.lit(1.0).alias("v"))


def transposed(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def symmetrized(entries: DataFrame, sign: float = 1.0) -> DataFrame:
    """Entries of one triangle mirrored; the diagonal stays single. sign -1 for skew symmetry."""
    off = entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * sign).alias("v"))
    return entries.select("i", "j", "v").unionByName(off)


def checked(matrix: Matrix) -> DataFrame:
    """The entries; the query fails if one is outside the matrix."""
    inside = (F.col("i") >= 0) & (F.col("i") < matrix.rows) & (F.col("j") >= 0) & (F.col("j") < matrix.columns)
    outside = F.raise_error(F.concat(F.lit("entry outside the matrix: "), F.col("i").cast("string"), F.lit(", "), F.col("j").cast("string")))
    return matrix.df.withColumn("v", F.when(inside, F.col("v")).otherwise(outside.cast("double")))


def counts(entries: DataFrame, axis: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k, nnz) of the rows (axis i) or columns (axis j) that have nonzeros."""
    return nonzero(entries).groupBy(*keys, F.col(axis).alias("k")).agg(F.count("*").alias("nnz"))


def domain(spark: SparkSession, n: int, name: str = "k") -> DataFrame:
    return spark.range(n).select(F.col("id").alias(name))


def slices(matrix: Matrix | Matrices, axis: str, name: str = "k") -> DataFrame:
    """A row for each row (axis i) or column (axis j) of the matrix, or of each of the matrices."""
    of = "rows" if axis == "i" else "columns"
    if isinstance(matrix, Matrix):
        return domain(matrix.df.sparkSession, getattr(matrix, of), name)
    return spread(matrix.dims, F.lit(0).cast("long"), of, name).select(*KEYS, name)


def keys_of(matrix: Matrix | Matrices) -> tuple[str, ...]:
    return KEYS if isinstance(matrix, Matrices) else ()


def row_pointers(matrix: Matrix) -> DataFrame:
    """CSR row pointers (i, ptr) for i from 0 to the number of rows."""
    n = matrix.df.sparkSession
    ends = matrix.df.groupBy((F.col("i") + 1).alias("at")).agg(F.count("*").alias("n"))
    all_ = domain(n, matrix.rows + 1, "i")
    rows = all_.join(ends, all_["i"] == ends["at"], "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))
    return running_sum(rows, "i", "n", "ptr").select("i", "ptr")
