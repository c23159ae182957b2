"""Products of a sparse matrix with a vector or with many at once.

The plan is an equi-join on the inner index and a sum by row, which Spark aggregates partially before
the shuffle. Products are linear, so entries of equal coordinates need not be added up before. Spark broadcasts a vector that it knows to be small and otherwise joins by shuffle; no
side is broadcast unasked.

With `parts`, a number of tasks that grows with the entries as of running.tasks(), entries meet the right side in as many tasks and rows are
added up in as many, so that neither takes more of a task's memory on a larger matrix; there are no partial sums then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripmill.operators.coo import Matrix, domain


def _dealt(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    return df.repartition(parts, *by) if parts else df


def spmv(entries: DataFrame, x: DataFrame, keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """(keys, i, y) of the rows that meet x (j, x); keys, such as matrix_id, keep several matrices apart."""
    met = _dealt(entries.where("v <> 0"), parts, "j").join(_dealt(x, parts, "j"), "j")
    terms = _dealt(met.select(*keys, "i", (F.col("v") * F.col("x")).alias("y")), parts, *keys, "i")
    return terms.groupBy(*keys, "i").agg(F.sum("y").alias("y"))


def zero_filled(y: DataFrame, rows: int) -> DataFrame:
    """(i, y) with a row for every row of the matrix."""
    all_ = domain(y.sparkSession, rows, "r")
    return all_.join(y, all_["r"] == y["i"], "left").select(F.col("r").alias("i"), F.coalesce("y", F.lit(0.0)).alias("y"))


def spmv_full(matrix: Matrix, x: DataFrame, parts: int | None = None) -> DataFrame:
    return zero_filled(spmv(matrix.df, x, parts=parts), matrix.rows)


def spmm(entries: DataFrame, x: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, k, y) for a right matrix (j, k, x); of any width."""
    return entries.where("v <> 0").join(x, "j").groupBy(*keys, "i", "k").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def spmm_wide(entries: DataFrame, x: DataFrame, width: int, keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """As spmm, with the right matrix's rows as arrays (j, xs): the join moves each row once, and
    one shuffled row for each i carries a sum per column. With `parts`, entries of one place are added up where they
    meet the right side, and each moves its row on to where its row of the matrix is added up."""
    sums = [F.sum(F.col("v") * F.element_at("xs", k + 1).cast("double")).alias(f"y{k}") for k in range(width)]
    entries = _dealt(entries.where("v <> 0"), parts, "j")
    if parts:
        entries = entries.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))
    met = entries.join(_dealt(x, parts, "j"), "j").select(*keys, "i", "v", "xs")
    wide = _dealt(met, parts, *keys, "i").groupBy(*keys, "i").agg(*sums)
    return wide.select(*keys, "i", F.posexplode(F.array(*[f"y{k}" for k in range(width)])).alias("k", "y")).select(*keys, "i", F.col("k").cast("long").alias("k"), "y")
