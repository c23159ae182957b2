"""Matrices and vectors in the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.operators.coo import Matrices, Matrix, built
from stripmill.operators.running import tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for adding up lines; Parquet tells the number of lines without reading them."""
    return tasks(table(spark, sf_dir, "lineitem").count())


def part_supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, v): quantity of a part from a supplier, a row for each line; lines of equal coordinates add up."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))


def order_part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))


def sizes(spark: SparkSession, sf_dir: str, *keys: tuple[str, str]) -> list[int]:
    """One more than the largest key of each (table, key), found in one job."""
    found = [table(spark, sf_dir, name).agg(F.max(key).alias("n")).select(F.lit(k).alias("k"), "n") for k, (name, key) in enumerate(keys)]
    whole = {r.k: int(r.n) + 1 for r in reduce(DataFrame.unionByName, found).collect()}
    return [whole[k] for k in range(len(keys))]


def part_supplier(spark: SparkSession, sf_dir: str) -> Matrix:
    """Quantity of each part from each supplier."""
    return Matrix(built(part_supplier_lines(spark, sf_dir), line_tasks(spark, sf_dir)), *sizes(spark, sf_dir, ("part", "p_partkey"), ("supplier", "s_suppkey")))


def order_part(spark: SparkSession, sf_dir: str) -> Matrix:
    return Matrix(built(order_part_lines(spark, sf_dir), line_tasks(spark, sf_dir)), *sizes(spark, sf_dir, ("orders", "o_orderkey"), ("part", "p_partkey")))


def supplier_week(spark: SparkSession, sf_dir: str) -> Matrix:
    """Quantity that each supplier shipped in each week since 1992: most cells are filled."""
    week = F.expr("datediff(cast(l_shipdate as date), date'1992-01-01') div 7")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), week.cast("long").alias("j"), F.col("l_quantity").alias("v"))
    columns = lines.agg(F.max("j")).first()[0]
    return Matrix(built(lines), sizes(spark, sf_dir, ("supplier", "s_suppkey"))[0], int(columns or 0) + 1)


def by_flag(spark: SparkSession, sf_dir: str) -> Matrices:
    """The parts x suppliers matrices of the lines with each return flag, which is the matrix_id."""
    rows, columns = sizes(spark, sf_dir, ("part", "p_partkey"), ("supplier", "s_suppkey"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("matrix_id"), F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))
    dims = lines.select("matrix_id").distinct().select("matrix_id", F.lit(rows).cast("long").alias("rows"), F.lit(columns).cast("long").alias("columns"))
    return Matrices(built(lines, line_tasks(spark, sf_dir), ("matrix_id",)), dims)


def customer_part(spark: SparkSession, sf_dir: str) -> Matrix:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("i"))
    entries = lines.join(orders, "l_orderkey").select("i", "j", "v")
    return Matrix(built(entries, line_tasks(spark, sf_dir)), *sizes(spark, sf_dir, ("customer", "c_custkey"), ("part", "p_partkey")))


def user_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in each hour since the start of 2024."""
    hour = F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')) div 3600000000")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("i"), hour.alias("j")).agg(F.count("*").cast("double").alias("v"))


def suppliers_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("j"), (1 + F.col("s_suppkey") % 7).cast("double").alias("x"))


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(j, xs) of the embeddings, a right matrix of their width."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("j"), F.col("embedding").alias("xs"))


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, threads, rep, t): event values by type, as a table of repeated measurements."""
    threads = F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), (F.col("user_id") % 4 + 1).cast("int")).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), threads.alias("threads"), F.col("event_id").alias("rep"), F.col("value").alias("t"))
