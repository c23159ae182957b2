"""Timings, work distribution and label rules."""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEATURES = ("dim1", "dim2", "density")
#: Ranges that a group's values are cut into for finding a rank.
PARTS = 64


def ranked(rows: DataFrame, keys: tuple[str, ...], at: dict[str, str], value: str = "t") -> DataFrame:
    """(keys, total, names) with the value that has a given rank in its group: `at` names ranks from 0 as SQL over `total`.

    In two levels: values, counted once each, go to PARTS ranges cut at approximate quantiles, whose counts say
    in which range a rank lies; only inside a range are values put in order, so no group meets in one task."""
    share = ",".join(str(k / PARTS) for k in range(1, PARTS))
    same = lambda names: " AND ".join(f"{k} <=> _{k}" for k in names) or "true"
    as_ = [F.col(k).alias(f"_{k}") for k in keys]
    counted = rows.where(f"{value} IS NOT NULL").groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("n"))
    groups = rows.where(f"{value} IS NOT NULL").groupBy(*as_).agg(F.expr(f"percentile_approx({value}, array({share}), 1000)").alias("edges"), F.count("*").alias("total"))
    placed = counted.join(groups, F.expr(same(keys))).drop(*[f"_{k}" for k in keys]).withColumn("range", F.expr("size(filter(edges, e -> e < x))")).drop("edges")
    ranges = placed.groupBy(*as_, F.col("range").alias("_range"), F.col("total").alias("_total")).agg(F.sum("n").alias("many"))
    before = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("many").over(before), F.lit(0)))
    met = placed.join(ranges, F.expr(f"{same(keys)} AND range = _range"))
    wanted = " OR ".join(f"({e.replace('total', '_total')}) >= before AND ({e.replace('total', '_total')}) < before + many" for e in at.values())
    inside = Window.partitionBy(*keys, "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    upto = met.where(wanted).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    return upto.groupBy(*keys, "total").agg(*[F.max(F.when(F.expr(f"({e}) >= upto - n AND ({e}) < upto"), F.col("x"))).alias(name) for name, e in at.items()])


def _between(share: float) -> tuple[dict[str, str], Column]:
    """Ranks and expression of an interpolated percentile."""
    position = f"({share}D * (total - 1))"
    name = f"p{round(share * 100)}"
    low, high = f"{name}_low", f"{name}_high"
    return {low: f"floor({position})", high: f"ceil({position})"}, F.expr(f"{low} + ({high} - {low}) * ({position} - floor({position}))")


def medians(timings: DataFrame, *keys: str) -> DataFrame:
    """(keys, median_t, upper_median_t): the interpolated median, and the element above the middle."""
    at, median = _between(0.5)
    found = ranked(timings, keys, at | {"upper": "total div 2"})
    return found.select(*keys, median.alias("median_t"), F.col("upper").alias("upper_median_t"))


def trimmed(timings: DataFrame, *keys: str, least: int = 10) -> DataFrame:
    """(keys, n, mean_t): the mean between the 10th and 90th percentile, both included; groups of
    fewer than `least` points keep all."""
    low_at, low = _between(0.1)
    high_at, high = _between(0.9)
    ends = ranked(timings, keys, low_at | high_at).select(*[F.col(k).alias(f"_{k}") for k in keys], low.alias("lo"), high.alias("hi"), F.col("total").alias("points"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    kept = timings.join(ends, cond).where((F.col("points") < least) | F.col("t").between(F.col("lo"), F.col("hi")))
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("t").alias("mean_t"))


def pivoted(results: DataFrame, threads: list[int]) -> DataFrame:
    """(name, t_1, t_2, ...): a column for each number of threads, N/A where there is no result."""
    wide = results.groupBy("name").pivot("threads", threads).agg(F.first("t"))
    return wide.select("name", *[F.coalesce(F.col(str(t)).cast("string"), F.lit("N/A")).alias(f"t_{t}") for t in threads])


def without_errors(results: DataFrame, column: str) -> DataFrame:
    return results.where(~F.col(column).contains("ERROR"))


def not_evaluated(all_: DataFrame, evaluated: DataFrame, on: str) -> DataFrame:
    return all_.join(evaluated.select(on), on, "left_anti")


def sized(matrices: DataFrame, least: int = 10_000, most: int = 20_000_000) -> DataFrame:
    """(matrix_id, nnz) of the matrices whose nonzeros are in range, from (matrix_id, i, j, v)."""
    return matrices.groupBy("matrix_id").agg(F.count("*").alias("nnz")).where(F.col("nnz").between(least, most))


def differing(left: DataFrame, right: DataFrame, on: str, value: str) -> DataFrame:
    """(on, left_value, right_value) where two results differ or one has no row: results of
    different length are not equal."""
    a = left.select(F.col(on).alias("_a"), F.col(value).alias("left_value"))
    b = right.select(F.col(on).alias("_b"), F.col(value).alias("right_value"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value"))).select(F.coalesce("_a", "_b").alias(on), "left_value", "right_value")


def even_distribution(items: DataFrame, order: str, parts: int) -> DataFrame:
    """Items with `part` (from 0): contiguous parts, the first of which take one more if it does not go
    even. Meant for lists of files or matrices; the numbering is one task's."""
    return items.withColumn("part", F.ntile(parts).over(Window.orderBy(order)).cast("long") - 1)


def least_loaded(work: list[int], parts: int) -> list[list[int]]:
    """Indices dealt to parts, largest work first to the least loaded (the first of equals); items
    without work are dropped, and there are no more parts than items."""
    items = sorted((-w, k) for k, w in enumerate(work) if w)
    out: list[list[int]] = [[] for _ in range(min(len(items), parts))]
    loads = [(0, part) for part in range(len(out))]
    for minus, k in items:
        load, part = heappop(loads)
        out[part].append(k)
        heappush(loads, (load - minus, part))
    return out


def dealt(work: DataFrame, item: str, parts: int) -> DataFrame:
    """(item, work, part) of the rows (item, work) that have work, dealt as least_loaded() does, items of equal work in order.

    One choice depends on all before it, so the rows, one for each row strip of a matrix, come to the driver."""
    rows = work.where("work > 0").select(F.col(item).cast("long"), F.col("work").cast("long")).orderBy(item).collect()
    found = [(rows[k][0], rows[k][1], part) for part, members in enumerate(least_loaded([r[1] for r in rows], parts)) for k in members]
    return work.sparkSession.createDataFrame(found, f"{item} long, work long, part long")


def labelled(training: DataFrame, speedup: float = 1.3) -> DataFrame:
    """Adds density and target to (dim1, dim2, perc_zeros, nnz, csr_time, block_time): 1 where
    storing the block densely is faster by `speedup`, once the start-up time is taken off, but 0 for
    blocks too sparse, too small or too narrow for the measurement to count."""
    startup = training.where((F.col("dim1") == 1) & (F.col("dim2") == 1) & (F.col("nnz") == 0)).agg(F.min("csr_time").alias("startup"))
    rows = training.crossJoin(F.broadcast(startup))  # one row
    faster = (F.col("csr_time") - F.col("startup")) / F.col("block_time") >= speedup
    density = 100 - F.col("perc_zeros")
    target = F.when((density <= 25) | (F.col("nnz") < 800) | ((F.col("dim2") == 1) & (F.col("dim1") < 1300)), 0).otherwise(faster.cast("int"))
    return rows.select(*training.columns, density.alias("density"), target.alias("target"))


def parameter_grid(spark: SparkSession, heights: list[int], widths: list[int], zeros: list[int]) -> DataFrame:
    """(dim1, dim2, perc_zeros, nnz): every combination, with the number of nonzeros to expect."""
    grid = spark.range(1).select()
    for name, values in (("dim1", heights), ("dim2", widths), ("perc_zeros", zeros)):
        grid = grid.select("*", F.explode(F.array(*[F.lit(v).cast("long") for v in values])).alias(name))
    return grid.withColumn("nnz", F.expr("(dim1 * dim2 * (100 - perc_zeros)) div 100"))


def trained(rows: DataFrame, seed: int = 42, trees: int = 20) -> tuple[PipelineModel, float]:
    """A forest that tells dense blocks by FEATURES, and its mean squared error on a held-out fifth. A hash of the row decides which rows
    these are, so they don't depend on how the rows lie in partitions; equal rows are on one side."""
    held_out = F.pmod(F.xxhash64(F.lit(seed), *FEATURES, "target"), F.lit(5)) == 0
    train, test = rows.where(~held_out), rows.where(held_out)
    forest = RandomForestClassifier(featuresCol="features", labelCol="target", numTrees=trees, seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(train)
    found = model.transform(test).select("prediction", F.col("target").cast("double").alias("target"))
    error = RegressionEvaluator(predictionCol="prediction", labelCol="target", metricName="mse").evaluate(found) if found.head(1) else 0.0
    return model, error


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def forest_sql(spark: SparkSession, path: str) -> str:
    """A saved forest as an SQL condition on FEATURES: whether the trees' shares for dense outweigh those against. It needs no model where it
    runs, and Spark compiles it with the rest of its stage. Of the forest's nodes, as many as it was given room for, all come to the driver."""
    trees: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/stages/*RandomForest*/data").collect():
        trees.setdefault(row.treeID, {})[row.nodeData.id] = row.nodeData

    def written(nodes: dict[int, object], at: int) -> str:
        node = nodes[at]
        if node.leftChild < 0:
            against, for_ = node.impurityStats
            return f"{(for_ - against) / (for_ + against)!r}D"
        name, most = FEATURES[node.split.featureIndex], node.split.leftCategoriesOrThreshold[0]
        return f"CASE WHEN {name} <= {most!r}D THEN {written(nodes, node.leftChild)} ELSE {written(nodes, node.rightChild)} END"

    return " + ".join(f"({written(nodes, 0)})" for _, nodes in sorted(trees.items())) + " > 0"


def classified_by_sql(blocks: DataFrame, rule: str) -> DataFrame:
    """As classified(), by a condition of forest_sql()."""
    shaped = blocks.withColumns({"dim1": F.col("r1") - F.col("r0"), "dim2": F.col("c1") - F.col("c0"), "density": F.col("nnz") * 100.0 / F.col("size")})
    return shaped.withColumn("is_dense", F.expr(rule)).select(*blocks.columns, "is_dense")


def classified(blocks: DataFrame, model: PipelineModel) -> DataFrame:
    """Blocks with is_dense as the model says from height, width and percentage of nonzeros."""
    shaped = blocks.withColumns({"dim1": F.col("r1") - F.col("r0"), "dim2": F.col("c1") - F.col("c0"), "density": F.col("nnz") * 100.0 / F.col("size")})
    return model.transform(shaped).select(*blocks.columns, (F.col("prediction") == 1).alias("is_dense"))
