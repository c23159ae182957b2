from __future__ import annotations

from pyspark.sql import functions as F

from stripmill.operators import evaluation as E


def test_a_forest_as_a_condition_says_what_the_model_says(spark, tmp_path):
    rows = spark.range(3000).selectExpr("40 + id * 7 % 160 AS dim1", "1 + id * 11 % 90 AS dim2", "id * 13 % 101 AS density").withColumn("target", ((F.col("density") * F.col("dim2") > 2000) | (F.col("dim1") % 9 == 0)).cast("int"))
    model, error = E.trained(rows, trees=7)
    assert 0 <= error < 0.3
    E.save_model(model, f"{tmp_path}/forest")
    rule = E.forest_sql(spark, f"{tmp_path}/forest")
    said = model.transform(rows).select((F.col("prediction") == 1).alias("model"), F.expr(rule).alias("sql"))
    found = {tuple(r[:2]): r[2] for r in said.groupBy("model", "sql").count().collect()}
    assert set(found) == {(True, True), (False, False)} and min(found.values()) > 100
    blocks = rows.selectExpr("0L AS r0", "dim1 AS r1", "0L AS c0", "dim2 AS c1", "density AS nnz", "100L AS size")
    same = E.classified(blocks, model).exceptAll(E.classified_by_sql(blocks, rule))
    assert same.count() == 0


def test_held_out_rows_do_not_depend_on_partitions(spark):
    rows = spark.range(800).selectExpr("id % 40 AS dim1", "id % 17 AS dim2", "id % 100 AS density").withColumn("target", (F.col("density") > 50).cast("int"))
    assert E.trained(rows.repartition(3), trees=2)[1] == E.trained(rows.repartition(7), trees=2)[1]
