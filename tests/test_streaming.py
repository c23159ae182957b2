from __future__ import annotations

from stripmill.operators.product import spmv
from stripmill.streaming.products import running_spmv


def test_stream_equals_batch(spark, tmp_path):
    schema = "i long, j long, v double"
    entries = spark.range(60).selectExpr("id % 7 as i", "id % 5 as j", "cast(id as double) as v")
    entries.repartition(3).write.parquet(f"{tmp_path}/in")
    x = spark.range(5).selectExpr("id as j", "cast(id + 1 as double) as x")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = running_spmv(stream, x).writeStream.outputMode("complete").format("memory").queryName("y").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("y").collect())) == sorted(map(tuple, spmv(entries, x).collect()))
