from __future__ import annotations

from stripmill.sources.scratch import REMOVED, kept


def shuffled(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def test_what_was_shuffled_for_a_table_is_removed(spark):
    before = shuffled(spark)
    rows = kept(spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count())
    assert not shuffled(spark) - before
    assert rows.agg({"count": "sum"}).first()[0] == 1000 and spark.conf.get(REMOVED, None) in (None, "false")
