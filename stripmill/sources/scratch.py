"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether Spark removes what a query shuffled when the query ends; else it stays until the driver collects garbage.
REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir where the cluster names one, else below the warehouse;
    it is removed when the session's JVM ends."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    path = f"{named or spark.conf.get('spark.sql.warehouse.dir')}/table-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)  # what does not exist can't be marked
    files.deleteOnExit(hadoop)
    return path


def kept(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet and read again: later branches read them instead of computing them, and a
    lost executor costs only the work since here. Spark knows the table's size and broadcasts it only
    below spark.sql.autoBroadcastJoinThreshold. What was shuffled for the rows is removed as soon as they are written."""
    path = f"{scratch(df.sparkSession)}/rows"
    conf = df.sparkSession.conf
    before = conf.get(REMOVED, None)
    conf.set(REMOVED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(REMOVED, before) if before is not None else conf.unset(REMOVED)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder of scratch() that nothing will read again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
