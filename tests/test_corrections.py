from __future__ import annotations

import random

from pyspark.sql import functions as F

from stripmill.operators.coo import last_wins
from stripmill.operators.product import spmv
from stripmill.streaming.products import closed, latest, summed, written_until_now

SCHEMA = "i long, j long, v double, nth long, ts timestamp"


def entries(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, v double, nth long, s long").selectExpr("i", "j", "v", "nth", "timestamp_seconds(s) as ts")


def test_a_stream_with_corrections_goes_on_after_a_stop(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.randrange(4), float(rng.randrange(1, 50)), n, 1000 + n) for n in range(90)]
    # out of order, and a third of them delivered twice
    first, second = rows[::2] + rows[:15], rows[1::2] + rows[40:60]
    rng.shuffle(first)
    rng.shuffle(second)
    x = spark.range(4).selectExpr("id as j", "cast(id + 1 as double) as x")
    want = lambda given: sorted(map(tuple, spmv(last_wins(entries(spark, given), "nth"), x).collect()))
    got = lambda: sorted(map(tuple, summed(spark, f"{tmp_path}/out").collect()))
    seen = []
    for k, part in enumerate((first, second, [])):
        if part:
            entries(spark, part).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        seen += part
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        # each call is a new stream from the checkpoint; the last one finds nothing new
        written_until_now(latest(stream, x), f"{tmp_path}/out")
        assert got() == want(seen)


def test_periods_are_given_out_once_and_what_is_too_late_is_dropped(spark, tmp_path):
    x = spark.range(2).selectExpr("id as j", "1.0D as x")
    parts = [(0, 0, 5.0, 10, 100), (0, 0, 6.0, 11, 3000), (1, 1, 2.0, 3, 200)], [(0, 0, 8.0, 12, 20_000)], [(0, 1, 7.0, 2, 150), (0, 0, 9.0, 13, 20_001)], [(0, 1, 1.0, 20, 90_000)]
    for rows in parts:
        entries(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        written_until_now(closed(stream, x, "1 hour", "1 hour"), f"{tmp_path}/out", "append")
    got = summed(spark, f"{tmp_path}/out", "start timestamp, i long, j long, nth long, y double").select(F.unix_seconds("start"), "i", "y").collect()
    # the entry of 150 s came when the first hour had been given out; the last hour is still open
    assert sorted(map(tuple, got)) == [(0, 0, 6.0), (0, 1, 2.0), (18_000, 0, 9.0)]


def test_query_equals_its_batch(spark, tmp_path):
    from stripmill.plans.catalogue import streamed_corrections

    rows = [(n, n % 7, 1000.0 * n, (n % 11) / 4) for n in range(200)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s double, value double").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = df.groupBy("user_id", F.hour("ts").alias("h")).agg(F.max_by("value", "event_id").alias("v")).groupBy(F.col("user_id").alias("i")).agg(F.sum(F.round(F.col("v") * 100) * (1 + F.col("h") % 5)).alias("y"))
    assert sorted(map(tuple, streamed_corrections(spark, str(tmp_path)).collect())) == sorted(map(tuple, want.collect()))
