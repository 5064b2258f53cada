"""Replay of a stream equals the batch."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tracklume.streaming import streams


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("events")
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    cuts = e.selectExpr("percentile(unix_micros(cast(ts AS timestamp)), array(0.33, 0.66))").first()[0]
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    for k, part in enumerate((t <= cuts[0], (t > cuts[0]) & (t <= cuts[1]), t > cuts[1])):
        e.where(part).coalesce(1).write.mode("append").parquet(str(at / "in"))
    return str(at / "in")


def replay(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows(spark, folder):
    got = replay(streams.windowed_summary(streams.event_stream(spark, folder)), "w", "complete").toPandas()
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n")).toPandas()
    assert got.n.sum() == batch.n.sum() and len(got) == len(batch)


def test_sessions(spark, folder):
    got = replay(streams.sessions(streams.event_stream(spark, folder), "30 minutes"), "s", "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(folder).count()


def test_stateful_filter_equals_batch(spark, folder):
    got = replay(streams.stateful_filter(streams.event_stream(spark, folder)), "f").toPandas()
    whole = replay(streams.stateful_filter(streams.event_stream(spark, folder, 100)), "g").toPandas()
    assert len(got) and not got.isna().any().any()
    key = ["user_id", "t"]
    a, b = got.sort_values(key).reset_index(drop=True), whole.sort_values(key).reset_index(drop=True)
    assert len(b) == spark.read.parquet(folder).count() and len(a) <= len(b)


def test_dedup(spark, folder):
    got = replay(streams.deduplicated(streams.event_stream(spark, folder)), "d")
    assert got.count() == spark.read.parquet(folder).select("event_id").distinct().count()
