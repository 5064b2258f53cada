"""The lag buffer of a stream against the batch smoother, for shuffled arrivals."""

import numpy as np
from pyspark.sql import functions as F

from tracklume.operators import kernels
from tracklume.streaming import lagged


def test_lag_buffer_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(u, 1000 * u + k, float(t), float(np.sin(t / 40) * 30 + rng.normal())) for u in range(3) for k, t in enumerate(np.sort(rng.uniform(0, 900, 60)))]
    rows.append((9, 999_999, 50_000.0, 0.0))  # moves the watermark past all others
    df = spark.createDataFrame(rows, "user_id long, event_id long, s double, value double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    # arrivals are shuffled by up to 100 seconds and come in six files
    order = sorted(rows[:-1], key=lambda r: r[2] + rng.uniform(0, 100)) + rows[-1:]
    for k in range(6):
        ids = [r[1] for r in order[len(order) * k // 6 : len(order) * (k + 1) // 6]]
        df.where(F.col("event_id").isin(ids)).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, lagged.STORE)
    try:
        stream = spark.readStream.schema("user_id long, event_id long, value double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = lagged.fixed_lag(stream, 60.0, "200 seconds", 2.0, 0.05)
        q = out.writeStream.format("memory").queryName("lagged").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {r.event_id: (r.t, r.x, r.v) for r in spark.table("lagged").collect()}
    finally:
        spark.conf.set(key, old)
    assert spark.table("lagged").count() == len(got) == len(rows) - 1
    for u in range(3):
        own = sorted((r[2], r[1], r[3]) for r in rows if r[0] == u)
        t, z = np.floor(np.array([r[0] for r in own]) * 1e6) / 1e6, np.array([r[2] for r in own])
        mean, cov = lagged.filtered(None, t, z, 2.0, 0.05)
        want = kernels.rts(t, mean, cov, 0.05, 60.0)
        assert np.allclose([got[r[1]][1:] for r in own], want, atol=1e-6)
        assert not np.allclose(want, kernels.rts(t, mean, cov, 0.05))  # the lag matters
