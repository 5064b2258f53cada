"""Structured Streaming versions: windowed summaries, sessions, and a stateful filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import kernels as K

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as a stream, with event time ``ts``."""
    d = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_summary(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and errors per window and type; rows later than the watermark are dropped by the engine."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max")).select(F.col("w.start").alias("start"), "event_type", "n", "mean", "max")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Segments of a user's events, split where the gap passes."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


STATE = "t double, mean array<double>, cov array<double>"
OUT = "user_id long, t double, x double, v double, nis double"


def stateful_filter(events: DataFrame, std: float = 10.0, accel_std: float = 0.01, age_out_ms: int = 30 * 86_400_000, late: str = "10 minutes") -> DataFrame:
    """Constant-velocity filter per user across batches.  A batch's rows are taken in time order; rows
    older than the state are refused; a user without rows for the age-out, in event time, loses the state."""

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        t = rows["ts"].astype("datetime64[ns]").astype("int64").to_numpy() / 1e9
        z = rows["value"].to_numpy(float)
        out = []
        now, mean, cov = (state.get[0], np.array(state.get[1]), np.array(state.get[2]).reshape(2, 2)) if state.exists else (None, None, None)
        for ti, zi in zip(t, z):
            nis = 0.0
            if mean is None:
                mean, cov = np.array([zi, 0.0]), np.diag([std**2, 225.0])
            else:
                if ti < now:
                    continue
                f = K.transition(ti - now, 1)
                mean, cov = f @ mean, f @ cov @ f.T + K.process_noise(ti - now, accel_std, 1)
                r, s = zi - mean[0], cov[0, 0] + std**2
                nis = float(r * r / s)
                gain = cov[:, 0] / s
                mean, cov = mean + gain * r, cov - np.outer(gain, cov[0])
            now = ti
            out.append((key[0], now, mean[0], mean[1], nis))
        state.update((float(now), mean.tolist(), cov.reshape(-1).tolist()))
        state.setTimeoutTimestamp(max(int(now * 1000) + age_out_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "t", "x", "v", "nis"])

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
