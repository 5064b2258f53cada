"""Fixed-lag smoothing of a stream: a lag buffer in keyed state and event-time timers.

Rows of a user wait until the watermark has passed their time plus the lag, so rows that arrive late (within the watermark) still take part,
in their place.  Then each is smoothed by all rows up to the lag behind it and given out once.  State per user is the filter's
state at the last row given out and the rows of about one lag and one watermark.

Needs the RocksDB state store: set ``spark.sql.streaming.stateStore.providerClass`` to :data:`STORE`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators import kernels as K

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "user_id long, event_id long, t double, x double, v double"


def filtered(prior: tuple | None, t: np.ndarray, z: np.ndarray, std: float, accel_std: float, velocity_std: float = 15.0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) after each row, from the prior (t, mean, covariance) or the first row."""
    means, covs = np.empty((len(t), 2)), np.empty((len(t), 2, 2))
    for i, (ti, zi) in enumerate(zip(t, z)):
        if prior is None:
            mean, cov = np.array([zi, 0.0]), np.diag([std**2, velocity_std**2])
        else:
            at, mean, cov = prior
            f = K.transition(max(0.0, ti - at), 1)
            mean, cov = f @ mean, f @ cov @ f.T + K.process_noise(max(0.0, ti - at), accel_std, 1)
            gain = cov[:, 0] / (cov[0, 0] + std**2)
            mean, cov = mean + gain * (zi - mean[0]), cov - np.outer(gain, cov[0])
        means[i], covs[i] = mean, cov
        prior = ti, mean, cov
    return means, covs


class LagBuffer(StatefulProcessor):
    def __init__(self, lag_s: float, std: float, accel_std: float):
        self.lag_s, self.std, self.accel_std = lag_s, std, accel_std

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "event_id long", "t double, z double")
        self.prior = handle.getValueState("prior", "t double, mean array<double>, cov array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = self.prior.get()[0] if self.prior.exists() else -np.inf
        for b in rows:
            t = b["ts"].astype("datetime64[ns]").astype("int64").to_numpy() / 1e9
            for i, ti, zi in zip(b["event_id"].tolist(), t.tolist(), b["value"].tolist()):
                if ti >= given:  # a row before one that was given out cannot be placed any more
                    self.rows.updateValue((i,), (ti, zi))
                    self.handle.registerTimer(int((ti + self.lag_s) * 1000) + 1)
        yield pd.DataFrame({"user_id": [], "event_id": [], "t": [], "x": [], "v": []}).astype({"user_id": "int64", "event_id": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        held = sorted((v[0], k[0], v[1]) for k, v in self.rows.iterator())
        ready = sum(t + self.lag_s <= now for t, _, _ in held)
        out = {"user_id": [], "event_id": [], "t": [], "x": [], "v": []}
        if ready:
            t, z = np.array([h[0] for h in held]), np.array([h[2] for h in held])
            prior = self.prior.get() if self.prior.exists() else None
            prior = None if prior is None else (prior[0], np.array(prior[1]), np.array(prior[2]).reshape(2, 2))
            mean, cov = filtered(prior, t, z, self.std, self.accel_std)
            smooth = K.rts(t, mean, cov, self.accel_std, self.lag_s)
            out = {"user_id": [key[0]] * ready, "event_id": [h[1] for h in held[:ready]], "t": t[:ready].tolist(), "x": smooth[:ready, 0].tolist(), "v": smooth[:ready, 1].tolist()}
            for _, i, _ in held[:ready]:
                self.rows.removeKey((i,))
            last = ready - 1
            self.prior.update((float(t[last]), mean[last].tolist(), cov[last].reshape(-1).tolist()))
        yield pd.DataFrame(out).astype({"user_id": "int64", "event_id": "int64"})

    def close(self) -> None:
        pass


def fixed_lag(events: DataFrame, lag_s: float, late: str = "10 minutes", std: float = 10.0, accel_std: float = 0.01) -> DataFrame:
    """Events (user_id, event_id, ts, value) as a stream -> each row smoothed by the rows up to ``lag_s`` seconds behind it, once."""
    schema = _parse_datatype_string(OUT)
    assert isinstance(schema, StructType)
    rows = events.where(F.col("value").isNotNull() & ~F.isnan("value")).withWatermark("ts", late).select("user_id", "event_id", "ts", "value")
    return rows.groupBy("user_id").transformWithStateInPandas(LagBuffer(lag_s, std, accel_std), schema, "Append", "EventTime")
