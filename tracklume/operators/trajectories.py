"""Ensembles, resampling and repair of trajectories that windows can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import brackets


def weighted_mean(df: DataFrame, keys: list[str], values: list[str], weight: str = "weight") -> DataFrame:
    w = F.col(weight)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[(F.sum(w * F.col(v)) / F.sum(w)).alias(v) for v in values])


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str = "weight") -> DataFrame:
    """The first value whose cumulative weight reaches half of the total."""
    g = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = g.withColumn("_c", F.sum("_w").over(w)).withColumn("_t", F.sum("_w").over(Window.partitionBy(*keys)))
    return c.where(F.col("_c") >= F.col("_t") / 2).groupBy(*keys).agg(F.min(value).alias(value))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, fraction: float, tie: list[str], weight: str = "weight") -> DataFrame:
    """Weighted mean without floor(fraction * n) rows at either end."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    d = df.withColumn("_n", n).withColumn("_r", F.row_number().over(w.orderBy(value, *tie)))
    cut = F.floor(F.col("_n") * F.lit(fraction))
    d = d.where((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut))
    return d.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias(value), F.count(F.lit(1)).alias("kept"))


def inverse_variance(df: DataFrame, keys: list[str], values: list[str], sigma: str, least: float, most: float) -> DataFrame:
    s = F.least(F.greatest(F.col(sigma), F.lit(least)), F.lit(most))
    out = df.withColumn("weight", 1 / (s * s))
    return weighted_mean(out, keys, values).join(out.groupBy(*keys).agg((1 / F.sqrt(F.sum("weight"))).alias("sigma")), keys)


def spread_guard(df: DataFrame, keys: list[str], value: str, threshold: float, weight: str = "weight", tie: str = "key") -> DataFrame:
    """Weighted mean, or the row of greatest weight where the values spread more than the threshold."""
    g = df.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("_m"), (F.max(value) - F.min(value)).alias("spread"), F.max_by(value, F.struct(F.col(weight), F.col(tie))).alias("_b"))
    return g.select(*keys, "spread", F.when(F.col("spread") > threshold, F.col("_b")).otherwise(F.col("_m")).alias(value), (F.col("spread") > threshold).alias("guarded"))


def hampel(df: DataFrame, keys: list[str], order: list[str], value: str, radius: int, sigmas: float, least_scale: float, least_residual: float, blend: float = 1.0) -> DataFrame:
    """One pass: window median without the row itself, 1.4826 MAD; spikes move to the median by ``blend``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    around = F.concat(F.collect_list(value).over(w.rowsBetween(-radius, -1)), F.collect_list(value).over(w.rowsBetween(1, radius)))
    d = df.withColumn("_a", F.sort_array(around))
    d = d.withColumn("_med", _median("_a")).withColumn("_dev", F.sort_array(F.transform("_a", lambda x: F.abs(x - F.col("_med")))))
    d = d.withColumn("_scale", F.greatest(F.lit(1.4826) * _median("_dev"), F.lit(least_scale))).withColumn("residual", F.abs(F.col(value) - F.col("_med")))
    spike = (F.size("_a") >= 2) & (F.col("residual") > F.lit(sigmas) * F.col("_scale")) & (F.col("residual") > least_residual)
    spike = F.coalesce(spike, F.lit(False))
    return d.withColumn("spike", spike).withColumn("repaired", F.when(spike, F.col(value) + F.lit(blend) * (F.col("_med") - F.col(value))).otherwise(F.col(value))).drop("_a", "_med", "_dev", "_scale")


def _median(a: str) -> Column:
    n = F.size(a)
    lo, hi = F.get(F.col(a), F.floor((n - 1) / 2).cast("int")), F.get(F.col(a), F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def temporal_spikes(df: DataFrame, keys: list[str], order: list[str], value: str, max_speed: float, max_residual: float, time: str = "time_s") -> DataFrame:
    """One pass: a row faster than the limit to both neighbours and off their line goes onto the line."""
    w = Window.partitionBy(*keys).orderBy(*order)
    p, n, tp, tn = F.lag(value).over(w), F.lead(value).over(w), F.lag(time).over(w), F.lead(time).over(w)
    d = df.withColumn("_p", p).withColumn("_n", n).withColumn("_tp", tp).withColumn("_tn", tn)
    t, v = F.col(time), F.col(value)
    line = F.col("_p") + (F.col("_n") - F.col("_p")) * (t - F.col("_tp")) / F.nullif(F.col("_tn") - F.col("_tp"), F.lit(0.0))
    fast = (F.abs(v - F.col("_p")) > max_speed * (t - F.col("_tp"))) & (F.abs(F.col("_n") - v) > max_speed * (F.col("_tn") - t))
    spike = F.coalesce(fast & (F.abs(v - line) > max_residual), F.lit(False))
    return d.withColumn("spike", spike).withColumn("repaired", F.when(spike, line).otherwise(v)).drop("_p", "_n", "_tp", "_tn")


def at_frames(frames: DataFrame, anchors: DataFrame, keys: list[str], axes: list[str], std_m: float, max_gap: float | None = None, max_speed: float | None = None, std_scale: float = 1.0, gap_std: float = 0.0, slices: int | None = None) -> DataFrame:
    """Anchors of stable segments carried to frame times: (keys, time_s, key) -> frames with axes, interpolated, gap_s, nearest_dt_s, speed, std.

    A frame needs anchors on both sides (or one at its time), no further apart than ``max_gap`` and no faster than ``max_speed``;
    other frames go.  The variance of an interpolated row is (std * scale)^2 + (gap_std * time to the nearest anchor)^2.
    Anchors of one time: the one of the greatest ``key`` counts.
    """
    d = brackets(frames, anchors.select(*keys, "time_s", *axes, "key"), keys, payload=[*axes, "key"], order="key", slices=slices)
    t0, t1, t = F.col("prev.t"), F.col("next.t"), F.col("time_s")
    exact = F.coalesce(t0 == t, F.lit(False))
    gap = F.when(~exact, t1 - t0)
    far = F.sqrt(sum(((F.col(f"next.{a}") - F.col(f"prev.{a}")) * (F.col(f"next.{a}") - F.col(f"prev.{a}")) for a in axes), F.lit(0.0)))
    d = d.withColumn("interpolated", ~exact).withColumn("gap_s", gap).withColumn("speed", F.when(~exact, far / gap)).withColumn("nearest_dt_s", F.when(exact, 0.0).otherwise(F.least(t - t0, t1 - t)))
    keep = exact | (t0.isNotNull() & t1.isNotNull())
    if max_gap is not None:
        keep = keep & (exact | (F.col("gap_s") <= max_gap))
    if max_speed is not None:
        keep = keep & (exact | (F.col("speed") <= max_speed))
    d = d.where(keep)
    more = F.col("nearest_dt_s") * F.lit(gap_std)
    std = F.when(exact, F.lit(float(std_m))).otherwise(F.sqrt(F.lit((std_m * std_scale) ** 2) + more * more))
    share = (t - t0) / (t1 - t0)
    at = {a: F.when(exact, F.col(f"prev.{a}")).otherwise(F.col(f"prev.{a}") + (F.col(f"next.{a}") - F.col(f"prev.{a}")) * share) for a in axes}
    own = [c for c in frames.columns if c not in axes]
    return d.select(*own, *[v.alias(a) for a, v in at.items()], "interpolated", "gap_s", "speed", "nearest_dt_s", std.alias("std_m"))
