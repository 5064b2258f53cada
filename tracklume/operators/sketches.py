"""Mergeable quantile sketches: counts of logarithmic buckets.

A value v > 0 falls into bucket ceil(log(v) / log(gamma)), gamma = (1 + a) / (1 - a); negative values mirror
that, zero has a bucket of its own.  A sketch is rows (keys, side, bucket, n): sketches merge by adding counts, in
any order, and state per group is bounded by the range of the values, not by their number (about
115 buckets a factor of ten at a = 0.01).  A quantile is found at its exact rank, and its value is within the
share ``a`` of the true one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACCURACY = 0.01


def gamma_of(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def bucket_of(value: Column, accuracy: float = ACCURACY) -> Column:
    return F.when(value == 0, 0).otherwise(F.ceil(F.log(F.abs(value)) / F.lit(math.log(gamma_of(accuracy))))).cast("int")


def sketch(df: DataFrame, keys: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """(keys, side, bucket, n); null, NaN and infinite values are left out."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.groupBy(*keys, F.signum(v).cast("int").alias("side"), bucket_of(v, accuracy).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "side", "bucket").agg(F.sum("n").alias("n"))


def _value(accuracy: float, edge: bool) -> Column:
    """A bucket's middle, or the edge that none of its values exceeds."""
    g = gamma_of(accuracy)
    size = F.pow(F.lit(g), F.col("bucket").cast("double"))
    if edge:
        return F.when(F.col("side") > 0, size).when(F.col("side") < 0, -size / g).otherwise(0.0)
    return F.col("side") * size * (2 / (1 + g))


def at_ranks(sketches: DataFrame, keys: list[str], ranks: dict[str, Column], accuracy: float = ACCURACY, edge: bool = False) -> DataFrame:
    """(keys, n, a column for each rank): the value at rank r of the n values in rising order; ranks are expressions of ``n``."""
    order = Window.partitionBy(*keys).orderBy(F.col("side"), F.col("side") * F.col("bucket"))
    whole = Window.partitionBy(*keys)
    rows = sketches.withColumn("_to", F.sum("n").over(order)).withColumn("_from", F.col("_to") - F.col("n")).withColumn("n", F.sum("n").over(whole))
    value = _value(accuracy, edge)
    picks = [F.max(F.when((F.col("_from") < r) & (r <= F.col("_to")), value)).alias(name) for name, r in ranks.items()]
    return rows.groupBy(*keys).agg(F.first("n").alias("n"), *picks)


def rank_of(q: float) -> Column:
    """The nearest rank of a quantile."""
    return F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))


def error_summary(df: DataFrame, keys: list[str], error: str, quantiles: tuple = (0.5, 0.95), accuracy: float = ACCURACY) -> DataFrame:
    """Per key: count, mean, population std, RMSE, MAE, maximum, and sketched quantiles ``p50``, ``p95``..."""
    e = F.col(error)
    exact = df.where(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))).groupBy(*keys).agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(e).alias("max"))
    near = at_ranks(sketch(df, keys, error, accuracy), keys, {f"p{round(100 * q):d}": rank_of(q) for q in quantiles}, accuracy).drop("n")
    return exact.join(near, keys)


def conformal_radius(df: DataFrame, keys: list[str], error: str, alpha: float, accuracy: float = ACCURACY) -> DataFrame:
    """The k-th smallest error, k = ceil((n + 1)(1 - alpha)) within 1..n, rounded up to its bucket's edge: it covers no fewer errors than the exact one."""
    k = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil((F.col("n") + 1) * F.lit(1 - alpha))))
    return at_ranks(sketch(df, keys, error, accuracy), keys, {"radius": k}, accuracy, edge=True).withColumn("k", k)


def nis_reliability(df: DataFrame, keys: list[str], nis: str, gates: dict[str, float], quantiles: tuple = (0.5, 0.95), accuracy: float = ACCURACY) -> DataFrame:
    """Per key: share of NIS values inside each gate, their mean, and sketched quantiles."""
    v = F.col(nis)
    inside = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), *[F.avg((v <= g).cast("double")).alias(f"inside_{name}") for name, g in gates.items()])
    return inside.join(at_ranks(sketch(df, keys, nis, accuracy), keys, {f"p{round(100 * q):d}": rank_of(q) for q in quantiles}, accuracy).drop("n"), keys)
