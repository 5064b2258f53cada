"""Error summaries, calibration and reliability tables, votes, shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def error_summary(e: Column) -> list[Column]:
    """count, mean, population std, RMSE, MAE, median, 95th percentile, maximum of errors."""
    return [
        F.count(e).alias("n"),
        F.avg(e).alias("mean"),
        F.stddev_pop(e).alias("std"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.percentile(e, 0.5).alias("p50"),
        F.percentile(e, 0.95).alias("p95"),
        F.max(e).alias("max"),
    ]


def pooled_and_grouped(df: DataFrame, group: str, aggs: list[Column]) -> DataFrame:
    """The aggregates per group and over all rows (group null): never an average of averages."""
    return df.groupingSets([[], [F.col(group)]], F.col(group)).agg(*aggs)


def residual_covariance(df: DataFrame, keys: list[str], axes: list[str], floor: float = 0.0) -> DataFrame:
    """Sample covariance (ddof 1) of residual columns per group, variances floored, with means."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in axes]]
    for i, a in enumerate(axes):
        for b in axes[i:]:
            c = F.covar_samp(a, b)
            aggs.append((F.greatest(c, F.lit(floor)) if a == b else c).alias(f"cov_{a}_{b}"))
    return df.groupBy(*keys).agg(*aggs)


def scale_calibration(df: DataFrame, keys: list[str], ratio: Column, least: float, most: float, min_n: int) -> DataFrame:
    """Per group: mean normalised square as a clipped scale; 1 for groups with too few rows."""
    g = df.groupBy(*keys).agg(F.count(ratio).alias("n"), F.avg(ratio).alias("raw"))
    return g.withColumn("scale", F.when(F.col("n") >= min_n, F.least(F.greatest(F.col("raw"), F.lit(least)), F.lit(most))).otherwise(F.lit(1.0)))


def reliability(df: DataFrame, p: Column, hit: Column, bins: int = 10) -> DataFrame:
    """Bins of a probability: count, mean probability, positive rate, gap, share of the calibration error."""
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    g = df.select(b.alias("bin"), p.alias("p"), hit.cast("double").alias("y")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    total = F.sum("n").over(Window.partitionBy())
    return g.withColumn("gap", F.abs(F.col("mean_p") - F.col("rate"))).withColumn("ece_share", F.col("n") / total * F.col("gap"))


def class_vote(df: DataFrame, keys: list[str], label: str, weight: Column) -> DataFrame:
    """Label of most weight per key; ties go to the first in the alphabet."""
    v = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys).orderBy(F.col("w").desc(), F.col(label))
    return v.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def shares(df: DataFrame, keys: list[str], item: str, base: float | None = None) -> DataFrame:
    """Per key: dominant item's share and the entropy of the items' shares (nats, or to a base)."""
    c = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    log = F.log(F.col("p")) if base is None else F.log(F.col("p")) / F.log(F.lit(base))
    return c.withColumn("p", p).groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.max("p").alias("dominant"), (-F.sum(F.col("p") * log)).alias("entropy"))


def ks_shift(df: DataFrame, keys: list[str], value: str, side: Column) -> DataFrame:
    """Two-sample comparison per key: mean shift in units of the first side's std, and the KS distance."""
    d = df.select(*keys, F.col(value).alias("v"), side.alias("s"))
    g = d.groupBy(*keys, "v").agg(F.count(F.when(~F.col("s"), 1)).alias("a"), F.count(F.when(F.col("s"), 1)).alias("b"))
    w, whole = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    gap = F.abs(F.try_divide(F.sum("a").over(w), F.sum("a").over(whole)) - F.try_divide(F.sum("b").over(w), F.sum("b").over(whole)))
    ks = g.withColumn("gap", gap).groupBy(*keys).agg(F.max("gap").alias("ks"))
    m = d.groupBy(*keys).agg(F.avg(F.when(~F.col("s"), F.col("v"))).alias("mean_a"), F.avg(F.when(F.col("s"), F.col("v"))).alias("mean_b"), F.stddev_pop(F.when(~F.col("s"), F.col("v"))).alias("std_a"))
    return m.join(ks, keys).withColumn("shift", F.try_divide(F.col("mean_b") - F.col("mean_a"), F.col("std_a")))


def conformal_radius(df: DataFrame, keys: list[str], error: str, alpha: float) -> DataFrame:
    """The k-th smallest error per group, k = ceil((n + 1)(1 - alpha)) within 1..n."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    k = F.least(n, F.greatest(F.lit(1), F.ceil((n + 1) * F.lit(1 - alpha))))
    r = df.withColumn("n", n).withColumn("k", k).withColumn("_rn", F.row_number().over(w.orderBy(error)))
    return r.where("_rn = k").select(*keys, "n", "k", F.col(error).alias("radius"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
