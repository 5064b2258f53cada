"""Sessions, segments, runs, trailing features and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def segments(df: DataFrame, keys: list[str], order: list[str], gap: float, time: str = "time_s", state: Column | None = None) -> DataFrame:
    """Gaps and islands: ``segment`` counts from 0; it changes after a gap or when ``state`` changes."""
    w = _w(keys, order)
    new = F.col(time) - F.lag(time).over(w) > gap
    if state is not None:
        new = new | ~F.lag(state).over(w).eqNullSafe(state)
    start = F.when(F.lag(F.lit(1)).over(w).isNull(), 0).otherwise(F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0))
    return df.withColumn("_new", start).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def segment_table(df: DataFrame, keys: list[str], value: str, time: str = "time_s") -> DataFrame:
    return df.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("start_s"), F.max(time).alias("end_s"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def largest_segment(table: DataFrame, keys: list[str]) -> DataFrame:
    """Most rows, then longest, then highest mean, then earliest."""
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), (F.col("end_s") - F.col("start_s")).desc(), F.col("mean").desc(), "start_s", "segment")
    return table.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def runs_above(df: DataFrame, keys: list[str], order: list[str], value: str, threshold: float, time: str = "time_s") -> DataFrame:
    """Runs of rows over a threshold: start, end, duration, rows, maximum."""
    w = _w(keys, order)
    over = F.col(value) > threshold
    r = df.withColumn("_o", over).withColumn("_i", F.row_number().over(w)).where("_o")
    r = r.withColumn("_g", F.col("_i") - F.row_number().over(w))
    g = r.groupBy(*keys, "_g").agg(F.min(time).alias("start_s"), F.max(time).alias("end_s"), F.count(F.lit(1)).alias("n"), F.max(value).alias("max"))
    return g.drop("_g").withColumn("duration_s", F.col("end_s") - F.col("start_s"))


def track_features(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = 10, gap: float = 1.5, time: str = "time_s") -> DataFrame:
    """Age, hit streak since the last gap, step, trailing mean and minimum over a track."""
    w = _w(keys, order)
    s = segments(df, keys, order, gap, time)
    trail = w.rowsBetween(-(rows - 1), 0)
    return s.select(
        *df.columns,
        (F.row_number().over(w) - 1).alias("age"),
        F.row_number().over(_w([*keys, "segment"], order)).alias("streak"),
        F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0.0)).alias("gap_s"),
        F.avg(value).over(trail).alias("trail_mean"),
        F.min(value).over(trail).alias("trail_min"),
    )


def sliding_windows(df: DataFrame, keys: list[str], value: str, width: float, stride: float, time: str = "time_s") -> DataFrame:
    """Aggregates of all windows [start, start + width), starts every ``stride`` from each key's first time."""
    first = F.min(time).over(Window.partitionBy(*keys))
    offset = F.col(time) - F.col("_t0")
    lo = F.greatest(F.lit(0), F.floor((offset - width) / stride) + 1).cast("long")
    d = df.withColumn("_t0", first).withColumn("window", F.explode(F.sequence(lo, F.floor(offset / stride).cast("long"))))
    v = F.col(value)
    return d.groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(v * v)).alias("rmse"), F.percentile(v, 0.95).alias("p95"), F.max(v).alias("max"))


def tumbling(df: DataFrame, keys: list[str], value: str, width: float, time: str = "time_s") -> DataFrame:
    first = F.min(time).over(Window.partitionBy(*keys))
    d = df.withColumn("window", F.floor((F.col(time) - first) / width).cast("long"))
    v = F.col(value)
    return d.groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rmse"), F.max(v).alias("max"))


def switches(df: DataFrame, keys: list[str], order: list[str], item: str, long_gap: float, time: str = "time_s") -> DataFrame:
    """Changes of an item along time: switches, rate, long gaps, gap percentiles."""
    w = _w(keys, order)
    d = df.withColumn("_p", F.lag(item).over(w)).withColumn("_g", F.col(time) - F.lag(time).over(w))
    sw = F.count(F.when(F.col("_p").isNotNull() & (F.col("_p") != F.col(item)), 1))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sw.alias("switches"), F.count(F.when(F.col("_g") > long_gap, 1)).alias("long_gaps"), F.percentile("_g", 0.95).alias("gap_p95"), F.max("_g").alias("gap_max"))


def transition_labels(df: DataFrame, keys: list[str], order: list[str], source: str, gap: float, first: tuple = ("a", "b"), time: str = "time_s") -> DataFrame:
    """What came before each row: a long gap, the first row of either source after another, or the last source."""
    w = _w(keys, order)
    prev = F.coalesce(F.lag(source).over(w), F.lit("start"))
    label = F.when(F.col(time) - F.lag(time).over(w) > gap, "after_long_gap")
    for s in first:
        label = label.when((F.col(source) == s) & (prev != s), f"first_{s}_after_non{s}")
    return df.withColumn("label", label.otherwise(F.concat(F.lit("last_"), prev)))


def autocorrelation(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int) -> DataFrame:
    """Autocorrelation at lags 1.. and the Ljung-Box statistic of each key's series."""
    w, whole = _w(keys, order), Window.partitionBy(*keys)
    d = df.withColumn("_d", F.col(value) - F.avg(value).over(whole))
    d = d.select(*keys, "_d", *[F.lag("_d", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    aggs = [(F.sum(F.col("_d") * F.col(f"_l{k}")) / F.sum(F.col("_d") * F.col("_d"))).alias(f"r{k}") for k in range(1, lags + 1)]
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)
    q = sum((F.col(f"r{k}") * F.col(f"r{k}") / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return g.where(F.col("n") > lags + 1).withColumn("ljung_box", F.col("n") * (F.col("n") + 2) * q)


def trailing_median(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, least: int) -> Column:
    """Median of the last ``rows`` rows if there are ``least`` of them, else of all so far."""
    w = _w(keys, order)
    trail, sofar = w.rowsBetween(-(rows - 1), 0), w.rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(value).over(trail) >= least, F.percentile(value, 0.5).over(trail)).otherwise(F.percentile(value, 0.5).over(sofar))


def keep_last_time(df: DataFrame, keys: list[str], time: str, ordinal: str) -> DataFrame:
    w = Window.partitionBy(*keys, time).orderBy(F.col(ordinal).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def mode_blocks(df: DataFrame, keys: list[str], order: list[str], mode: str, value: str, gap: float, time: str = "time_s") -> DataFrame:
    """Contiguous rows of one mode without long gaps: block number, rows, start, end, mean and worst value."""
    s = segments(df, keys, order, gap, time, state=F.col(mode))
    g = s.groupBy(*keys, F.col("segment").alias("block"), mode)
    return g.agg(F.count(F.lit(1)).alias("frames"), F.min(time).alias("start_s"), F.max(time).alias("end_s"), F.avg(value).alias("mean"), F.max(value).alias("worst"))
