"""Time slices: one key's rows over many tasks.

A window over a key is one task's work, however many rows the key has.  Here a key that holds more
than 1 / ``slices`` of all rows is cut at quantiles of its times, so no window holds much more than that
share; what a slice needs of its neighbours comes as edge rows.  At most ``slices`` keys are cut, at
``slices`` bounds each: their bounds and edges (``slices`` squared at the most) are broadcast, whatever
the number of rows.  Everything is one lazy plan; the sketch of the quantiles is mergeable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slices of a key with all rows; a window then has about 1/64 of all rows at the most.
SLICES = 64
#: Rows below which no key is cut.
LEAST = 100_000


def same_keys(keys: list[str], suffix: str) -> Column:
    """Null-safe equality of keys and their suffixed copies."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in keys]) if keys else F.lit(True)


def sliced(rows: DataFrame, keys: list[str], time: str = "time_s", slices: int = SLICES, least: int = LEAST, spread: Column | None = None) -> DataFrame:
    """rows with ``_slice`` (int, rising with time; 0 where the key is small).

    Rows of one key and time share a slice; but where ``spread`` holds and a time is so common that it fills
    several slices, they are dealt over these.  Null and NaN times are in the first slice.
    """
    t = F.col(time).cast("double")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.greatest(F.sum("_n") / slices, F.lit(float(least))).alias("_most"))
    heavy = counts.join(F.broadcast(total)).where(F.col("_n") > F.col("_most")).select(*[F.col(k).alias(f"{k}_h") for k in keys], F.lit(True).alias("_heavy"))
    of_heavy = rows.where(~F.isnan(t)).join(F.broadcast(heavy), same_keys(keys, "_h"), "left_semi")
    at = [k / slices for k in range(1, slices)]
    bounds = of_heavy.groupBy(*keys).agg(F.percentile_approx(t, at, 100 * slices).alias("_bounds"))
    bounds = bounds.select(*[F.col(k).alias(f"{k}_h") for k in keys], "_bounds")
    out = rows.join(F.broadcast(bounds), same_keys(keys, "_h"), "left")
    below = F.size(F.filter("_bounds", lambda b: b < t))
    equal = F.size(F.filter("_bounds", lambda b: b == t))
    more = F.lit(0)
    if spread is not None:
        more = F.when(spread & (equal > 1), F.pmod(F.monotonically_increasing_id(), equal)).otherwise(0)
    slice_ = F.when(F.col("_bounds").isNull() | t.isNull() | F.isnan(t), 0).otherwise(below + more)
    return out.withColumn("_slice", slice_.cast("int")).drop("_bounds", *[f"{k}_h" for k in keys])


def carried(edges: DataFrame, keys: list[str], first: str | None, last: str | None) -> DataFrame:
    """(keys, _slice, first, last) of slices that have some -> (keys, slice, _before, _after) for every slice:
    the last of the slices before it, the first of those after it.  Only keys of several slices have rows.

    The windows hold a key's slices, so at most their number of rows.
    """
    w = Window.partitionBy(*keys).orderBy("_slice")
    out = edges
    if last:
        out = out.withColumn("_before", F.last(last, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    if first:
        out = out.withColumn("_after", F.first(first, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return out.drop(*[c for c in (first, last) if c]).where(" OR ".join(f"{c} IS NOT NULL" for c in ("_before" if last else None, "_after" if first else None) if c))


def with_carried(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """rows (with ``_slice``) and their slice's ``_before`` and ``_after``."""
    e = edges.select(*[F.col(c).alias(f"{c}_e") for c in [*keys, "_slice"]], *[c for c in ("_before", "_after") if c in edges.columns])
    return rows.join(F.broadcast(e), same_keys([*keys, "_slice"], "_e"), "left").drop(*[f"{c}_e" for c in [*keys, "_slice"]])
