"""Joins in time and space: as-of, bracketing, range, radius, assignment.

As-of joins put both sides into one sorted window (one shuffle by key, no pairs);
range and radius joins are equi-joins on buckets with a residual predicate.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import distance
from .slices import LEAST, carried, sliced, with_carried


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def brackets(left: DataFrame, right: DataFrame, keys: list[str], time: str = "time_s", payload: list[str] | None = None, order: str | None = None, slices: int | None = None, least: int = LEAST) -> DataFrame:
    """left with structs ``prev`` and ``next``: right's rows around each time (prev at or before, next after).

    Right rows of equal key and time: the greatest ``order`` stays (the last row wins).
    Null or NaN times match nothing.  With ``slices`` a key with a large share of all rows is cut at quantiles
    of its times, and each slice gets its neighbours' edge rows: no task holds such a key whole.
    """
    payload = payload if payload is not None else [c for c in right.columns if c not in (*keys, time)]
    row = F.struct(F.col(time).alias("t"), *[F.col(c) for c in payload])
    r = right.where(F.col(time).isNotNull() & ~F.isnan(time))
    r = r.groupBy(*keys, time).agg(F.max_by(row, F.col(order) if order else F.struct(*[F.col(c) for c in payload])).alias("_r"))
    l_ = left.select(*keys, time, F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    both = r.select(*keys, time, F.lit(0).alias("_tag"), "_r", F.lit(None).cast(l_.schema["_l"].dataType).alias("_l"))
    both = both.unionByName(l_.select(*keys, time, F.lit(1).alias("_tag"), F.lit(None).cast(both.schema["_r"].dataType).alias("_r"), "_l"))
    parts = list(keys)
    if slices:
        both = sliced(both, keys, time, slices, least, F.col("_tag") == 1)
        parts.append("_slice")
    w = Window.partitionBy(*parts).orderBy(time, "_tag")
    prev = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*parts).orderBy(F.col(time).desc(), F.col("_tag").desc())  # running from the end: a frame up to the end is worked out anew for every row
    nxt = F.last("_r", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("prev", prev).withColumn("next", nxt).where("_tag = 1")
    if slices:
        of_right = F.when(F.col("_tag") == 0, F.col(time))
        edges = both.groupBy(*parts).agg(F.min_by("_r", of_right).alias("_first"), F.max_by("_r", of_right).alias("_last"))
        out = with_carried(out, carried(edges, keys, "_first", "_last"), keys)
        out = out.withColumn("prev", F.coalesce("prev", "_before")).withColumn("next", F.coalesce("next", "_after"))
    known = F.col(time).isNotNull() & ~F.isnan(time)
    out = out.withColumn("prev", F.when(known, F.col("prev"))).withColumn("next", F.when(known, F.col("next")))
    return out.select("_l.*", "prev", "next")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str = "time_s", payload: list[str] | None = None, order: str | None = None, tolerance: float | None = None, slices: int | None = None, least: int = LEAST) -> DataFrame:
    """left with ``match``: right's row nearest in time (ties: the earlier); null beyond the tolerance."""
    b = brackets(left, right, keys, time, payload, order, slices, least)
    before, after = F.col(time) - F.col("prev.t"), F.col("next.t") - F.col(time)
    best = F.when(F.col("next").isNotNull() & (F.col("prev").isNull() | (after < before)), F.col("next")).otherwise(F.col("prev"))
    out = b.withColumn("match", best)
    if tolerance is not None:
        out = out.withColumn("match", F.when(F.abs(F.col("match.t") - F.col(time)) <= tolerance, F.col("match")))
    return out.drop("prev", "next")


def interpolated(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], time: str = "time_s", max_delta: float | None = None, order: str | None = None, slices: int | None = None, least: int = LEAST) -> DataFrame:
    """left with ``<value>_at``: right's values, linear between its samples; null outside of their span
    and where the nearer sample is further than ``max_delta``."""
    b = brackets(left, right, keys, time, values, order, slices, least)
    t0, t1, t = F.col("prev.t"), F.col("next.t"), F.col(time)
    near = F.least(t - t0, F.coalesce(t1 - t, F.lit(float("inf"))))
    ok = t0.isNotNull() & (t1.isNotNull() | (t0 == t))
    if max_delta is not None:
        ok = ok & (near <= max_delta)
    for v in values:
        a, c = F.col(f"prev.{v}"), F.col(f"next.{v}")
        b = b.withColumn(f"{v}_at", F.when(ok, F.when(t0 == t, a).otherwise(a + (c - a) * (t - t0) / (t1 - t0))))
    return b.drop("prev", "next")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, time: str = "time_s") -> DataFrame:
    """Pairs of one key with |time difference| <= width: right rows stand in three buckets, so it is an equi-join.

    Right's columns get the suffix ``_r``.
    """
    size = max(width, 1e-9)
    bucket = lambda: F.floor(F.col(time) / F.lit(size))
    l_ = left.withColumn("_b", bucket())
    r = right.select(*[F.col(c).alias(c if c in keys else f"{c}_r") for c in right.columns], F.explode(F.array(*[F.floor(F.col(time) / F.lit(size)) + k for k in (-1, 0, 1)])).alias("_b"))
    return l_.join(r, [*keys, "_b"]).where(F.abs(F.col(time) - F.col(f"{time}_r")) <= width).drop("_b")


def radius_join(left: DataFrame, right: DataFrame, keys: list[str], radius: float, axes: tuple = ("x_m", "y_m", "z_m")) -> DataFrame:
    """Pairs of one key within a distance: cells of a grid, right rows in all neighbour cells."""
    cell = lambda c, k=0: F.floor(F.col(c) / F.lit(radius)) + k
    l_ = left.withColumn("_c", F.struct(*[cell(c).alias(c) for c in axes]))
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    r = right.select(*[F.col(c).alias(c if c in keys else f"{c}_r") for c in right.columns])
    for c in axes:
        r = r.withColumn(f"_s_{c}", F.explode(steps))
    r = r.withColumn("_c", F.struct(*[(F.floor(F.col(f"{c}_r") / F.lit(radius)) + F.col(f"_s_{c}")).alias(c) for c in axes])).drop(*[f"_s_{c}" for c in axes])
    d = distance([F.col(c) for c in axes], [F.col(f"{c}_r") for c in axes])
    return l_.join(r, [*keys, "_c"]).withColumn("distance_m", d).where(F.col("distance_m") <= radius).drop("_c")


def near_pairs(df: DataFrame, keys: list[str], key: str, cells: dict[str, float], payload: list[str]) -> DataFrame:
    """Each unordered pair of rows of equal keys whose ``cells`` columns differ by less than their widths in grid steps, once.

    ``cells`` names the columns that are gridded and their cell widths.  Of the neighbour cells only half are
    visited, so one side stands in (3^n + 1) / 2 cells: few gridded columns for small groups, more for dense ones.
    Columns of the second row get the suffix ``_r``; a residual predicate is the caller's.
    """
    at = F.struct(*[F.floor(F.col(c) / F.lit(float(w))).cast("long").alias(f"_{i}") for i, (c, w) in enumerate(cells.items())])
    half = [o for o in product((-1, 0, 1), repeat=len(cells)) if o >= (0,) * len(cells)]
    one = df.select(*keys, key, *payload, at.alias("_c"))
    steps = F.array(*[F.struct(*[F.lit(k).cast("long").alias(f"_{i}") for i, k in enumerate(o)], F.lit(any(o)).alias("other")) for o in half])
    two = one.select(*keys, *[F.col(c).alias(f"{c}_r") for c in (key, *payload)], "_c", F.explode(steps).alias("_o"))
    two = two.withColumn("_c", F.struct(*[(F.col(f"_c._{i}") + F.col(f"_o._{i}")).alias(f"_{i}") for i in range(len(cells))])).withColumn("_o", F.col("_o.other"))
    return one.join(two, [*keys, "_c"]).where(F.col("_o") | (F.col(key) < F.col(f"{key}_r"))).drop("_c", "_o")


def radius_pairs(df: DataFrame, keys: list[str], key: str, radius: float, gridded: tuple = ("x_m", "y_m", "z_m"), axes: tuple = ("x_m", "y_m", "z_m")) -> DataFrame:
    """Unordered pairs of one group within a distance, each once; ``gridded`` are the axes that cut the group into cells."""
    d = distance([F.col(c) for c in axes], [F.col(f"{c}_r") for c in axes])
    return near_pairs(df, keys, key, {c: radius for c in gridded}, list(axes)).withColumn("distance_m", d).where(F.col("distance_m") <= radius)


def branch_consensus(candidates: DataFrame, window_s: float, gate_m: float, scale_m: float | None = None) -> DataFrame:
    """Per candidate: neighbours of other sources in the same sequence, near in time and space, and a support score
    (sources found / (1 + nearest distance / scale)).

    Needs sequence_id, key, time_s, source, candidate_branch and x_m, y_m, z_m.  A pair is found once, in a cell of time and x, and counts for both.
    """
    axes = ["x_m", "y_m", "z_m"]
    pairs = near_pairs(candidates, ["sequence_id"], "key", {"time_s": max(window_s, 1e-9), "x_m": gate_m}, list(dict.fromkeys(["time_s", "source", "candidate_branch", *axes])))
    d = distance([F.col(c) for c in axes], [F.col(f"{c}_r") for c in axes])
    near = pairs.where("source <> source_r").where(F.abs(F.col("time_s") - F.col("time_s_r")) <= window_s).withColumn("d", d).where(F.col("d") <= gate_m)
    side = lambda own, other: F.struct(F.col(f"key{own}").alias("key"), F.col(f"source{other}").alias("s"), F.col(f"candidate_branch{other}").alias("b"))
    both = near.select("d", F.explode(F.array(side("", "_r"), side("_r", ""))).alias("p")).select("p.*", "d")
    # sets of sources and branches are small; two distinct counts would expand every row threefold
    got = both.groupBy("key").agg(F.count(F.lit(1)).alias("neighbors"), F.size(F.collect_set("s")).cast("long").alias("sources"), F.size(F.collect_set("b")).cast("long").alias("branches"), F.min("d").alias("nearest_m"))
    out = candidates.join(got, "key", "left").fillna(0, ["neighbors", "sources", "branches"])
    return out.withColumn("consensus_score", F.col("sources") / (1 + F.coalesce("nearest_m", F.lit(0.0)) / (scale_m or gate_m)))


def temporal_support(candidates: DataFrame, max_gap: float, max_speed: float) -> DataFrame:
    """Per candidate: nearest candidate of the sequence's previous and next frame that speed allows.

    Each candidate stands in its two neighbour frames, so one join serves both directions.
    """
    axes = ["x_m", "y_m", "z_m"]
    w = Window.partitionBy("sequence_id").orderBy("time_s")
    c = candidates.select("sequence_id", "key", "time_s", *axes).withColumn("frame", F.dense_rank().over(w))
    o = c.select("sequence_id", F.explode(F.array(F.lit(-1), F.lit(1))).alias("step"), "frame", F.col("time_s").alias("t_o"), *[F.col(a).alias(f"{a}_o") for a in axes]).withColumn("frame", F.col("frame") + F.col("step"))
    d = distance([F.col(a) for a in axes], [F.col(f"{a}_o") for a in axes])
    gap = F.abs(F.col("t_o") - F.col("time_s"))
    near = c.join(o, ["sequence_id", "frame"], "left").withColumn("d", F.when((gap <= max_gap) & (d <= gap * max_speed), d))
    side = lambda step: F.min(F.when(F.col("step") == step, F.col("d")))
    out = near.groupBy("key", "sequence_id", "frame", "time_s", *axes).agg(side(1).alias("backward_m"), side(-1).alias("forward_m"))
    return out.withColumn("support", F.when(F.col("backward_m").isNotNull(), 1).otherwise(0) + F.when(F.col("forward_m").isNotNull(), 1).otherwise(0))


def interval_groups(targets: DataFrame, candidates: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """All candidates within the tolerance of each target; a target without any gets its nearest one (fallback true)."""
    payload = [c for c in candidates.columns if c not in keys]
    hit = band_join(targets, candidates, keys, tolerance).withColumn("fallback", F.lit(False))
    rest = targets.join(hit.select(*keys, "time_s").distinct(), [*keys, "time_s"], "left_anti")
    nearest = asof_nearest(rest, candidates, keys, payload=[c for c in payload if c != "time_s"], order="key").where("match IS NOT NULL")
    nearest = nearest.select(*targets.columns, *[F.col("match.t" if c == "time_s" else f"match.{c}").alias(f"{c}_r") for c in payload], F.lit(True).alias("fallback"))
    return hit.unionByName(nearest)
