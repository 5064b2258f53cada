"""Repairs, ensembles and gates of trajectories, as window passes, groupings and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import asof_nearest, interpolated

AXES = ["x_m", "y_m", "z_m"]


def acceleration_pass(df: DataFrame, keys: list[str], order: list[str], axes: list[str], most_accel: float, most_speed: float, least_m: float, blend: float = 1.0, time: str = "time_s") -> DataFrame:
    """One pass: a row whose acceleration is too great, whose neighbours are near enough in speed and that
    lies off their line moves onto it by ``blend``.  Masks and lines come from the input, so passes can be repeated."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_a", F.lag(F.struct(time, *axes)).over(w)).withColumn("_b", F.lead(F.struct(time, *axes)).over(w))
    t0, t, t1 = F.col(f"_a.{time}"), F.col(time), F.col(f"_b.{time}")
    before, after, whole = F.nullif(t - t0, F.lit(0.0)), F.nullif(t1 - t, F.lit(0.0)), F.nullif(t1 - t0, F.lit(0.0))
    line = {a: F.col(f"_a.{a}") + (F.col(f"_b.{a}") - F.col(f"_a.{a}")) * (t - t0) / whole for a in axes}
    norm = lambda parts: F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    accel = norm([((F.col(f"_b.{a}") - F.col(a)) / after - (F.col(a) - F.col(f"_a.{a}")) / before) * 2 / whole for a in axes])
    direct = norm([(F.col(f"_b.{a}") - F.col(f"_a.{a}")) / whole for a in axes])
    residual = norm([F.col(a) - line[a] for a in axes])
    kink = F.coalesce((accel > most_accel) & (direct <= most_speed) & (residual >= least_m), F.lit(False))
    d = d.withColumns({"kink": kink, **{f"_l_{a}": line[a] for a in axes}})
    moved = {a: F.when(F.col("kink"), F.col(a) + F.lit(blend) * (F.col(f"_l_{a}") - F.col(a))).otherwise(F.col(a)) for a in axes}
    return d.withColumns(moved).drop("_a", "_b", *[f"_l_{a}" for a in axes])


def repeated(df: DataFrame, flag: str, rounds: int, step) -> DataFrame:
    """A repair pass applied ``rounds`` times, each to the result of the one before; ``flag`` is set if any pass fired."""
    out = df.withColumn("_any", F.lit(False))
    for _ in range(rounds):
        out = step(out).withColumn("_any", F.col("_any") | F.col(flag)).drop(flag)
    return out.withColumnRenamed("_any", flag)


def candidate_centers(rows: DataFrame, candidates: DataFrame, tolerance: float, k: int, axes: list[str] = AXES) -> DataFrame:
    """Per row (sequence_id, time_s, key): the candidates of the nearest frame within the tolerance, the best 4k by score, points and key:
    the first (``top``), the weighted mean of k (``mean``), the spread around it and the margin of the best two scores."""
    frames = candidates.groupBy("sequence_id", "time_s").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), F.col("key").alias("id"), "score", *axes))).alias("all"))
    frames = frames.select("sequence_id", "time_s", F.slice("all", 1, 4 * k).alias("all"))
    d = asof_nearest(rows, frames.withColumn("key", F.lit(0)), ["sequence_id"], payload=["all", "key"], order="key", tolerance=tolerance)
    best = F.slice(F.col("match.all"), 1, k)
    low = F.aggregate(best, F.lit(float("inf")), lambda a, x: F.least(a, x["score"]))
    weight = F.aggregate(best, F.lit(0.0), lambda a, x: a + x["score"] - low + 1)
    mean = {a: _weighted(best, a, low) / weight for a in axes}
    spread = F.sqrt(F.aggregate(best, F.lit(0.0), lambda s, x: s + sum(((x[a] - mean[a]) * (x[a] - mean[a]) for a in axes), F.lit(0.0))) / F.size(best))
    scores = F.col("match.all")
    out = d.withColumn("candidates", F.coalesce(F.size(F.col("match.all")), F.lit(0)))
    return out.select(
        *rows.columns, "candidates", *[F.get(scores, 0)[a].alias(f"top_{a}") for a in axes], *[F.when(F.size(best) > 0, mean[a]).alias(f"mean_{a}") for a in axes],
        F.when(F.size(best) > 0, spread).alias("spread_m"), (F.get(scores, 0)["score"] - F.get(scores, 1)["score"]).alias("margin"),
    )


def _weighted(items: Column, axis: str, low: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + (x["score"] - low + 1) * x[axis])


def speed_gated(rows: DataFrame, keys: list[str], gate: float, axes: list[str] = AXES, replace: bool = True, max_gap: float | None = None) -> DataFrame:
    """rows (keys, time_s, key, axes; times of a key differ) with ``outlier`` and ``replaced``.

    A row between two others is an outlier if it is faster than the gate from the one and to the other, and further from the line between
    them than half the gate times the shorter of its two gaps.  It is then put on the line between the nearest rows that are none, if they are
    no further apart than ``max_gap``.
    """
    w = Window.partitionBy(*keys).orderBy("time_s", "key")
    at = F.struct("time_s", *axes)
    d = rows.withColumn("_p", F.lag(at).over(w)).withColumn("_q", F.lead(at).over(w))
    t, t0, t1 = F.col("time_s"), F.col("_p.time_s"), F.col("_q.time_s")
    norm = lambda f: F.sqrt(sum((f(a) * f(a) for a in axes), F.lit(0.0)))
    left, right = F.greatest(t - t0, F.lit(1e-9)), F.greatest(t1 - t, F.lit(1e-9))
    share = (t - t0) / F.greatest(t1 - t0, F.lit(1e-9))
    off = norm(lambda a: F.col(a) - F.col(f"_p.{a}") - share * (F.col(f"_q.{a}") - F.col(f"_p.{a}")))
    fast = (norm(lambda a: F.col(a) - F.col(f"_p.{a}")) / left > gate) & (norm(lambda a: F.col(f"_q.{a}") - F.col(a)) / right > gate)
    d = d.withColumn("outlier", F.coalesce(fast & (off > 0.5 * gate * F.least(left, right)), F.lit(False)))
    if not replace:
        return d.withColumn("replaced", F.lit(False)).drop("_p", "_q")
    good = F.when(~F.col("outlier"), at)
    d = d.withColumn("_p", F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_q", F.first(good, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    gap = F.col("_q.time_s") - F.col("_p.time_s")
    ok = F.col("outlier") & (gap > 0)
    if max_gap is not None:
        ok = ok & (gap <= max_gap)
    d = d.withColumn("replaced", F.coalesce(ok, F.lit(False)))
    share = (t - F.col("_p.time_s")) / gap
    return d.withColumns({a: F.when(F.col("replaced"), F.col(f"_p.{a}") + share * (F.col(f"_q.{a}") - F.col(f"_p.{a}"))).otherwise(F.col(a)) for a in axes}).drop("_p", "_q")


def locally_fitted(rows: DataFrame, keys: list[str], lag: int, axes: list[str] = AXES, blend: float = 1.0) -> DataFrame:
    """rows (keys, time_s, axes) moved by ``blend`` to the line fitted to the rows within ``lag`` of their time; a row alone stays."""
    w = Window.partitionBy(*keys).orderBy("time_s").rangeBetween(-lag, lag)
    t = F.col("time_s")
    n, mean_t, var_t = F.count(F.lit(1)).over(w), F.avg(t).over(w), F.var_pop(t).over(w)
    fit = {a: F.when((n >= 2) & (var_t > 0), F.avg(a).over(w) + F.covar_pop("time_s", a).over(w) / var_t * (t - mean_t)).otherwise(F.col(a)) for a in axes}
    out = rows.withColumns({f"_f_{a}": v for a, v in fit.items()})
    return out.withColumns({a: (1 - blend) * F.col(a) + blend * F.col(f"_f_{a}") for a in axes}).drop(*[f"_f_{a}" for a in axes])


def center_statistics(rows: DataFrame, candidates: DataFrame, tolerance: float, top: int = 5, score: str = "score", axes: list[str] = AXES) -> DataFrame:
    """rows (sequence_id, time_s, axes) with centres of the candidates within the tolerance, by falling score (then key): ``candidate_count``, ``top1_<axis>``,
    score-weighted means of the best 5 and 10, the median of the best 10, the candidate nearest to the row, ``dispersion5``, ``top_score``, ``top_score_margin``.

    Only the best 4 * ``top`` of a row are looked at; a negative or null score counts as 0; rows without candidates have nulls.
    """
    from .joins import band_join

    fine = " AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in (*axes, "time_s"))
    c = candidates.where(fine).select("sequence_id", "time_s", "key", F.greatest(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"), *axes)
    at = rows.select("sequence_id", "time_s", *axes)
    near = band_join(at, c, ["sequence_id"], tolerance)
    own = Window.partitionBy("sequence_id", "time_s")
    near = near.withColumn("_i", F.row_number().over(own.orderBy(F.col("w_r").desc(), "key_r"))).withColumn("_n", F.count(F.lit(1)).over(own)).where(F.col("_i") <= 4 * top)
    item = F.struct(F.col("_i").alias("i"), F.col("w_r").alias("w"), *[F.col(f"{a}_r").alias(a) for a in axes], F.sqrt(sum(((F.col(f"{a}_r") - F.col(a)) * (F.col(f"{a}_r") - F.col(a)) for a in axes), F.lit(0.0))).alias("d"))
    g = near.groupBy("sequence_id", "time_s").agg(F.sort_array(F.collect_list(item)).alias("c"), F.first("_n").alias("candidate_count"))
    five, ten = F.slice("c", 1, min(top, 5)), F.slice("c", 1, max(top, 10))
    total = lambda items, f: F.aggregate(items, F.lit(0.0), lambda s, x: s + f(x))

    def mean(items: Column, a: str) -> Column:
        w = total(items, lambda x: x["w"])
        return F.when(w > 1e-12, total(items, lambda x: x["w"] * x[a]) / w).otherwise(total(items, lambda x: x[a]) / F.size(items))

    def median(a: str) -> Column:
        v, n = F.sort_array(F.transform(F.slice("c", 1, 10), lambda x: x[a])), F.least(F.size("c"), F.lit(10))
        return (F.get(v, ((n - 1) / 2).cast("int")) + F.get(v, (n / 2).cast("int"))) / 2

    nearest = F.array_min(F.transform("c", lambda x: F.struct(x["d"].alias("d"), x["i"].alias("i"), x.alias("x"))))["x"]
    g = g.withColumn("_near", nearest).select(
        "sequence_id", "time_s", "c", "candidate_count", *[F.col("c")[0][a].alias(f"top1_{a}") for a in axes], *[mean(five, a).alias(f"weighted5_{a}") for a in axes], *[mean(ten, a).alias(f"weighted10_{a}") for a in axes],
        *[median(a).alias(f"median10_{a}") for a in axes], *[F.col(f"_near.{a}").alias(f"nearest_{a}") for a in axes], F.col("c")[0]["w"].alias("top_score"), (F.col("c")[0]["w"] - F.coalesce(F.get("c", F.lit(1))["w"], F.lit(0.0))).alias("top_score_margin"),
    )
    far = total(F.slice("c", 1, 5), lambda x: F.sqrt(sum(((x[a] - F.col(f"weighted5_{a}")) * (x[a] - F.col(f"weighted5_{a}")) for a in axes), F.lit(0.0))))
    g = g.withColumn("dispersion5", far / F.least(F.size("c"), F.lit(5))).drop("c")
    return rows.join(g, ["sequence_id", "time_s"], "left")


def candidate_pull(rows: DataFrame, weights: DataFrame, axes: list[str] = AXES) -> DataFrame:
    """Rows with top_<axis> move towards it: by alpha_xy in the first two axes, alpha_z in the third; weights are per sequence, none means 0."""
    d = rows.join(weights, "sequence_id", "left").fillna(0.0, ["alpha_xy", "alpha_z"])
    pulled = {a: F.col(a) + F.col("alpha_z" if i == 2 else "alpha_xy") * F.coalesce(F.col(f"top_{a}") - F.col(a), F.lit(0.0)) for i, a in enumerate(axes)}
    return d.withColumns(pulled).drop("alpha_xy", "alpha_z")


def consensus_ensemble(df: DataFrame, keys: list[str], label: str, radius: float, least_share: float = 0.0, fallback: str = "max-weight", weight: str = "weight", axes: list[str] = AXES) -> DataFrame:
    """Inputs (keys, label, weight, axes): of the balls of a radius around each input the one of most weight, then members,
    then least spread, then first label, gives the weighted mean; one of too small a share falls back to the heaviest input or to all."""
    one = df.where(F.col(weight) > 0).select(*keys, F.struct(F.col(weight).alias("w"), F.col(label).alias("l"), *axes).alias("m"))
    g = one.groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("ms"))  # the inputs of one time: as many as there are methods
    d = g.withColumn("c", F.explode("ms"))
    near = F.filter("ms", lambda x: F.sqrt(sum(((x[a] - F.col(f"c.{a}")) * (x[a] - F.col(f"c.{a}")) for a in axes), F.lit(0.0))) <= radius)
    d = d.withColumn("near", near)
    total = lambda items: F.aggregate(items, F.lit(0.0), lambda s, x: s + x["w"])
    mean = lambda items, a: F.aggregate(items, F.lit(0.0), lambda s, x: s + x["w"] * x[a]) / total(items)
    d = d.withColumn("w", total(F.col("near"))).withColumn("all_w", total(F.col("ms"))).withColumns({f"_m_{a}": mean(F.col("near"), a) for a in axes})
    spread = F.aggregate("near", F.lit(0.0), lambda s, x: s + x["w"] * sum(((x[a] - F.col(f"_m_{a}")) * (x[a] - F.col(f"_m_{a}")) for a in axes), F.lit(0.0))) / F.col("w")
    d = d.withColumn("spread_m", F.round(F.sqrt(spread), 9))
    order = F.struct((-F.round("w", 9)).alias("a"), (-F.size("near")).alias("b"), F.col("spread_m").alias("c"), F.col("c.l").alias("d"))
    best = d.groupBy(*keys).agg(F.min_by(F.struct("near", "ms", "w", "all_w"), order).alias("b"))
    weak = F.col("b.w") < F.lit(least_share) * F.col("b.all_w")
    heaviest = F.slice(F.array_sort(F.col("b.ms"), lambda x, y: F.when((x["w"] > y["w"]) | ((x["w"] == y["w"]) & (x["l"] < y["l"])), -1).otherwise(1)), 1, 1)
    best = best.withColumn("fallback", weak).withColumn("chosen", F.when(weak, heaviest if fallback == "max-weight" else F.col("b.ms")).otherwise(F.col("b.near")))
    return best.select(*keys, *[mean(F.col("chosen"), a).alias(a) for a in axes], F.size("chosen").cast("long").alias("inputs"), "fallback")


def class_weighted(df: DataFrame, keys: list[str], classes: DataFrame, weights: DataFrame, label: str = "source", axes: list[str] = AXES) -> DataFrame:
    """Ensembles whose weights depend on the sequence's class.

    ``classes`` (sequence_id, class, p) holds one class of probability 1 or several; ``weights``
    (class, label, w) the inputs' weights by class.  The means of the classes are blended by probability.
    """
    d = df.join(classes, "sequence_id").join(weights.select("class", F.col("label").alias(label), F.col("w").alias("_w")), ["class", label])
    per = d.groupBy(*keys, "class").agg(F.max("p").alias("p"), F.sum("_w").alias("_t"), *[F.sum(F.col("_w") * F.col(a)).alias(a) for a in axes]).where("_t > 0")
    return per.groupBy(*keys).agg(*[(F.sum(F.col("p") * F.col(a) / F.col("_t")) / F.sum("p")).alias(a) for a in axes], F.count(F.lit(1)).alias("classes"))


def sequence_blend(base: DataFrame, other: DataFrame, weights: DataFrame, default: float = 0.0, axes: list[str] = AXES) -> DataFrame:
    """Base rows (sequence_id, time_s) blended with another method's line at their times, by a weight per sequence; base where it has none."""
    d = interpolated(base, other.select("sequence_id", "time_s", *axes, "key"), ["sequence_id"], axes, order="key")
    d = d.join(weights.select("sequence_id", F.col("weight").alias("_w")), "sequence_id", "left")
    w = F.coalesce("_w", F.lit(default))
    return d.withColumns({a: F.coalesce((1 - w) * F.col(a) + w * F.col(f"{a}_at"), F.col(a)) for a in axes}).drop("_w", *[f"{a}_at" for a in axes])


def completed(rows: DataFrame, grid: DataFrame, values: list[str], most_gap: float | None = None, hold: bool = True) -> DataFrame:
    """Values on a grid of times: linear between rows no further apart than ``most_gap`` (else the nearer one), held or null beyond the ends."""
    from .joins import brackets

    d = brackets(grid, rows.select("sequence_id", "time_s", *values, "key"), ["sequence_id"], payload=[*values, "key"], order="key")
    t0, t1, t = F.col("prev.t"), F.col("next.t"), F.col("time_s")
    inside, wide = t0.isNotNull() & t1.isNotNull(), (t1 - t0 > most_gap) if most_gap is not None else F.lit(False)
    mode = F.when(t0 == t, "exact").when(inside & wide, "nearest").when(inside, "linear").when(t0.isNull() & t1.isNull(), "empty").otherwise("held" if hold else "outside")
    d = d.withColumn("mode", mode)
    for v in values:
        a, b = F.col(f"prev.{v}"), F.col(f"next.{v}")
        near = F.when(t - t0 <= t1 - t, a).otherwise(b)
        value = F.when(F.col("mode") == "exact", a).when(F.col("mode") == "linear", a + (b - a) * (t - t0) / (t1 - t0)).when(F.col("mode") == "nearest", near).when(F.col("mode") == "held", F.coalesce(a, b))
        d = d.withColumn(v, value)
    return d.select(*grid.columns, *values, "mode")


def snapped(results: DataFrame, template: DataFrame, axes: list[str] = AXES, most_gap: float | None = None, missing: str = "zero") -> DataFrame:
    """One row per template time: resampled positions and the sequence's commonest label; sequences without results give zeros (or fail)."""
    label = results.groupBy("sequence_id", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("sequence_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
    d = completed(results, template, axes, most_gap).join(label, "sequence_id", "left")
    if missing == "zero":
        return d.fillna(0.0, axes)
    lacks = F.when(F.col("mode") == "empty", F.raise_error(F.concat(F.lit("no results for sequence "), "sequence_id")))
    return d.withColumn("mode", F.coalesce(lacks, F.col("mode")))


def path_ensemble(df: DataFrame, shifts: DataFrame, fractions: list[float], axes: list[str]) -> DataFrame:
    """Union of the rows moved by fractions of their source's shift (columns shift_<axis>; none: unmoved and only as fraction 0)."""
    d = df.join(shifts, "source", "left").withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    d = d.where(F.col(f"shift_{axes[0]}").isNotNull() | (F.col("fraction") == 0))
    moved = {a: F.col(a) + F.col("fraction") * F.coalesce(F.col(f"shift_{a}"), F.lit(0.0)) for a in axes}
    branch = F.when(F.col("fraction") == 0, "raw").when(F.col("fraction") == 1, "calibrated").otherwise(F.concat(F.lit("path_"), F.col("fraction").cast("string")))
    return d.withColumns(moved).withColumn("branch", branch).drop(*[f"shift_{a}" for a in axes])


def merged_truth(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two truth tables; where both have a key, rows of the first stay."""
    rest = second.join(first.select(*keys).distinct(), keys, "left_anti")
    return first.unionByName(rest, allowMissingColumns=True)
