"""Greedy choice of score against distance within a frame, as a fold over the frame's array.

The fold stays in the JVM.  Each step takes the item of greatest score plus ``weight`` times
1 - exp(-distance / scale), the distance to the nearest item chosen so far (capped), and updates the
distances of the rest by that item alone: a frame of n items costs n times the number chosen.
A frame is one row of the fold, so its candidates must fit in memory; frames are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAME = ["sequence_id", "time_s"]
FAR = 1e300


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[x] - b[x]) * (a[x] - b[x]) for x in ("x", "y", "z")), F.lit(0.0)))


def _moved(item: Column, d: Column) -> Column:
    return F.struct(*[item[c].alias(c) for c in ("score", "norm", "key", "x", "y", "z")], d.alias("d"))


def _utility(r: Column, weight: float, scale: float, cap: float) -> Column:
    d = F.least(r["d"], F.lit(float(cap))) if cap > 0 else r["d"]
    return r["norm"] + F.lit(float(weight)) * (1 - F.exp(-d / F.lit(max(float(scale), 1e-6))))


def greedy(pool: Column, chosen: Column, count: Column, weight: float, scale: float, cap: float) -> Column:
    """The items (score, norm, key, x, y, z, d) chosen from ``pool`` one by one, ``count`` of them at most, beside those of ``chosen``.

    Ties go to the greater score, then the smaller key.  An item's ``d`` is its distance when it was chosen.
    """

    def nearest(item: Column) -> Column:
        return F.aggregate(chosen, F.lit(FAR), lambda d, c: F.least(d, _apart(item, c)))

    def best_of(items: Column) -> Column:
        key = F.transform(items, lambda r: F.struct((-_utility(r, weight, scale, cap)).alias("u"), (-r["score"]).alias("s"), r["key"].alias("key"), r.alias("r")))
        return F.array_min(key)["r"]

    start = F.transform(pool, lambda r: _moved(r, nearest(r)))
    state = F.struct(start.alias("left"), F.slice(start, 1, 0).alias("got"))

    def step(acc: Column, _: Column) -> Column:
        best = best_of(acc["left"])
        # the best item is found once: it travels as an array of one
        return F.element_at(
            F.transform(
                F.array(best),
                lambda b: F.when(
                    b.isNotNull(),
                    F.struct(
                        F.transform(F.filter(acc["left"], lambda r: r["key"] != b["key"]), lambda r: _moved(r, F.least(r["d"], _apart(r, b)))).alias("left"),
                        F.concat(acc["got"], F.array(b)).alias("got"),
                    ),
                ).otherwise(acc),
            ),
            1,
        )

    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, state, step, lambda acc: acc["got"])


def _item(score: str, norm: Column, key: str) -> Column:
    return F.struct(F.col(score).cast("double").alias("score"), norm.cast("double").alias("norm"), F.col(key).alias("key"), *[F.col(f"{a}_m").cast("double").alias(a) for a in "xyz"], F.lit(FAR).alias("d"))


def _scaled(score: str, over: list[str]) -> Column:
    w = Window.partitionBy(*over)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(0.0)


def spatial_cap(df: DataFrame, most: int, per_source: int = 1, per_branch: int = 1, weight: float = 1.0, scale: float = 10.0, cap: float = 50.0, score: str = "score", key: str = "key") -> DataFrame:
    """(sequence_id, time_s, key, rank, reason, min_distance_m): at most ``most`` rows a frame.

    The best of each source and branch are protected and come first, by score.  If they fill the cap, they compete greedily
    for it (``protected_cap``); else the rest is filled greedily (``spatial_fill``).  Keys must be unique in a frame;
    rows without a score or position cannot be placed and go.
    """
    rows = df.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in (score, "x_m", "y_m", "z_m")))
    order = [F.col(score).desc(), F.col(key)]
    rank = lambda *k: F.row_number().over(Window.partitionBy(*FRAME, *k).orderBy(*order))
    rows = rows.withColumn("_p", (rank("source") <= per_source) | (rank("candidate_branch") <= per_branch)).withColumn("_norm", _scaled(score, FRAME))
    frames = rows.groupBy(*FRAME).agg(F.collect_list(F.struct("_p", _item(score, F.col("_norm"), key).alias("i"))).alias("all"))
    of = lambda p: F.transform(F.filter("all", lambda r: r["_p"] == p), lambda r: r["i"])
    by_score = F.array_sort(of(True), lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    frames = frames.select(*FRAME, by_score.alias("kept"), of(False).alias("rest"))
    full = F.size("kept") >= most
    none = F.slice("kept", 1, 0)
    # the first row of a frame without protected rows is its seed: the greedy step without distances picks it
    got = F.when(full, greedy(F.col("kept"), none, F.lit(most), weight, scale, cap)).otherwise(greedy(F.col("rest"), F.col("kept"), F.least(F.lit(most) - F.size("kept"), F.size("rest")), weight, scale, cap))
    frames = frames.withColumn("got", got).withColumn("first", F.when(full, none).otherwise(F.col("kept")))
    every = F.concat(
        F.transform("first", lambda r: F.struct(r["key"].alias("key"), F.lit("protected").alias("reason"), F.lit(None).cast("double").alias("d"))),
        F.transform("got", lambda r: F.struct(r["key"].alias("key"), F.when(full, "protected_cap").otherwise("spatial_fill").alias("reason"), F.when(r["d"] < FAR, r["d"]).alias("d"))),
    )
    out = frames.select(*FRAME, F.posexplode(every).alias("p", "r"))
    return out.select(*FRAME, F.col("r.key").alias("key"), (F.col("p") + 1).alias("rank"), F.col("r.reason").alias("reason"), F.col("r.d").alias("min_distance_m"))


def group_mass_topk(df: DataFrame, group: str, mass: float, least: int, most: int, siblings: int, temperature: float = 1.0, blend: float = 0.02, mode: str = "max", weight: float = 0.5, scale: float = 5.0, cap: float = 30.0, score: str = "score", key: str = "key") -> DataFrame:
    """(sequence_id, time_s, group, key, group_rank, sibling_rank, budget, retained_mass): whole groups of each frame up to a posterior mass.

    A group's score is its best member's (``max``) or the logarithm of the mean of exponentials (``logmeanexp``).
    Softmax over a frame's groups (blended with a uniform share) gives the number of groups, between ``least`` and ``most``; they are chosen
    greedily by scaled score against distance between their best members, and each gives its best ``siblings``.
    """
    if mode not in ("max", "logmeanexp"):
        raise ValueError(f"group score {mode!r}: max or logmeanexp")
    rows = df.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in (score, "x_m", "y_m", "z_m")))
    first = F.min_by(F.struct("x_m", "y_m", "z_m"), F.struct(-F.col(score), F.col(key)))
    top = F.max(score)
    value = top if mode == "max" else None
    at = [*FRAME, group]
    groups = rows.groupBy(*at).agg(top.alias("_top"), first.alias("_at"))
    if value is None:
        sums = rows.join(groups.select(*at, "_top"), at).groupBy(*at).agg((F.first("_top") + F.log(F.avg(F.exp(F.col(score) - F.col("_top"))))).alias("_score"))
        groups = groups.join(sums, at)
    else:
        groups = groups.withColumn("_score", F.col("_top"))
    groups = groups.select(*at, "_score", "_at.*").withColumn("_norm", _scaled("_score", FRAME))
    frame = Window.partitionBy(*FRAME)
    e = F.exp((F.col("_score") - F.max("_score").over(frame)) / F.lit(float(temperature)))
    groups = groups.withColumn("_e", e).withColumn("_n", F.count(F.lit(1)).over(frame))
    groups = groups.withColumn("_p", (1 - blend) * F.col("_e") / F.sum("_e").over(frame) + blend / F.col("_n"))
    falling = Window.partitionBy(*FRAME).orderBy(F.col("_p").desc(), F.col(group))
    groups = groups.withColumn("_i", F.row_number().over(falling)).withColumn("_sum", F.sum("_p").over(falling.rowsBetween(Window.unboundedPreceding, 0)))
    frames = groups.groupBy(*FRAME).agg(F.collect_list(_item("_score", F.col("_norm"), group)).alias("pool"), F.count(F.when(F.col("_sum") < mass - 1e-12, 1)).alias("_short"), F.sort_array(F.collect_list(F.struct("_i", "_sum"))).alias("_sums"))
    budget = F.least(F.greatest(F.col("_short") + 1, F.lit(least)), F.lit(most), F.size("pool")).cast("int")
    frames = frames.withColumn("budget", budget).withColumn("retained_mass", F.element_at("_sums", F.col("budget"))["_sum"])
    frames = frames.withColumn("got", greedy(F.col("pool"), F.slice("pool", 1, 0), F.col("budget"), weight, scale, cap))
    picked = frames.select(*FRAME, "budget", "retained_mass", F.posexplode("got").alias("p", "g")).select(*FRAME, F.col("g.key").alias(group), (F.col("p") + 1).alias("group_rank"), "budget", "retained_mass")
    own = rows.withColumn("sibling_rank", F.row_number().over(Window.partitionBy(*at).orderBy(F.col(score).desc(), F.col(key)))).where(F.col("sibling_rank") <= siblings)
    return own.select(*at, key, "sibling_rank").join(picked, at)
