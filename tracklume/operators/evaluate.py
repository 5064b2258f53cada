"""Scoring of results against truth: matching protocols, error summaries, intervals, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import distance
from . import aggregates as G
from .calibrate import draw
from .joins import asof_nearest, interpolated
from .matching import optimal_times
from .slices import LEAST, same_keys, sliced

AXES = ["x_m", "y_m", "z_m"]


def _errors(df: DataFrame, axes: list[str], other: str) -> DataFrame:
    """error_2d_m (the first two axes) and error_3d_m (all) against columns named by ``other``."""
    at = lambda names: distance([F.col(a) for a in names], [F.col(other.format(a)) for a in names])
    return df.withColumn("error_2d_m", at(axes[:2])).withColumn("error_3d_m", at(axes))


def errors_at_estimates(estimates: DataFrame, truth: DataFrame, keys: list[str], axes: list[str] = AXES, max_delta: float | None = None) -> DataFrame:
    """Each estimate (duplicates too) against the truth nearest in time."""
    d = asof_nearest(estimates, truth, keys, payload=[*axes, "key"], order="key", tolerance=max_delta).where("match IS NOT NULL")
    return _errors(d, axes, "match.{}").drop("match")


def labelled(features: DataFrame, truth: DataFrame, keys: list[str], good_m: float, max_delta: float, axes: list[str] = AXES) -> DataFrame:
    """Features with their distance to the truth nearest in time and whether it is good; null where there is no truth near enough."""
    d = asof_nearest(features, truth, keys, payload=[*axes, "key"], order="key", tolerance=max_delta)
    d = d.withColumn("residual_m", distance([F.col(a) for a in axes], [F.col(f"match.{a}") for a in axes])).drop("match")
    return d.withColumn("good", F.col("residual_m") <= good_m)


def errors_at_times(estimates: DataFrame, truth: DataFrame, keys: list[str], axes: list[str] = AXES, max_delta: float | None = None) -> DataFrame:
    """Each estimate against the truth's line at its time; none outside the truth's span."""
    d = interpolated(estimates, truth.select(*keys, "time_s", *axes, "key"), keys, axes, max_delta=max_delta, order="key")
    return _errors(d.where(F.col(f"{axes[0]}_at").isNotNull()), axes, "{}_at").drop(*[f"{a}_at" for a in axes])


def errors_on_truth(estimates: DataFrame, truth: DataFrame, keys: list[str], axes: list[str] = AXES, max_delta: float | None = None) -> DataFrame:
    """Each truth row against the estimates' line at its time; none outside the estimates' span."""
    return errors_at_times(truth, estimates, keys, axes, max_delta)


def planar_and_spatial(df: DataFrame, keys: list[str]) -> DataFrame:
    """count, mean, RMSE, 95th percentile and maximum of error_2d_m and error_3d_m: per key and pooled (null key)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for e in ("error_2d_m", "error_3d_m"):
        c = F.col(e)
        aggs += [F.avg(c).alias(f"{e}_mean"), F.sqrt(F.avg(c * c)).alias(f"{e}_rmse"), F.percentile(c, 0.95).alias(f"{e}_p95"), F.max(c).alias(f"{e}_max")]
    return df.groupingSets([[], [F.col(k) for k in keys]], *[F.col(k) for k in keys]).agg(*aggs)


def nearest_matches(results: DataFrame, truth: DataFrame, max_delta: float, axes: list[str] = AXES) -> DataFrame:
    """Results (sequence_id, time_s, key, label, axes), many to one: the nearest truth within the gate, or the reason for none."""
    d = asof_nearest(results, truth, ["sequence_id"], payload=[*axes, "label", "key"], order="key")
    delta = F.col("time_s") - F.col("match.t")
    reason = F.when(F.col("match").isNull(), "missing_sequence_truth").when(F.abs(delta) > max_delta, "time_delta_exceeded")
    d = d.withColumn("reason", reason).withColumn("matched", F.col("reason").isNull())
    d = _errors(d, axes, "match.{}")
    hit = lambda c: F.when(F.col("matched"), c)
    return d.select(
        "sequence_id", "time_s", "key", "matched", "reason", delta.alias("time_delta_s"),
        hit(F.col("error_2d_m")).alias("error_2d_m"), hit(F.col("error_3d_m")).alias("error_3d_m"), hit(F.col("label") == F.col("match.label")).alias("label_correct"),
    )


def aligned_matches(results: DataFrame, truth: DataFrame, tolerance: float, axes: list[str] = AXES) -> DataFrame:
    """Truth rows one to one with results whose time differs by no more than the tolerance: most pairs, then least difference.

    Rows without a partner stay, with ``missing_prediction``, ``extra_prediction`` (no truth within the tolerance) or
    ``duplicate_prediction`` (truth there has other results).  Keys must be unique within a sequence of either side.
    """
    side = lambda d, tag: d.select("sequence_id", F.col("key").alias(f"_{tag}"), F.struct("time_s", "key", "label", *axes).alias(tag))
    pairs = optimal_times(truth, results, ["sequence_id"], tolerance).select("sequence_id", F.col("key").alias("_truth"), F.col("match_key").alias("_result"))
    # the truth around each result, partner or not
    near = asof_nearest(results.select("sequence_id", "time_s", "key"), truth.select("sequence_id", "time_s", F.lit(1).alias("one")), ["sequence_id"], payload=["one"], tolerance=tolerance)
    known = near.select("sequence_id", F.col("key").alias("_result"), F.col("match").isNotNull().alias("_k"))
    results = side(results, "result").join(known, ["sequence_id", "_result"]).join(pairs, ["sequence_id", "_result"], "left")
    both = side(truth, "truth").join(results.where("_truth IS NOT NULL"), ["sequence_id", "_truth"], "left").select("sequence_id", "truth", "result", "_k")
    both = both.unionByName(results.where("_truth IS NULL").select("sequence_id", F.lit(None).cast(both.schema["truth"].dataType).alias("truth"), "result", "_k"))
    reason = F.when(F.col("result").isNull(), "missing_prediction").when(F.col("truth").isNull(), F.when(F.col("_k"), "duplicate_prediction").otherwise("extra_prediction"))
    far = lambda names: distance([F.col(f"result.{a}") for a in names], [F.col(f"truth.{a}") for a in names])
    return both.select(
        "sequence_id", F.coalesce("truth.time_s", "result.time_s").alias("time_s"), F.coalesce("truth.key", "result.key").alias("key"), reason.isNull().alias("matched"), reason.alias("reason"),
        far(axes[:2]).alias("error_2d_m"), far(axes).alias("error_3d_m"), (F.col("result.label") == F.col("truth.label")).alias("label_correct"),
    )


def result_scores(matches: DataFrame) -> DataFrame:
    """Per sequence and pooled: matched and unmatched counts, mean square and average error, error at the last time, label accuracy, blockers."""
    e = F.col("error_3d_m")
    count = lambda c: F.count(F.when(c, 1))
    aggs = [
        count(F.col("matched")).alias("matched_n"),
        *[count(F.col("reason") == r).alias(f"{r}_n") for r in ("missing_prediction", "extra_prediction", "duplicate_prediction", "time_delta_exceeded", "missing_sequence_truth")],
        F.avg(e * e).alias("mse"),
        F.avg(e).alias("ade"),
        F.max_by(e, F.when(F.col("matched"), F.struct("time_s", "key"))).alias("fde"),
        F.avg(F.col("label_correct").cast("double")).alias("label_accuracy"),
    ]
    out = matches.groupingSets([[], [F.col("sequence_id")]], F.col("sequence_id")).agg(*aggs)
    return out.withColumn("ready", (F.col("matched_n") > 0) & (F.col("missing_prediction_n") + F.col("extra_prediction_n") + F.col("duplicate_prediction_n") == 0))


def coverage(matches: DataFrame, truth: DataFrame, results: DataFrame) -> DataFrame:
    """Per sequence: matched shares of truth and of results, with RMSE; sequences of either side stay."""
    n = lambda d, name: d.groupBy("sequence_id").agg(F.count(F.lit(1)).alias(name))
    m = matches.where("matched").groupBy("sequence_id").agg(F.count(F.lit(1)).alias("matched_n"), F.sqrt(F.avg(F.col("error_3d_m") * F.col("error_3d_m"))).alias("rmse"))
    d = n(truth, "truth_n").join(n(results, "result_n"), "sequence_id", "full_outer").join(m, "sequence_id", "left").fillna(0, ["truth_n", "result_n", "matched_n"])
    return d.withColumn("truth_share", F.try_divide("matched_n", "truth_n")).withColumn("result_share", F.try_divide("matched_n", "result_n"))


def class_audit(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per true class: rows, recall, precision, the class it is mistaken for most often (ties: the first)."""
    c = G.confusion(df.where(F.col(truth).isNotNull()), truth, guess)
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
    wrong = F.when(~F.col("truth").eqNullSafe(F.col("guess")), F.struct(-F.col("n"), F.col("guess")))
    rows = c.groupBy("truth").agg(F.sum("n").alias("rows"), F.sum(hit).alias("hits"), F.min_by("guess", wrong).alias("mistaken_for"))
    cols = c.groupBy(F.col("guess").alias("truth")).agg(F.sum("n").alias("guessed"))
    return rows.join(cols, "truth", "left").select("truth", "rows", "hits", (F.col("hits") / F.col("rows")).alias("recall"), F.try_divide("hits", "guessed").alias("precision"), "mistaken_for")


def block_bootstrap(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, resamples: int, confidence: float = 0.95, seed: int = 0, slices: int | None = None, least: int = LEAST) -> DataFrame:
    """Interval of a mean from contiguous blocks drawn with replacement.

    A block is a sum and a count, so a resample is an aggregate of blocks, not of rows: each block
    is drawn as often as seeded hashes of (resample, slot) point to it.  With ``slices`` a key with a large share of
    all rows is numbered in slices of the first column of ``order``, a number that is never null or NaN.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))).select(*dict.fromkeys([*keys, *order, value]))
    if slices:
        rows = sliced(rows, keys, order[0], slices, least)
        sizes = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
        before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
        sizes = sizes.select(*[F.col(k).alias(f"{k}_e") for k in [*keys, "_slice"]], F.coalesce(before, F.lit(0)).alias("_before")).where("_before > 0")
        rows = rows.join(F.broadcast(sizes), same_keys([*keys, "_slice"], "_e"), "left")
        number = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)) + F.coalesce("_before", F.lit(0))
    else:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    b = rows.withColumn("block", F.floor((number - 1) / size)).groupBy(*keys, "block").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    total = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), (F.sum("s") / F.sum("c")).alias("estimate"), F.sum("c").alias("n"))
    drawn_block = F.floor(draw(seed, *[F.col(k) for k in keys], F.col("resample"), F.col("slot")) * F.col("blocks")).cast("long").alias("block")
    slots = total.select(*keys, "blocks", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    # few short rows of much work: a given number of partitions is not put together again
    slots = slots.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "resample")
    slots = slots.select(*keys, "blocks", "resample", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks"))).alias("slot")).select(*keys, "resample", drawn_block)
    means = slots.join(b, [*keys, "block"]).groupBy(*keys, "resample").agg((F.sum("s") / F.sum("c")).alias("m"))
    tail = (1 - confidence) / 2
    bounds = means.groupBy(*keys).agg(F.percentile("m", tail).alias("lower"), F.percentile("m", 1 - tail).alias("upper"))
    return total.join(bounds, keys).select(*keys, "n", "blocks", "estimate", "lower", "upper")


def guarded_tournament(scores: DataFrame, baseline: str, objective: str, guards: dict[str, float], expected: int, seed: int = 0, resamples: int = 500) -> DataFrame:
    """Scores (method, sequence_id, objective, guard columns) -> a row per method: gains over the baseline, reasons against it, rank.

    A method is rejected if it lacks sequences, its mean gain is not positive, the lower bound of
    the paired bootstrap of gains is negative, or a guard's mean falls by more than its allowance.
    """
    base = scores.where(F.col("method") == baseline).select("sequence_id", *[F.col(c).alias(f"_{c}") for c in (objective, *guards)])
    d = scores.join(base, "sequence_id").withColumn("gain", F.col(objective) - F.col(f"_{objective}"))
    g = d.groupBy("method").agg(F.count(F.lit(1)).alias("sequences"), F.avg("gain").alias("mean_gain"), *[F.avg(F.col(c) - F.col(f"_{c}")).alias(f"{c}_gain") for c in guards])
    low = block_bootstrap(d, ["method"], ["sequence_id"], "gain", 1, resamples, seed=seed).select("method", "lower")
    out = g.join(low, "method", "left")
    tests = [(F.col("sequences") < expected, "incomplete"), (F.col("mean_gain") <= 0, "no_gain"), (F.col("lower") < 0, "uncertain_gain"), *[(F.col(f"{c}_gain") < -a, f"{c}_guard") for c, a in guards.items()]]
    reasons = F.array_join(F.array_compact(F.array(*[F.when(test, name) for test, name in tests])), ";")
    out = out.withColumn("reasons", reasons).withColumn("accepted", (F.col("reasons") == "") & (F.col("method") != baseline))
    w = Window.partitionBy("accepted").orderBy(F.col("mean_gain").desc(), "method")  # one row per method
    return out.withColumn("rank", F.when(F.col("accepted"), F.row_number().over(w)))


def risk_summary(folds: DataFrame, keys: list[str], metric: str, aversion: float, tail: float) -> DataFrame:
    """Per configuration over folds: mean, upper quantile and (1 - aversion) * mean + aversion * quantile, ranked (least first)."""
    g = folds.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), F.avg(metric).alias("mean"), F.percentile(metric, tail).alias("tail"))
    g = g.withColumn("risk", (1 - aversion) * F.col("mean") + aversion * F.col("tail"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("risk", "mean", *keys)))


def artifact_checks(df: DataFrame, required: list[str], keys: list[str], time: str = "time_s", most_missing: float = 0.05, ordinal: str | None = None) -> DataFrame:
    """One row per check of a run's table: column present, share of missing values, times that do not go back.

    The order of times is checked along ``ordinal`` (rows of a table have no order of their own); without it the check is there with
    neither value nor verdict.
    """
    absent = [c for c in required if c not in df.columns]
    there = [c for c in required if c in df.columns]
    missing = lambda c: (F.col(c).isNull() | F.isnan(F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).isNull())
    w = Window.partitionBy(*keys).orderBy(ordinal) if ordinal else None
    d = df.withColumn("_back", (F.col(time) < F.lag(time).over(w)) if w is not None else F.lit(False))
    aggs = [F.avg(missing(c).cast("double")).alias(f"missing_{c}") for c in there]
    one = d.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_back"), 1)).alias("back"), *aggs)
    check = lambda name, value, ok: F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), ok.cast("boolean").alias("ok"))
    order = check("time_order", F.col("back"), F.col("back") == 0) if ordinal else check("time_order", F.lit(None), F.lit(None))
    checks = [check("rows", F.col("rows"), F.col("rows") > 0), order]
    checks += [check(f"missing:{c}", F.col(f"missing_{c}"), F.coalesce(F.col(f"missing_{c}") <= most_missing, F.lit(False))) for c in there]
    checks += [check(f"absent:{c}", F.lit(1), F.lit(False)) for c in absent]
    return one.select(F.inline(F.array(*checks)))


def leakage(metadata: DataFrame, heldout: str, allowed: list[str] | None = None) -> DataFrame:
    """Rows (path, value) of nested metadata whose text names the held-out flight outside of test paths."""
    low, text = F.lower("path"), F.lower(F.col("value").cast("string"))
    hit = text.contains(heldout.lower()) & ~low.contains("heldout") & ~low.contains("test")
    for prefix in allowed or []:
        hit = hit & ~F.col("path").startswith(prefix)
    training = low.contains("train") | low.contains("model") | low.contains("calib") | low.contains("fit")
    return metadata.where(hit).select("path", "value", F.when(training, "training").otherwise("metadata").alias("reason"))


def flattened(df: DataFrame, payload: Column, rounds: int = 6) -> DataFrame:
    """JSON texts -> (path, value) of their strings, numbers and flags, nested up to ``rounds`` levels."""
    d = df.select(F.lit("").alias("path"), F.try_parse_json(payload).alias("v"))
    leaf = lambda c: F.schema_of_variant(c).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|BOOLEAN|DATE|TIMESTAMP)")
    out = None
    for _ in range(rounds):
        step = d.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        name = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key")))
        d = step.select(name.alias("path"), F.col("value").alias("v"))
        found = d.where(leaf(F.col("v"))).select("path", F.try_variant_get("v", "$", "string").alias("value"))
        out = found if out is None else out.unionByName(found)
    return out


def candidate_pools(pools: DataFrame, reference: DataFrame, names: list[str], top: int) -> DataFrame:
    """Pools (pool, sequence_id, time_s, rank, error) against reference frames: a row per pool and frame, absent frames kept."""
    frames = reference.select("sequence_id", "time_s", F.col("error").alias("reference_error"))
    f = pools.groupBy("pool", "sequence_id", "time_s").agg(F.min("error").alias("best"), F.min(F.when(F.col("rank") <= top, F.col("error"))).alias("best_top"))
    every = frames.withColumn("pool", F.explode(F.array(*[F.lit(n) for n in names])))
    d = every.join(f, ["pool", "sequence_id", "time_s"], "left")
    return d.withColumn("absent", F.col("best").isNull()).withColumn("delta", F.col("best") - F.col("reference_error"))


def relabelled(results: DataFrame, source: DataFrame, mode: str = "by-key", max_delta: float | None = None) -> DataFrame:
    """results (sequence_id, time_s, key, label) with ``source_label`` and ``source_delta_s`` of another table (sequence_id, time_s, key, label).

    ``by-key``: the row of the same sequence and time (of several, the one of the greatest key); ``by-nearest-time``: the nearest row of the sequence, within
    ``max_delta`` if that is given (ties: the earlier); ``by-sequence-majority``: the sequence's commonest label (ties: the first).
    """
    if mode == "by-sequence-majority":
        m = G.class_vote(source, ["sequence_id"], "label", F.lit(1.0)).select("sequence_id", F.col("label").alias("source_label"))
        return results.join(m, "sequence_id", "left").withColumn("source_delta_s", F.lit(None).cast("double"))
    if mode not in ("by-key", "by-nearest-time"):
        raise ValueError(f"unknown mode {mode!r}")
    d = asof_nearest(results, source.select("sequence_id", "time_s", F.col("label").alias("other"), "key"), ["sequence_id"], payload=["other", "key"], order="key", tolerance=0.0 if mode == "by-key" else None)
    delta = F.col("match.t") - F.col("time_s")
    label = F.col("match.other") if max_delta is None else F.when(F.abs(delta) <= max_delta, F.col("match.other"))
    return d.withColumn("source_label", label).withColumn("source_delta_s", delta).drop("match")
