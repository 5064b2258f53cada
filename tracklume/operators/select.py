"""Ranking and selection within frames: reservoirs, quotas, caps, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAME = ["sequence_id", "time_s"]


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best_per_frame(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return ranked(df, keys, order, "_rn").where("_rn = 1").drop("_rn")


def reservoir(df: DataFrame, global_n: int = 2, source_n: int = 1, branch_n: int = 1, cap: int | None = None, score: str = "score") -> DataFrame:
    """Union of each frame's top rows overall, per source and per branch, with reasons.

    With a cap, rows that a quota of a source or branch protects are kept before others;
    ``reservoir_rank`` is then by score over what is left.
    """
    order = [F.col(score).desc(), F.col("key")]
    over = lambda *k: F.row_number().over(Window.partitionBy(*FRAME, *k).orderBy(*order))
    r = df.withColumn("_g", over()).withColumn("_s", over("source")).withColumn("_b", over("candidate_branch"))
    reasons = F.array_compact(F.array(
        F.when(F.col("_g") <= global_n, F.lit("global_top_n")),
        F.when(F.col("_s") <= source_n, F.concat(F.lit("source:"), F.col("source"))),
        F.when(F.col("_b") <= branch_n, F.concat(F.lit("branch:"), F.col("candidate_branch"))),
    ))
    r = r.withColumn("reasons", F.array_join(reasons, "|")).withColumn("protected", (F.col("_s") <= source_n) | (F.col("_b") <= branch_n))
    r = r.where("reasons <> ''").drop("_g", "_s", "_b")
    if cap is not None:
        r = ranked(r, FRAME, [F.col("protected").desc(), *order], "_c").where(F.col("_c") <= cap).drop("_c")
    return ranked(r, FRAME, order, "reservoir_rank")


def cell_quota(df: DataFrame, n: int, score: Column, cells: list[str] | None = None) -> DataFrame:
    """Top rows of every (frame, source, branch) cell."""
    return ranked(df, [*FRAME, *(cells or ["source", "candidate_branch"])], [score, F.col("key")], "cell_rank").where(F.col("cell_rank") <= n)


def stratified(df: DataFrame, k: int, stratum: str, score: str = "score") -> DataFrame:
    """k rows per frame, dealt round robin over strata: every stratum's best comes before any second best."""
    r = ranked(df, [*FRAME, stratum], [F.col(score).desc(), F.col("key")], "_round")
    return ranked(r, FRAME, [F.col("_round"), F.col(score).desc(), F.col("key")], "pick").where(F.col("pick") <= k).drop("_round")


def group_topk(df: DataFrame, group: str, groups: int, siblings: int, score: str = "score") -> DataFrame:
    """Best groups of each frame by their best member, and the best members of each."""
    w = Window.partitionBy(*FRAME, group)
    r = df.withColumn("group_score", F.max(score).over(w))
    r = r.withColumn("group_rank", F.dense_rank().over(Window.partitionBy(*FRAME).orderBy(F.col("group_score").desc(), F.col(group))))
    return ranked(r.where(F.col("group_rank") <= groups), [*FRAME, group], [F.col(score).desc(), F.col("key")], "sibling_rank").where(F.col("sibling_rank") <= siblings)


def mass_topk(df: DataFrame, mass: float, least: int, most: int, scale: float, score: str = "score") -> DataFrame:
    """The smallest prefix of each frame whose softmax mass reaches the target, within bounds."""
    frame = Window.partitionBy(*FRAME)
    order = frame.orderBy(F.col(score).desc(), F.col("key"))
    e = F.exp((F.col(score) - F.max(score).over(frame)) / F.lit(scale))
    r = df.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(frame))
    r = r.withColumn("mass", F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("pick", F.row_number().over(order))
    budget = F.least(F.lit(most), F.greatest(F.lit(least), F.sum(F.when(F.col("mass") - F.col("p") < mass, 1).otherwise(0)).over(frame)))
    return r.withColumn("budget", budget).where(F.col("pick") <= F.col("budget")).drop("_e", "mass")


def ambiguity(df: DataFrame, scale: float, score: str = "score") -> DataFrame:
    """Per frame: softmax entropy, margin between the best two, effective number of candidates."""
    frame = Window.partitionBy(*FRAME)
    e = F.exp((F.col(score) - F.max(score).over(frame)) / F.lit(scale))
    r = df.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(frame))
    r = ranked(r, FRAME, [F.col(score).desc(), F.col("key")], "_rn")
    top = lambda k: F.max(F.when(F.col("_rn") == k, F.col(score)))
    return r.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("n"),
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("entropy"),
        (top(1) - top(2)).alias("margin"),
        (1 / F.sum(F.col("p") * F.col("p"))).alias("effective_n"),
    )


def diversity_cap(df: DataFrame, most: int, per_source: int = 1, per_branch: int = 1, score: str = "score") -> DataFrame:
    """At most ``most`` rows a frame: the best of each source and branch are reserved, the rest is filled by score.

    Where more rows are reserved than fit, the first of rare sources and branches go before those of common ones.
    """
    order = [F.col(score).desc(), F.col("key")]
    r = ranked(ranked(df, [*FRAME, "source"], order, "_s"), [*FRAME, "candidate_branch"], order, "_b")
    size = lambda *k: F.count(F.lit(1)).over(Window.partitionBy(*FRAME, *k))
    r = r.withColumn("reserved", (F.col("_s") <= per_source) | (F.col("_b") <= per_branch)).withColumn("_rare", F.when(F.col("reserved"), F.least(size("source"), size("candidate_branch"))).otherwise(0))
    return ranked(r, FRAME, [F.col("reserved").desc(), F.col("_rare"), *order], "pick").where(F.col("pick") <= most).drop("_s", "_b", "_rare")


def leaderboard(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows ranked 1..n; a leaderboard is small, one row per method."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def eligible_rank(df: DataFrame, ok: Column, order: list[Column]) -> DataFrame:
    """Rank among the rows that meet the constraints; null for the others."""
    w = Window.partitionBy("eligible").orderBy(*order)
    return df.withColumn("eligible", F.coalesce(ok, F.lit(False))).withColumn("rank", F.when(F.col("eligible"), F.row_number().over(w)))


def pareto(df: DataFrame, a: str, b: str) -> DataFrame:
    """Flag rows that no other row beats in both columns (lower is better), by one sorted pass."""
    least = df.groupBy(a).agg(F.min(b).alias("_own")).withColumn("_before", F.min("_own").over(Window.orderBy(a).rowsBetween(Window.unboundedPreceding, -1)))
    flag = (F.col(b) == F.col("_own")) & F.coalesce(F.col("_before") > F.col(b), F.lit(True))
    return df.join(least, a).withColumn("pareto", flag).drop("_own", "_before")
