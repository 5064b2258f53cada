"""Further queries: schedules, coverage, quotas by consensus, suppression, time assignment."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import joins as J
from ..operators import kernels as K
from ..operators import select as S
from ..operators import sequence as Q
from ..operators import windows as W
from .reference import longs, query, r6
from .views import CANDIDATES, TRAJECTORIES, candidates, trajectories

ORDER = "(PARTITION BY sequence_id ORDER BY time_s, key"


@query(f"""WITH {TRAJECTORIES} SELECT key, round(least(greatest(sqrt(CASE WHEN count(x_m) OVER t >= 3 THEN quantile_cont(x_m, 0.5) OVER t ELSE quantile_cont(x_m, 0.5) OVER e END), 1), 18)
 * CASE WHEN time_s - lag(time_s) OVER {ORDER}) > 200 THEN 1.5 ELSE 1 END, 6) AS accel_std FROM traj
WINDOW t AS {ORDER} ROWS 4 PRECEDING), e AS {ORDER} ROWS UNBOUNDED PRECEDING)""")
def process_noise_schedule(spark, sf):
    w = Window.partitionBy("sequence_id").orderBy("time_s", "key")
    d = trajectories(spark, sf)
    d = d.withColumn("m", W.trailing_median(d, ["sequence_id"], ["time_s", "key"], "x_m", 5, 3)).withColumn("gap", F.col("time_s") - F.lag("time_s").over(w))
    scale = F.least(F.greatest(F.sqrt("m"), F.lit(1.0)), F.lit(18.0)) * F.when(F.col("gap") > 200, 1.5).otherwise(1.0)
    return d.select("key", r6(scale).alias("accel_std"))


GATES = {0.5: K.chi2_quantile(0.5, 2), 0.9: K.chi2_quantile(0.9, 2), 0.99: K.chi2_quantile(0.99, 2)}
NIS = "(x_m * x_m / 625 + y_m * y_m / 25)"


@query(
    f"WITH {CANDIDATES} SELECT source, count(*) AS n, "
    + ", ".join(f"round(avg(CASE WHEN {NIS} <= {v!r} THEN 1.0 ELSE 0.0 END), 6) AS inside_{int(100 * p)}" for p, v in GATES.items())
    + " FROM cand GROUP BY source"
)
def nis_reliability(spark, sf):
    nis = F.col("x_m") * F.col("x_m") / 625 + F.col("y_m") * F.col("y_m") / 25
    return candidates(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg((nis <= v).cast("double"))).alias(f"inside_{int(100 * p)}") for p, v in GATES.items()])


@query(f"""WITH {CANDIDATES}, p AS (SELECT a.key, b.source AS s, sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2 + (a.z_m - b.z_m) ** 2) AS d
FROM cand a JOIN cand b ON a.sequence_id = b.sequence_id AND a.source <> b.source AND abs(a.time_s - b.time_s) <= 1),
s AS (SELECT cand.*, count(d) AS nb FROM cand LEFT JOIN p ON cand.key = p.key AND d <= 6 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY score DESC, key) AS g, row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY nb DESC, score DESC, key) AS c FROM s)
SELECT key, g <= 2 AS by_score, nb >= 1 AND c <= 2 AS by_consensus FROM r WHERE g <= 2 OR (nb >= 1 AND c <= 2)""")
def consensus_quota_reservoir(spark, sf):
    c = J.branch_consensus(candidates(spark, sf), 1.0, 6.0)
    c = S.ranked(c, S.FRAME, [F.col("score").desc(), F.col("key")], "g")
    c = S.ranked(c, S.FRAME, [F.col("neighbors").desc(), F.col("score").desc(), F.col("key")], "c")
    by_score, by_consensus = F.col("g") <= 2, (F.col("neighbors") >= 1) & (F.col("c") <= 2)
    return c.where(by_score | by_consensus).select("key", by_score.alias("by_score"), by_consensus.alias("by_consensus"))


@query(f"""WITH {CANDIDATES}, e AS (SELECT sequence_id, time_s, avg(x_m) AS x FROM cand GROUP BY 1, 2), o AS (SELECT sequence_id, round(time_s, 6) AS t, min(x_m) AS best, max(x_m) AS worst FROM cand GROUP BY 1, 2)
SELECT sequence_id, t AS time_s, round(abs(x - best), 6) AS gap_best, round((x - best) ** 2 / count(*) OVER (), 9) AS mse_share FROM e JOIN o USING (sequence_id) WHERE round(time_s, 6) = t""")
def frame_gap_table(spark, sf):
    c = candidates(spark, sf)
    e = c.groupBy(*S.FRAME).agg(F.avg("x_m").alias("x")).withColumn("t", F.round("time_s", 6)).drop("time_s")
    o = c.groupBy("sequence_id", F.round("time_s", 6).alias("t")).agg(F.min("x_m").alias("best"))
    gap = F.col("x") - F.col("best")
    return e.join(o, ["sequence_id", "t"]).select("sequence_id", F.col("t").alias("time_s"), r6(F.abs(gap)).alias("gap_best"), F.round(gap * gap / F.count(F.lit(1)).over(Window.partitionBy()), 9).alias("mse_share"))


@query(f"""WITH {CANDIDATES}, s AS (SELECT *, x_m <= 40 AS gate FROM cand), f AS (SELECT sequence_id, source, count(*) AS rows_all, count(*) FILTER (gate) AS rows_gated, max(time_s) - min(time_s) AS span, avg(y_m) AS p FROM s GROUP BY 1, 2)
SELECT sequence_id, source, rows_all, rows_gated FROM f QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY rows_gated DESC, span DESC, p DESC, source) = 1""")
def paper_track_stages(spark, sf):
    """Gate first, then the largest track by rows, duration and mean probability."""
    f = candidates(spark, sf).groupBy("sequence_id", "source").agg(F.count(F.lit(1)).alias("rows_all"), F.count(F.when(F.col("x_m") <= 40, 1)).alias("rows_gated"), (F.max("time_s") - F.min("time_s")).alias("span"), F.avg("y_m").alias("p"))
    return S.best_per_frame(f, ["sequence_id"], [F.col("rows_gated").desc(), F.col("span").desc(), F.col("p").desc(), F.col("source")]).select("sequence_id", "source", "rows_all", "rows_gated")


@query(f"""WITH {CANDIDATES}, d AS (SELECT sequence_id, sum(x_m) AS mass, source FROM cand GROUP BY 1, 3) SELECT sequence_id, source, round(mass / sum(mass) OVER (PARTITION BY sequence_id), 6) AS usage, row_number() OVER (PARTITION BY sequence_id ORDER BY mass DESC, source) AS rank FROM d""")
def assignment_usage(spark, sf):
    d = candidates(spark, sf).groupBy("sequence_id", "source").agg(F.sum("x_m").alias("mass"))
    w = Window.partitionBy("sequence_id")
    out = d.select("sequence_id", "source", r6(F.col("mass") / F.sum("mass").over(w)).alias("usage"), F.row_number().over(w.orderBy(F.col("mass").desc(), "source")).alias("rank"))
    return longs(out, "rank")


@query()
def spatial_diversity(spark, sf):
    return Q.diversified(candidates(spark, sf), S.FRAME, "score", 8.0, 4)
