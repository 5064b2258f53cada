"""Queries of evaluation, repair, association, normalising and fitted corrections, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as A
from ..operators import calibrate as C
from ..operators import evaluate as E
from ..operators import models as M
from ..operators import normalize as N
from ..operators import repair as R
from ..operators import select as S
from ..operators import sequence as Q
from ..operators import windows as W
from .reference import BRACKET, _clicks, longs, query, r6, rounded
from .reference_more import ORACLE, RESAMPLE, TEMPLATE, _single, _with_truth, draw_sql
from .views import CANDIDATES, MEASUREMENTS, TRAJECTORIES, candidates, table, trajectories

XY = ["x_m", "y_m"]
FRAME = ["sequence_id", "time_s"]

# --- evaluation

LABEL = "CASE WHEN {} > 50 THEN 'a' ELSE 'b' END"


def _results(spark, sf):
    a, b = _clicks(spark, sf)
    label = F.when(F.col("x_m") > 50, "a").otherwise("b")
    b = b.groupBy("sequence_id", "time_s").agg(F.max_by("x_m", "key").alias("x_m"), F.max_by("y_m", "key").alias("y_m"), F.max("key").alias("key"))
    return a.withColumn("label", label), b.withColumn("label", label)


@query(f"""WITH {MEASUREMENTS}, {BRACKET}, m AS (SELECT *, coalesce(abs(time_s - tm) <= 200000, false) AS ok, sqrt((x_m - xm) ** 2 + (y_m - ym) ** 2) AS e FROM near)
SELECT sequence_id, count(*) FILTER (ok) AS matched_n, count(*) FILTER (NOT ok AND tm IS NOT NULL) AS time_delta_exceeded_n, count(*) FILTER (tm IS NULL) AS missing_sequence_truth_n,
round(avg(e * e) FILTER (ok), 9) AS mse, round(avg(e) FILTER (ok), 9) AS ade, round(arg_max(e, (time_s, key)) FILTER (ok), 9) AS fde, round(avg(CASE WHEN {LABEL.format('x_m')} = {LABEL.format('xm')} THEN 1.0 ELSE 0.0 END) FILTER (ok), 6) AS label_accuracy
FROM m GROUP BY GROUPING SETS ((), (sequence_id))""")
def result_evaluation(spark, sf):
    a, b = _results(spark, sf)
    out = E.result_scores(E.nearest_matches(a, b, 200_000.0, XY))
    out = out.select("sequence_id", "matched_n", "time_delta_exceeded_n", "missing_sequence_truth_n", "mse", "ade", "fde", "label_accuracy")
    return rounded(rounded(out, "mse", "ade", "fde", n=9), "label_accuracy")


def _aligned(spark, sf):
    c = candidates(spark, sf).withColumn("label", F.col("candidate_branch"))
    return c.where("source = 'A'"), S.best_per_frame(c.where("source <> 'A'"), FRAME, [F.col("key")])


ALIGNED = """res AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY key) AS n FROM cand WHERE source = 'A'),
tru AS (SELECT *, 1 AS n FROM cand WHERE source <> 'A' QUALIFY row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY key) = 1),
al AS (SELECT coalesce(r.sequence_id, t.sequence_id) AS sequence_id, coalesce(t.time_s, r.time_s) AS time_s, coalesce(t.key, r.key) AS key, r.key AS rk, t.key AS tk, sqrt((r.x_m - t.x_m) ** 2 + (r.y_m - t.y_m) ** 2 + (r.z_m - t.z_m) ** 2) AS e,
 CASE WHEN r.candidate_branch = t.candidate_branch THEN 1.0 WHEN r.candidate_branch <> t.candidate_branch THEN 0.0 END AS l, (coalesce(r.sequence_id, t.sequence_id), coalesce(t.time_s, r.time_s)) IN (SELECT (sequence_id, time_s) FROM tru) AS known
 FROM res r FULL JOIN tru t ON r.sequence_id = t.sequence_id AND r.time_s = t.time_s AND r.n = t.n)"""


@query(f"""WITH {CANDIDATES}, {ALIGNED} SELECT sequence_id, count(*) FILTER (rk IS NOT NULL AND tk IS NOT NULL) AS matched_n, count(*) FILTER (rk IS NULL) AS missing_prediction_n, count(*) FILTER (tk IS NULL AND NOT known) AS extra_prediction_n,
count(*) FILTER (tk IS NULL AND known) AS duplicate_prediction_n, round(avg(e * e), 6) AS mse, round(avg(e), 6) AS ade, round(avg(l), 6) AS label_accuracy FROM al GROUP BY GROUPING SETS ((), (sequence_id))""")
def aligned_evaluation(spark, sf):
    out = E.result_scores(E.aligned_matches(*_aligned(spark, sf), 1e-6))
    return rounded(out.select("sequence_id", "matched_n", "missing_prediction_n", "extra_prediction_n", "duplicate_prediction_n", "mse", "ade", "label_accuracy"), "mse", "ade", "label_accuracy")


@query(f"""WITH {CANDIDATES}, {ALIGNED}, m AS (SELECT sequence_id, count(*) AS n FROM al WHERE rk IS NOT NULL AND tk IS NOT NULL GROUP BY 1), r AS (SELECT sequence_id, count(*) AS n FROM res GROUP BY 1), t AS (SELECT sequence_id, count(*) AS n FROM tru GROUP BY 1)
SELECT sequence_id, coalesce(t.n, 0) AS truth_n, coalesce(r.n, 0) AS result_n, coalesce(m.n, 0) AS matched_n, round(coalesce(m.n, 0) / t.n, 6) AS truth_share, round(coalesce(m.n, 0) / r.n, 6) AS result_share FROM t FULL JOIN r USING (sequence_id) LEFT JOIN m USING (sequence_id)""")
def match_coverage(spark, sf):
    r, t = _aligned(spark, sf)
    return rounded(E.coverage(E.aligned_matches(r, t, 1e-6), t, r).drop("rmse"), "truth_share", "result_share")


@query(f"""WITH {MEASUREMENTS}, {BRACKET}, a AS (SELECT sequence_id, sqrt((x_m - xm) ** 2 + (y_m - ym) ** 2) AS e FROM near WHERE abs(tm - time_s) <= 200000),
b AS (SELECT sequence_id, CASE WHEN t0 = time_s THEN 0 ELSE (time_s - t0) / (t1 - t0) END AS w, * FROM br WHERE t0 = time_s OR (t1 IS NOT NULL AND t0 IS NOT NULL)),
c AS (SELECT sequence_id, sqrt((x_m - x0 - coalesce(w * (x1 - x0), 0)) ** 2 + (y_m - y0 - coalesce(w * (y1 - y0), 0)) ** 2) AS e FROM b)
SELECT 'nearest' AS mode, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse FROM a UNION ALL SELECT 'line', count(*), round(sqrt(avg(e * e)), 6) FROM c""")
def position_errors(spark, sf):
    a, b = _clicks(spark, sf)
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias("n"), r6(F.sqrt(F.avg(F.col("error_3d_m") * F.col("error_3d_m")))).alias("rmse")).select(F.lit(name).alias("mode"), "n", "rmse")
    return one(E.errors_at_estimates(a, b, ["sequence_id"], XY, 200_000.0), "nearest").unionByName(one(E.errors_at_times(a, b, ["sequence_id"], XY), "line"))


@query(f"""WITH {CANDIDATES}, e AS (SELECT sequence_id, sqrt((x_m - 25) ** 2 + (y_m - 5) ** 2) AS a, sqrt((x_m - 25) ** 2 + (y_m - 5) ** 2 + (z_m - 4) ** 2) AS b FROM cand)
SELECT sequence_id, count(*) AS n, round(avg(a), 6) AS error_2d_m_mean, round(sqrt(avg(a * a)), 6) AS error_2d_m_rmse, round(quantile_cont(a, 0.95), 6) AS error_2d_m_p95, round(max(a), 6) AS error_2d_m_max,
round(avg(b), 6) AS error_3d_m_mean, round(sqrt(avg(b * b)), 6) AS error_3d_m_rmse, round(quantile_cont(b, 0.95), 6) AS error_3d_m_p95, round(max(b), 6) AS error_3d_m_max FROM e GROUP BY GROUPING SETS ((), (sequence_id))""")
def tracker_metrics(spark, sf):
    d = candidates(spark, sf).withColumns({"tx": F.lit(25.0), "ty": F.lit(5.0), "tz": F.lit(4.0)})
    d = E._errors(d.withColumnsRenamed({"tx": "x_m_t", "ty": "y_m_t", "tz": "z_m_t"}), E.AXES, "{}_t")
    out = E.planar_and_spatial(d, ["sequence_id"])
    return rounded(out, *[c for c in out.columns if c.startswith("error_")])


@query(f"""WITH {CANDIDATES}, c AS (SELECT source AS truth, CASE WHEN y_m >= 7 THEN 'A' WHEN y_m >= 3 THEN 'N' ELSE 'R' END AS guess, count(*) AS n FROM cand GROUP BY 1, 2),
r AS (SELECT truth, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (truth = guess), 0)::BIGINT AS hits, arg_min(guess, (-n, guess)) FILTER (truth <> guess) AS mistaken_for FROM c GROUP BY 1), g AS (SELECT guess AS truth, sum(n) AS m FROM c GROUP BY 1)
SELECT truth, rows, hits, round(hits / rows, 6) AS recall, round(hits / m, 6) AS precision, mistaken_for FROM r LEFT JOIN g USING (truth)""")
def class_audit(spark, sf):
    guess = F.when(F.col("y_m") >= 7, "A").when(F.col("y_m") >= 3, "N").otherwise("R")
    return rounded(E.class_audit(candidates(spark, sf).withColumn("guess", guess), "source", "guess"), "recall", "precision")


@query(f"""WITH {CANDIDATES}, b AS (SELECT source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY time_s, key) - 1) / 20) AS BIGINT) AS block, x_m FROM cand), g AS (SELECT source, block, sum(x_m) AS s, count(*) AS c FROM b GROUP BY 1, 2),
t AS (SELECT source, count(*) AS blocks, sum(s) / sum(c) AS estimate, sum(c)::BIGINT AS n FROM g GROUP BY 1), d AS (SELECT source, r, CAST(floor({draw_sql("'0'", "source", "r", "slot")} * blocks) AS BIGINT) AS block FROM (SELECT source, blocks, r, unnest(range(1, blocks + 1)) AS slot FROM t, range(1, 101) x(r))),
m AS (SELECT d.source, r, sum(s) / sum(c) AS m FROM d JOIN g ON g.source = d.source AND g.block = d.block GROUP BY 1, 2)
SELECT source, n, blocks, round(estimate, 6) AS estimate, round(lower, 6) AS lower, round(upper, 6) AS upper FROM t JOIN (SELECT source, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM m GROUP BY 1) USING (source)""")
def bootstrap_interval(spark, sf):
    """Blocks of 20 rows of each source."""
    return rounded(E.block_bootstrap(candidates(spark, sf), ["source"], ["time_s", "key"], "x_m", 20, 100, slices=64), "estimate", "lower", "upper")


@query(f"""WITH {CANDIDATES}, s AS (SELECT source AS method, sequence_id, avg(x_m) AS objective, avg(y_m) AS guard FROM cand GROUP BY 1, 2), d AS (SELECT s.*, s.objective - b.objective AS gain, s.guard - b.guard AS g FROM s JOIN s b ON b.method = 'A' AND b.sequence_id = s.sequence_id),
blk AS (SELECT method, row_number() OVER (PARTITION BY method ORDER BY sequence_id) - 1 AS block, gain FROM d), tot AS (SELECT method, count(*) AS n FROM blk GROUP BY 1),
slot AS (SELECT method, n, unnest(range(1, n + 1)) AS s FROM tot), mean AS (SELECT method, r, avg(gain) AS m FROM (SELECT method, r, CAST(floor({draw_sql("'0'", "method", "r", "s")} * n) AS BIGINT) AS block FROM slot, range(1, 501) a(r)) JOIN blk USING (method, block) GROUP BY 1, 2), low AS (SELECT method, quantile_cont(m, 0.025) AS lower FROM mean GROUP BY 1),
g AS (SELECT method, count(*) AS sequences, avg(gain) AS mean_gain, avg(g) AS guard_gain FROM d GROUP BY 1), t AS (SELECT *, concat_ws(';', CASE WHEN sequences < 10 THEN 'incomplete' END, CASE WHEN mean_gain <= 0 THEN 'no_gain' END, CASE WHEN lower < 0 THEN 'uncertain_gain' END, CASE WHEN guard_gain < -1.0 THEN 'guard_guard' END) AS reasons FROM g JOIN low USING (method)),
u AS (SELECT *, reasons = '' AND method <> 'A' AS accepted FROM t)
SELECT method, sequences, round(mean_gain, 6) AS mean_gain, round(guard_gain, 6) AS guard_gain, round(lower, 6) AS lower, reasons, accepted, CASE WHEN accepted THEN row_number() OVER (PARTITION BY accepted ORDER BY mean_gain DESC, method) END AS rank FROM u""")
def guarded_tournament(spark, sf):
    s = candidates(spark, sf).groupBy(F.col("source").alias("method"), "sequence_id").agg(F.avg("x_m").alias("objective"), F.avg("y_m").alias("guard"))
    out = E.guarded_tournament(s, "A", "objective", {"guard": 1.0}, 10)
    return longs(rounded(out, "mean_gain", "guard_gain", "lower"), "rank")


@query(f"""WITH {CANDIDATES}, f AS (SELECT source, candidate_branch, avg(x_m) AS m FROM cand GROUP BY 1, 2), g AS (SELECT source, count(*) AS folds, avg(m) AS mean, quantile_cont(m, 0.9) AS tail FROM f GROUP BY 1)
SELECT source, folds, round(mean, 6) AS mean, round(tail, 6) AS tail, round(0.5 * mean + 0.5 * tail, 6) AS risk, row_number() OVER (ORDER BY 0.5 * mean + 0.5 * tail, mean, source) AS rank FROM g""")
def risk_aggregates(spark, sf):
    f = candidates(spark, sf).groupBy("source", "candidate_branch").agg(F.avg("x_m").alias("m"))
    return longs(rounded(E.risk_summary(f, ["source"], "m", 0.5, 0.9), "mean", "tail", "risk"), "rank")


@query("""SELECT 'rows' AS check, count(*)::DOUBLE AS value, count(*) > 0 AS ok FROM events UNION ALL SELECT 'time_order', count(*) FILTER (back)::DOUBLE, count(*) FILTER (back) = 0 FROM (SELECT ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM events)
UNION ALL SELECT 'missing:value', round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6), avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.05 FROM events UNION ALL SELECT 'absent:speed', 1, false""")
def run_artifact_checks(spark, sf):
    return rounded(E.artifact_checks(table(spark, sf, "events").withColumnRenamed("ts", "time_s"), ["value", "speed"], ["user_id"], ordinal="event_id"), "value")


@query("""WITH m AS (SELECT CASE n_regionkey WHEN 0 THEN 'train.' WHEN 1 THEN 'heldout.' ELSE 'notes.' END || n_nationkey AS path, n_name AS value FROM nation)
SELECT path, value, CASE WHEN path LIKE '%train%' THEN 'training' ELSE 'metadata' END AS reason FROM m WHERE lower(value) LIKE '%n%' AND path NOT LIKE '%heldout%' AND path NOT LIKE 'notes.1%'""")
def leakage_sentinel(spark, sf):
    prefix = F.when(F.col("n_regionkey") == 0, "train.").when(F.col("n_regionkey") == 1, "heldout.").otherwise("notes.")
    return E.leakage(table(spark, sf, "nation").select(F.concat(prefix, F.col("n_nationkey").cast("string")).alias("path"), F.col("n_name").alias("value")), "N", ["notes.1"])


@query("SELECT 'k' AS path, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def flattened_metadata(spark, sf):
    d = E.flattened(table(spark, sf, "events"), F.col("props"), 2)
    return d.where("path = 'k'").groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CANDIDATES}, {ORACLE}, fr AS (SELECT sequence_id, time_s, min(e) AS ref FROM oc GROUP BY 1, 2), pl AS (SELECT source, sequence_id, time_s, min(e) AS best, min(e) FILTER (rk <= 2) AS best_top FROM oc GROUP BY 1, 2, 3), n AS (SELECT * FROM fr, (VALUES ('A'), ('N')) p(pool))
SELECT n.pool, count(*) AS frames, count(*) FILTER (best IS NULL) AS absent, round(avg(best - ref), 6) AS delta, round(avg(best_top), 6) AS top FROM n LEFT JOIN pl ON pl.source = n.pool AND pl.sequence_id = n.sequence_id AND pl.time_s = n.time_s GROUP BY 1""")
def candidate_pool_compare(spark, sf):
    c = _with_truth(spark, sf)
    frames = c.groupBy(*FRAME).agg(F.min("e").alias("error"))
    d = E.candidate_pools(c.select(F.col("source").alias("pool"), *FRAME, F.col("rk").alias("rank"), F.col("e").alias("error")), frames, ["A", "N"], 2)
    return d.groupBy("pool").agg(F.count(F.lit(1)).alias("frames"), F.count(F.when(F.col("absent"), 1)).alias("absent"), r6(F.avg("delta")).alias("delta"), r6(F.avg("best_top")).alias("top"))


@query(f"""WITH {CANDIDATES}, {ORACLE}, f AS (SELECT sequence_id, time_s, CASE WHEN arg_min(rk, (e, -score, key)) = 1 THEN 'right' WHEN min(e) > 8 THEN 'no_candidate' ELSE 'wrong_choice' END AS mode, min(e) FILTER (rk = 1) AS e FROM oc GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN lag(time_s) OVER w IS NULL THEN 0 WHEN time_s - lag(time_s) OVER w > 1 OR mode <> lag(mode) OVER w THEN 1 ELSE 0 END AS nw FROM f WINDOW w AS (PARTITION BY sequence_id ORDER BY time_s)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY sequence_id ORDER BY time_s ROWS UNBOUNDED PRECEDING) AS b FROM n)
SELECT sequence_id, CAST(b AS BIGINT) AS block, mode, count(*) AS frames, min(time_s) AS start_s, max(time_s) AS end_s, round(avg(e), 6) AS mean, round(max(e), 6) AS worst FROM s GROUP BY 1, 2, 3""")
def assignment_blocks(spark, sf):
    f = _with_truth(spark, sf).groupBy(*FRAME).agg(F.min("e").alias("best"), F.min(F.when(F.col("rk") == 1, F.col("e"))).alias("e"), F.min_by("rk", F.struct("e", -F.col("score"), "key")).alias("at"))
    mode = F.when(F.col("at") == 1, "right").when(F.col("best") > 8, "no_candidate").otherwise("wrong_choice")
    return rounded(W.mode_blocks(f.withColumn("mode", mode), ["sequence_id"], ["time_s"], "mode", "e", 1.0), "mean", "worst")


# --- repair and ensembles

def _kink_sql(source: str, out: str) -> str:
    return f"""{out}_d AS (SELECT *, lag(time_s) OVER w AS t0, lag(x_m) OVER w AS x0, lead(time_s) OVER w AS t1, lead(x_m) OVER w AS x1 FROM {source} WINDOW w AS (PARTITION BY sequence_id ORDER BY time_s, key)),
{out}_l AS (SELECT *, x0 + (x1 - x0) * (time_s - t0) / (t1 - t0) AS li FROM {out}_d),
{out} AS (SELECT sequence_id, time_s, key, CASE WHEN k THEN x_m + 0.37 * (li - x_m) ELSE x_m END AS x_m, kk OR k AS kk FROM (SELECT *, coalesce(abs(((x1 - x_m) / (t1 - time_s) - (x_m - x0) / (time_s - t0)) * 2 / (t1 - t0)) > 0.05 AND abs((x1 - x0) / (t1 - t0)) <= 5 AND abs(x_m - li) >= 1, false) AS k FROM {out}_l))"""


SINGLE = "one AS (SELECT sequence_id, time_s, key, x_m, false AS kk FROM traj QUALIFY row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY key DESC) = 1)"


@query(f"WITH {TRAJECTORIES}, {SINGLE}, {_kink_sql('one', 'k1')}, {_kink_sql('k1', 'k2')} SELECT key, round(x_m, 6) AS x_m, kk AS kink FROM k2")
def acceleration_kinks(spark, sf):
    step = lambda d: R.acceleration_pass(d, ["sequence_id"], ["time_s", "key"], ["x_m"], 0.05, 5.0, 1.0, 0.37)
    return R.repeated(_single(spark, sf), "kink", 2, step).select("key", r6("x_m").alias("x_m"), "kink")


@query()
def jerk_kinks(spark, sf):
    return Q.jerk_limited(_single(spark, sf), ["x_m"], 0.01, rounds=2)


@query(f"""WITH {TRAJECTORIES}, {SINGLE}, p AS (SELECT a.key, a.x_m AS x, b.time_s - a.time_s AS d, b.x_m AS y, exp(-0.5 * ((b.time_s - a.time_s) / 60.0) ** 2) AS w FROM one a JOIN one b ON a.sequence_id = b.sequence_id AND abs(a.time_s - b.time_s) <= 120),
m AS (SELECT key, x, count(*) AS n, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS y0, sum(w * d * y) AS y1 FROM p GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN s0 * s2 - s1 * s1 > 1e-12 * greatest(1, s0 * s2) THEN (s2 * y0 - s1 * y1) / (s0 * s2 - s1 * s1) ELSE y0 / s0 END - x AS st FROM m)
SELECT key, round(CASE WHEN n >= 3 THEN x + sign(st) * least(abs(st), 10) ELSE x END, 6) AS x_m FROM f""")
def local_linear_smoothing(spark, sf):
    return Q.local_linear(_single(spark, sf), ["x_m"], 120.0, 1.0, 10.0, 3).select("key", r6("x_m").alias("x_m"))


@query(f"""WITH {CANDIDATES}, f AS (SELECT sequence_id, time_s, avg(x_m) AS x, avg(z_m) AS z, arg_min(x_m, (-score, key)) AS tx, arg_min(z_m, (-score, key)) AS tz FROM cand GROUP BY 1, 2)
SELECT sequence_id, time_s, round(x + 0.5 * (tx - x), 6) AS x_m, round(z + CASE WHEN CAST(sequence_id AS INT) % 2 = 0 THEN 0.25 ELSE 0 END * (tz - z), 6) AS z_m FROM f""")
def candidate_pull(spark, sf):
    c = candidates(spark, sf)
    rows = c.groupBy(*FRAME).agg(*[F.avg(a).alias(a) for a in E.AXES], F.min("key").alias("key"))
    w = c.select("sequence_id").distinct().select("sequence_id", F.lit(0.5).alias("alpha_xy"), F.when(F.col("sequence_id").cast("int") % 2 == 0, 0.25).otherwise(0.0).alias("alpha_z"))
    return R.candidate_pull(R.candidate_centers(rows, c, 0.4, 5), w).select(*FRAME, r6("x_m").alias("x_m"), r6("z_m").alias("z_m"))


@query(f"""WITH {CANDIDATES}, i AS (SELECT sequence_id, time_s, source AS l, avg(x_m) AS x, avg(y_m) AS y, avg(z_m) AS z, count(*)::DOUBLE AS w FROM cand GROUP BY 1, 2, 3),
n AS (SELECT c.sequence_id, c.time_s, c.l, m.w, m.x, m.y, m.z FROM i c JOIN i m USING (sequence_id, time_s) WHERE sqrt((c.x - m.x) ** 2 + (c.y - m.y) ** 2 + (c.z - m.z) ** 2) <= 8),
s AS (SELECT sequence_id, time_s, l, sum(w) AS sw, count(*) AS k, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz FROM n GROUP BY 1, 2, 3),
d AS (SELECT s.*, (SELECT round(sqrt(sum(w * ((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)) / sw), 9) FROM n WHERE n.sequence_id = s.sequence_id AND n.time_s = s.time_s AND n.l = s.l) AS sp FROM s)
SELECT sequence_id, time_s, round(mx, 6) AS x_m, round(mz, 6) AS z_m, k AS inputs FROM d QUALIFY row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY sw DESC, k DESC, sp, l) = 1""")
def consensus_ensemble(spark, sf):
    i = candidates(spark, sf).groupBy(*FRAME, "source").agg(*[F.avg(a).alias(a) for a in E.AXES], F.count(F.lit(1)).cast("double").alias("weight"))
    return R.consensus_ensemble(i, FRAME, "source", 8.0).select(*FRAME, r6("x_m").alias("x_m"), r6("z_m").alias("z_m"), "inputs")


CLASSES = "cls AS (SELECT CAST(s_suppkey AS VARCHAR) AS sequence_id, c.class, CASE c.class WHEN 'u' THEN 0.25 ELSE 0.75 END AS p FROM supplier, (VALUES ('u'), ('v')) c(class)), wt(class, source, w) AS (VALUES ('u', 'A', 1.0), ('u', 'N', 2.0), ('v', 'A', 3.0), ('v', 'R', 0.5))"


@query(f"""WITH {CANDIDATES}, {CLASSES}, m AS (SELECT sequence_id, time_s, class, any_value(p) AS p, sum(w * x_m) / sum(w) AS x FROM cand JOIN cls USING (sequence_id) JOIN wt USING (class, source) GROUP BY 1, 2, 3)
SELECT sequence_id, time_s, round(sum(p * x) / sum(p), 6) AS x_m, count(*) AS classes FROM m GROUP BY 1, 2""")
def soft_class_ensemble(spark, sf):
    cls = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("sequence_id"), F.explode(F.array(F.lit("u"), F.lit("v"))).alias("class")).withColumn("p", F.when(F.col("class") == "u", 0.25).otherwise(0.75))
    weights = spark.createDataFrame([("u", "A", 1.0), ("u", "N", 2.0), ("v", "A", 3.0), ("v", "R", 0.5)], "class string, label string, w double")
    return R.class_weighted(candidates(spark, sf), FRAME, cls, weights, axes=["x_m"]).select(*FRAME, r6("x_m").alias("x_m"), "classes")


@query(f"""WITH {MEASUREMENTS}, {BRACKET} SELECT key, round(CASE WHEN CAST(sequence_id AS INT) % 3 <> 0 THEN x_m WHEN t0 = time_s THEN 0.5 * x_m + 0.5 * x0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN 0.5 * x_m + 0.5 * (x0 + (x1 - x0) * (time_s - t0) / (t1 - t0)) ELSE x_m END, 6) AS x_m FROM br""")
def sequence_gate_blend(spark, sf):
    a, b = _clicks(spark, sf)
    w = a.where(F.col("sequence_id").cast("int") % 3 == 0).select("sequence_id").distinct().withColumn("weight", F.lit(0.5))
    return R.sequence_blend(a, b, w, axes=["x_m"]).select("key", r6("x_m").alias("x_m"))


@query(f"""WITH {TRAJECTORIES}, tmpl AS (SELECT sequence_id, t::DOUBLE AS time_s FROM (SELECT sequence_id, unnest(range(CAST(floor(min(time_s) / 90) AS BIGINT), CAST(ceil(max(time_s) / 90) AS BIGINT) + 1)) * 90 AS t FROM traj GROUP BY 1)), {RESAMPLE.replace(TEMPLATE + ', ', '').split(', rs AS')[0].rstrip().rstrip(',').split('rs AS (')[0].rstrip().rstrip(',')}
SELECT sequence_id, time_s, round(CASE WHEN t0 = time_s THEN x0 WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL THEN x0 WHEN t1 - t0 > 200 THEN CASE WHEN time_s - t0 <= t1 - time_s THEN x0 ELSE x1 END ELSE x0 + (x1 - x0) * (time_s - t0) / (t1 - t0) END, 9) AS x_m,
CASE WHEN t0 = time_s THEN 'exact' WHEN t0 IS NULL OR t1 IS NULL THEN 'held' WHEN t1 - t0 > 200 THEN 'nearest' ELSE 'linear' END AS mode FROM pv JOIN nx USING (sequence_id, time_s)""")
def trajectory_completion(spark, sf):
    t = trajectories(spark, sf)
    g = t.groupBy("sequence_id").agg(F.floor(F.min("time_s") / 90).alias("a"), F.ceil(F.max("time_s") / 90).alias("b"))
    grid = g.select("sequence_id", F.explode(F.sequence("a", "b")).alias("k")).select("sequence_id", (F.col("k") * 90).cast("double").alias("time_s"))
    return rounded(R.completed(t, grid, ["x_m"], 200.0), "x_m", n=9)


@query(f"""WITH {CANDIDATES}, sh(source, d) AS (VALUES ('A', 2.0), ('N', -1.0)), fr(f) AS (VALUES (0.0), (0.5), (1.0))
SELECT key, CASE f WHEN 0 THEN 'raw' WHEN 1 THEN 'calibrated' ELSE 'path_0.5' END AS branch, round(x_m + f * coalesce(d, 0), 6) AS x_m FROM cand LEFT JOIN sh USING (source), fr WHERE d IS NOT NULL OR f = 0""")
def calibration_path_ensemble(spark, sf):
    shifts = spark.createDataFrame([("A", 2.0), ("N", -1.0)], "source string, shift_x_m double")
    return R.path_ensemble(candidates(spark, sf), shifts, [0.0, 0.5, 1.0], ["x_m"]).select("key", "branch", r6("x_m").alias("x_m"))


@query(f"""WITH {CANDIDATES}, a AS (SELECT DISTINCT sequence_id, time_s FROM cand WHERE source = 'A'), b AS (SELECT DISTINCT sequence_id, time_s FROM cand WHERE source = 'N')
SELECT sequence_id, time_s, 'A' AS origin FROM a UNION ALL SELECT sequence_id, time_s, 'N' FROM b ANTI JOIN a USING (sequence_id, time_s)""")
def merged_truth(spark, sf):
    c = candidates(spark, sf)
    part = lambda s: c.where(F.col("source") == s).select(*FRAME).distinct().withColumn("origin", F.lit(s))
    return R.merged_truth(part("A"), part("N"), FRAME)


# --- association

@query(f"""WITH {CANDIDATES}, v AS (SELECT key, CASE WHEN y_m < 9 THEN x_m * 0.8 END AS nis, x_m / 2 AS anchor, z_m / 5 AS ent, 1 + y_m / 5 AS eff, z_m AS miss FROM cand),
w AS (SELECT *, coalesce(nis >= 36, false) OR anchor >= 25 OR ent >= 1.35 OR eff >= 3 AS hard, coalesce(nis >= 16, false) OR anchor >= 16 OR ent >= 1 OR eff >= 2 AS soft FROM v)
SELECT key, CASE WHEN hard THEN CASE WHEN miss >= 2 THEN 'defer' ELSE 'skip' END WHEN soft THEN 'soften' ELSE 'apply' END AS action,
round(CASE WHEN NOT hard AND soft THEN least(greatest(1, CASE WHEN nis >= 16 THEN nis / 16 ELSE 1 END, CASE WHEN anchor >= 16 THEN anchor / 16 ELSE 1 END, CASE WHEN ent >= 1 THEN 1 + ent ELSE 1 END, CASE WHEN eff >= 2 THEN eff / 2 ELSE 1 END), 25) ELSE 1 END, 6)::DOUBLE AS covariance_scale FROM w""")
def update_policy(spark, sf):
    d = candidates(spark, sf).select("key", F.when(F.col("y_m") < 9, F.col("x_m") * 0.8).alias("nis"), (F.col("x_m") / 2).alias("anchor_nis"), (F.col("z_m") / 5).alias("entropy"), (1 + F.col("y_m") / 5).alias("effective"), F.col("z_m").alias("miss_streak"))
    return A.update_policy(d).select("key", "action", r6("covariance_scale").alias("covariance_scale"))


@query(f"""WITH {CANDIDATES}, d AS (SELECT *, (x_m - 25) ** 2 / 100 AS nis FROM cand) SELECT key, round(ln(1 + nis), 6) AS log_nis, round(sqrt((x_m - 25) ** 2 + y_m ** 2 + z_m ** 2), 6) AS residual_xyz,
(rank() OVER (PARTITION BY sequence_id, time_s ORDER BY nis) + (count(*) OVER (PARTITION BY sequence_id, time_s, nis) - 1) / 2.0)::DOUBLE AS nis_rank, round(nis - min(nis) OVER (PARTITION BY sequence_id, time_s), 6) AS nis_margin, CASE WHEN source <> 'A' THEN 1.0 ELSE 0.0 END::DOUBLE AS track_change FROM d""")
def association_features(spark, sf):
    d = candidates(spark, sf).withColumns({"nis": (F.col("x_m") - 25) * (F.col("x_m") - 25) / 100, "rx": F.col("x_m") - 25, "ry": F.col("y_m"), "rz": F.col("z_m"), "prob": F.col("y_m") / 10, "range_m": F.col("x_m"), "track": F.col("source")})
    return rounded(A.association_features(d, F.lit("A")).select("key", "log_nis", "residual_xyz", "nis_rank", "nis_margin", "track_change"), "log_nis", "residual_xyz", "nis_margin")


BLEND = """p0 AS (SELECT key, sequence_id, time_s, (1 + x_m) / sum(1 + x_m) OVER f AS p, (1 + y_m) / sum(1 + y_m) OVER f AS q, count(*) OVER f AS n FROM cand WINDOW f AS (PARTITION BY sequence_id, time_s)),
p1 AS (SELECT *, -sum(q * ln(q)) OVER f AS h, sum(0.5 * p * (ln(p) - ln((p + q) / 2)) + 0.5 * q * (ln(q) - ln((p + q) / 2))) OVER f AS js FROM p0 WINDOW f AS (PARTITION BY sequence_id, time_s)),
p2 AS (SELECT *, 0.1 + 0.8 * least(greatest(1 - CASE WHEN n > 1 THEN h / ln(n) ELSE 0 END, 0), 1) * least(greatest(1 - js / ln(2), 0), 1) AS w FROM p1), p3 AS (SELECT *, (1 - w) * ln(p) + w * ln(q) AS l FROM p2)"""


@query(f"WITH {CANDIDATES}, {BLEND} SELECT key, round(w, 6) AS pair_weight, round(exp(l) / sum(exp(l)) OVER (PARTITION BY sequence_id, time_s), 6) AS posterior FROM p3")
def blended_posteriors(spark, sf):
    d = candidates(spark, sf).withColumns({"local": 1 + F.col("x_m"), "pair": 1 + F.col("y_m")})
    return rounded(A.blended_posteriors(d, "local", "pair", 0.1, 0.9).select("key", "pair_weight", "posterior"), "pair_weight", "posterior")


@query(f"""WITH {CANDIDATES} SELECT sequence_id, key, row_number() OVER (PARTITION BY sequence_id ORDER BY score DESC, time_s, key) AS hypothesis FROM (SELECT *, min(time_s) OVER (PARTITION BY sequence_id) AS t0 FROM cand) WHERE time_s <= t0 + 6 QUALIFY hypothesis <= 4""")
def delayed_hypotheses(spark, sf):
    return longs(A.delayed_hypotheses(candidates(spark, sf), 6.0, 4).select("sequence_id", "key", "hypothesis"), "hypothesis")


@query(f"""WITH {CANDIDATES}, n AS (SELECT *, CASE WHEN lag(time_s) OVER w IS NOT NULL AND time_s - lag(time_s) OVER w > 3 THEN 1 ELSE 0 END AS nw FROM cand WINDOW w AS (PARTITION BY sequence_id, source ORDER BY time_s, key)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY sequence_id, source ORDER BY time_s, key ROWS UNBOUNDED PRECEDING) AS segment FROM n)
SELECT sequence_id, source, CAST(segment AS BIGINT) AS segment, count(*) AS rows, min(time_s) AS start_s, max(time_s) AS end_s, round(sum(score), 4) AS score, arg_min(x_m, (time_s, key)) AS head_x_m, arg_max(x_m, (time_s, key)) AS tail_x_m FROM s GROUP BY 1, 2, 3""")
def tracklets(spark, sf):
    d = A.tracklets(candidates(spark, sf), "source", 3.0)
    return longs(rounded(d, "score", n=4), "segment").select("sequence_id", "source", "segment", "rows", "start_s", "end_s", "score", "head_x_m", "tail_x_m")


@query()
def tracklet_beam_chains(spark, sf):
    return A.beam_chains(A.tracklets(candidates(spark, sf), "source", 3.0), "source", 20.0, 1000.0, 3)


@query()
def stitched_segments(spark, sf):
    return A.stitched_segments(A.tracklets(candidates(spark, sf), "source", 3.0), "source", 20.0)


@query()
def top_k_paths(spark, sf):
    return A.top_k_paths(candidates(spark, sf), "score", 20_000.0, 10.0, 2, 1.0)


@query()
def fixed_lag_path(spark, sf):
    return A.fixed_lag_path(candidates(spark, sf), "score", 20_000.0, 10.0, 2.0, 1.0)


@query()
def alternating_association(spark, sf):
    return A.alternating_path(candidates(spark, sf), "score", 20_000.0, 20.0, 1.0)


@query()
def pair_forward_backward(spark, sf):
    return A.pair_prior(candidates(spark, sf), "score", 20_000.0, 10.0, 10.0)


@query()
def radar_association(spark, sf):
    return A.associated_track(candidates(spark, sf), "score", 20_000.0, "score-nis", 10.0, 4.0)


@query()
def pda_association(spark, sf):
    return A.associated_track(candidates(spark, sf), "score", 20_000.0, "pda", 10.0, 4.0)


@query()
def hypothesis_bank(spark, sf):
    return A.hypothesis_track(candidates(spark, sf), "score", 20_000.0, 10.0, 4.0)


@query()
def path_then_filter(spark, sf):
    return A.path_then_filter(candidates(spark, sf), "score", 20_000.0, 10.0, 4.0, 10.0, "track")


@query()
def multi_object_tracks(spark, sf):
    return A.multi_object_tracks(candidates(spark, sf), 5.0, 4.0, 25.0)


@query()
def segment_source_gate(spark, sf):
    return A.segment_source_gate(candidates(spark, sf).withColumn("cost", F.abs(F.col("x_m") - 25)), 10.0)


def _sigma(spark, sf):
    return candidates(spark, sf).withColumn("sigma_m", 1 + F.col("z_m"))


@query(f"""WITH {CANDIDATES}, s AS (SELECT *, 1 + z_m AS sg, score / 20000 AS sc FROM cand), st AS (SELECT sequence_id, time_s, arg_min(x_m, (-(sc - ln(sg)), key)) AS sx, arg_min(y_m, (-(sc - ln(sg)), key)) AS sy, arg_min(z_m, (-(sc - ln(sg)), key)) AS sz FROM s GROUP BY 1, 2),
r AS (SELECT *, sqrt((x_m - sx) ** 2 + (y_m - sy) ** 2 + (z_m - sz) ** 2) / sg AS u FROM s JOIN st USING (sequence_id, time_s)), w AS (SELECT *, exp(sc - CASE WHEN u <= 3 THEN 0.5 * u * u ELSE 3 * (u - 1.5) END - ln(sg)) AS e FROM r),
p AS (SELECT sequence_id, time_s, sum(e * x_m) / sum(e) AS x, sum(e * y_m) / sum(e) AS y, sum(e * z_m) / sum(e) AS z FROM w GROUP BY 1, 2) SELECT sequence_id, time_s, round(x, 6) AS x_m, round(y, 6) AS y_m, round(z, 6) AS z_m FROM p""")
def mixture_map_one_round(spark, sf):
    """Without smoothing and with one round each frame is the responsibility-weighted mean: SQL can state this case."""
    d = A.mixture_map(_sigma(spark, sf), 0.0, scale=20_000.0, rounds=1)
    return d.select(*FRAME, *[F.round(f"state_{a}", 6).alias(a) for a in E.AXES])


@query()
def mixture_map(spark, sf):
    return A.mixture_map(_sigma(spark, sf), 7200.0, scale=20_000.0, balance=0.2)


@query()
def mixture_map_restarts(spark, sf):
    starts = {"score": F.col("score"), "near": -F.abs(F.col("x_m") - 25) * 1000, "flat": F.lit(0.0)}
    return A.mixture_restarts(_sigma(spark, sf), 50.0, starts, scale=20_000.0)


@query()
def sequence_pool_selector(spark, sf):
    d = _sigma(spark, sf)
    pools = d.withColumn("pool", F.lit("all")).unionByName(d.where("source <> 'R'").withColumn("pool", F.lit("without_R")))
    return A.pool_selector(pools, 50.0, "pool", scale=20_000.0)


# --- normalising and selection

@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 9 = 0 THEN 'default' ELSE CAST(o_custkey AS VARCHAR) END AS sequence_id, o_totalprice AS x_m, o_custkey::DOUBLE AS time_s FROM orders WHERE o_orderkey % 5 <> 0""")
def normalized_truth(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 9 == 0, " nan ").otherwise(F.col("o_custkey").cast("string")).alias("Seq"), F.when(F.col("o_orderkey") % 5 == 0, "inf").otherwise(F.col("o_totalprice").cast("string")).alias("pos_x"), F.lit("1").alias("Y"), F.lit(2.0).alias("pz"), F.col("o_custkey").cast("string").alias("time_s"))
    return N.normalize_truth(raw).select("key", "sequence_id", "x_m", "time_s")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_discount >= 0.05)
SELECT 'catprob' AS selection, count(*) AS n, round(sum(l_quantity), 4) AS total FROM l WHERE rn = 1 UNION ALL SELECT 'catprob-all', count(*), round(sum(l_quantity), 4) FROM l UNION ALL SELECT 'all', count(*), round(sum(l_quantity), 4) FROM lineitem""")
def radar_selection(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_index"), F.col("l_discount").alias("cat_prob_uav"), F.col("l_linenumber").alias("track_id"), F.col("l_partkey").alias("track_index"), F.col("l_suppkey").alias("key"), "l_quantity")
    one = lambda s: N.select_radar(d, s, 0.05).agg(F.lit(s).alias("selection"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("total"))
    return one("catprob").unionByName(one("catprob-all")).unionByName(one("all"))


@query("""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS key, round(epoch(l_shipdate::TIMESTAMP) + 3600 - 694224000, 3) AS time_s FROM lineitem WHERE l_tax > 0.01""")
def normalized_radar(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("string").alias("global_time_raw_s"),
        (F.lit(35) + F.col("l_quantity") / 1000).alias("latitude"), F.lit("-78.0").alias("longitude"), F.when(F.col("l_tax") > 0.01, F.lit("100")).otherwise("inf").alias("altitude_m"),
    )
    return N.normalize_radar(raw, (35.0, -78.0, 100.0), 694224000.0, 3600.0).select("key", F.round("time_s", 3).alias("time_s"))


@query(f"""WITH {CANDIDATES} SELECT sequence_id, count(*) AS n FROM cand WHERE CAST(sequence_id AS INT) % 4 = 1 AND x_m <= 30 GROUP BY 1""")
def split_and_range(spark, sf):
    c = candidates(spark, sf)
    m = N.split_manifest(c.select("sequence_id", F.when(F.col("sequence_id").cast("int") % 4 == 1, " Test ").otherwise("train").alias("split")))
    d = N.in_split(N.within_range(N.require_range(c.withColumn("range_m", F.col("x_m"))), 30.0), m, "test")
    return d.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MEASUREMENTS}, span AS (SELECT sequence_id, min(time_s) AS a, max(time_s) AS b FROM meas WHERE source = 'purchase' GROUP BY 1)
SELECT key, round(time_s + 1.5, 6) AS time_s FROM meas JOIN span USING (sequence_id) WHERE source = 'click' AND time_s + 1.5 BETWEEN a - 100 AND b + 100""")
def shifted_window(spark, sf):
    """The shift is applied twice: the second call changes nothing."""
    a, b = _clicks(spark, sf)
    return N.in_truth_window(N.shifted(N.shifted(a, 1.5), 1.5), b, ["sequence_id"], 100.0).select("key", r6("time_s").alias("time_s"))


def _u(salt: str) -> str:
    return f"({draw_sql(chr(39) + '7' + chr(39), chr(39) + salt + chr(39), 'key')} + 0.5 / 4294967296.0)"


@query(f"""WITH {CANDIDATES}, k AS (SELECT * FROM cand WHERE {_u('drop')} >= 0.1)
SELECT key, round(x_m + sqrt(-2 * ln({_u('x_ma')})) * cos(2 * pi() * {_u('x_mb')}), 5) AS x_m, round(time_s + 0.5 * (2 * {_u('t')} - 1), 6) AS time_s, false AS is_false FROM k
UNION ALL SELECT key, round(x_m + 100 * (2 * {_u('fx_m')} - 1), 5), round(time_s, 6), true FROM k WHERE {_u('false')} < 0.05""")
def perturbed_radar(spark, sf):
    d = N.perturbed(candidates(spark, sf), ["key"], E.AXES, 7, 0.1, 1.0, 0.5, 0.05)
    return d.select("key", r6("x_m", 5).alias("x_m"), r6("time_s").alias("time_s"), "is_false")


# --- fitted corrections

@query(f"""WITH {CANDIDATES}, g AS (SELECT source, candidate_branch, count(*) AS n, avg(CASE WHEN x_m <= 25 THEN 1.0 ELSE 0.0 END) AS rate, avg(ln(least(greatest(y_m / 12, 0.001), 0.999) / (1 - least(greatest(y_m / 12, 0.001), 0.999)))) AS l FROM cand GROUP BY 1, 2)
SELECT source, candidate_branch, n, round(rate, 6) AS rate, round((ln(least(greatest(rate, 0.001), 0.999) / (1 - least(greatest(rate, 0.001), 0.999))) - l) * n / (n + 50.0), 6) AS "offset" FROM g""")
def score_calibration(spark, sf):
    d = candidates(spark, sf).withColumn("p", F.col("y_m") / 12)
    return rounded(M.score_calibration(d, ["source", "candidate_branch"], F.col("x_m") <= 25, "p"), "rate", "offset")


OFFSETS = [{}, {"A": 20000.0}, {"N": 20000.0, "R": -5000.0}]
GRID = """gr(config, a, n, r) AS (VALUES (0, 0.0, 0.0, 0.0), (1, 20000.0, 0.0, 0.0), (2, 0.0, 20000.0, -5000.0)), sc AS (SELECT config, sequence_id, time_s, e, row_number() OVER (PARTITION BY config, sequence_id, time_s ORDER BY score + CASE source WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END DESC, key) AS r2 FROM oc, gr),
gf AS (SELECT config, sequence_id, time_s, min(e) AS e FROM sc WHERE r2 <= 2 GROUP BY 1, 2, 3), gs AS (SELECT config, sequence_id, count(*) AS f, sum(e) AS s FROM gf GROUP BY 1, 2)"""


@query(f"WITH {CANDIDATES}, {ORACLE}, {GRID} SELECT config, sequence_id, f AS frames, round(s, 6) AS error_sum FROM gs")
def reservoir_offset_grid(spark, sf):
    return rounded(M.offset_grid(_with_truth(spark, sf), OFFSETS, "source", "score", "e", 2), "error_sum")


@query(f"""WITH {CANDIDATES}, {ORACLE}, {GRID}, t AS (SELECT config, sum(f) AS f, sum(s) AS s FROM gs GROUP BY 1), d AS (SELECT gs.*, round((t.s - gs.s) / nullif(t.f - gs.f, 0), 9) AS tr FROM gs JOIN t USING (config))
SELECT sequence_id, config, round(tr, 6) AS train_error, round(s / f, 6) AS heldout_error, f AS frames FROM d QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY tr, config) = 1""")
def heldout_offset_choice(spark, sf):
    g = M.offset_grid(_with_truth(spark, sf), OFFSETS, "source", "score", "e", 2)
    return rounded(M.held_out_choice(g), "train_error", "heldout_error")


@query(f"""WITH {CANDIDATES} SELECT source, count(*) AS n, round(regr_intercept(x_m, score), 6) AS intercept, round(regr_slope(x_m, score), 9) AS slope FROM cand GROUP BY 1""")
def bias_correction(spark, sf):
    d = M.ridge(candidates(spark, sf), ["source"], ["score"], "x_m", alpha=0.0)
    return d.select("source", "n", r6("intercept").alias("intercept"), F.round(F.get("coefficients", 0), 9).alias("slope"))


@query(f"""WITH {CANDIDATES} SELECT source, count(*) AS n, round(regr_slope(2 * x_m + z_m, x_m), 6) AS slope, round(regr_intercept(2 * x_m + z_m, x_m), 6) AS shift FROM cand GROUP BY 1""")
def source_transforms(spark, sf):
    d = M.source_transforms(candidates(spark, sf).withColumn("b", 2 * F.col("x_m") + F.col("z_m")), "source", "affine", ["x_m"], ["b"])
    return d.select("source", "n", r6(F.get("matrix", 0)).alias("slope"), r6(F.get("shift", 0)).alias("shift"))


def _labelled(spark, sf):
    c = _with_truth(spark, sf)
    return c.withColumn("good", (F.col("e") <= 5).cast("double"))


@query()
def learned_association(spark, sf):
    """A logistic model of good candidates; held-out quality is tested."""
    d = _labelled(spark, sf)
    model = M.fit_classifier(d, ["x_m", "y_m", "z_m"], "good")
    return M.scored(model, d, ["x_m", "y_m", "z_m"]).select("key", "model_score")


@query(f"""WITH {CANDIDATES}, {ORACLE}, f AS (SELECT sequence_id, time_s, min(e) FILTER (rk = 1) AS chosen, min(e) FILTER (rk <= 2) AS b2, min(e) AS best FROM oc GROUP BY 1, 2)
SELECT sequence_id, count(*) AS frames, round(avg(CASE WHEN chosen <= best THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(chosen), 6) AS chosen_m, round(avg(b2), 6) AS best_k_m, round(avg(best), 6) AS best_m FROM f GROUP BY GROUPING SETS ((), (sequence_id))""")
def ranking_quality(spark, sf):
    return rounded(M.ranking_quality(_with_truth(spark, sf), "score", "e", 2), "hit_rate", "chosen_m", "best_k_m", "best_m")


# --- caps, labels, populations

@query(f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, time_s, source ORDER BY score DESC, key) AS s, row_number() OVER (PARTITION BY sequence_id, time_s, candidate_branch ORDER BY score DESC, key) AS b, count(*) OVER (PARTITION BY sequence_id, time_s, source) AS ns, count(*) OVER (PARTITION BY sequence_id, time_s, candidate_branch) AS nb FROM cand),
p AS (SELECT *, s <= 1 OR b <= 1 AS reserved, CASE WHEN s <= 1 OR b <= 1 THEN least(ns, nb) ELSE 0 END AS rare FROM r) SELECT key, reserved, row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY reserved DESC, rare, score DESC, key) AS pick FROM p QUALIFY pick <= 3""")
def diversity_cap(spark, sf):
    return longs(S.diversity_cap(candidates(spark, sf), 3).select("key", "reserved", "pick"), "pick")


@query(f"""WITH {MEASUREMENTS}, {BRACKET} SELECT key, round(CASE WHEN abs(tm - time_s) <= 200000 THEN sqrt((x_m - xm) ** 2 + (y_m - ym) ** 2) END, 6) AS residual_m, CASE WHEN abs(tm - time_s) <= 200000 THEN sqrt((x_m - xm) ** 2 + (y_m - ym) ** 2) <= 40 END AS good FROM near""")
def labelled_clusters(spark, sf):
    a, b = _clicks(spark, sf)
    return E.labelled(a, b, ["sequence_id"], 40.0, 200_000.0, XY).select("key", r6("residual_m").alias("residual_m"), "good")


@query(f"""WITH {CANDIDATES}, r AS (SELECT x_m - 5 * y_m AS e FROM cand), m AS (SELECT quantile_cont(e, 0.5) AS m FROM r), d AS (SELECT quantile_cont(abs(e - m), 0.5) AS d FROM r, m) SELECT count(*) AS n, round(avg(e), 6) AS shift_e FROM r, m, d WHERE abs(e - m) <= 3 * 1.4826 * d""")
def estimate_calibration(spark, sf):
    return rounded(C.estimate_shift(candidates(spark, sf).select((F.col("x_m") - 5 * F.col("y_m")).alias("e")), ["e"]), "shift_e")


@query()
def assigned_temporal_support(spark, sf):
    return Q.assigned_support(candidates(spark, sf), 2.0, 5.0)


@query()
def robust_map_smoothing(spark, sf):
    return Q.robust_map(_single(spark, sf), ["x_m"], 1e4, 100.0, 200.0)


def _boxes(spark, sf):
    c = S.best_per_frame(candidates(spark, sf), [*FRAME, "source"], [F.col("key")])
    return c.select("sequence_id", F.col("time_s").cast("long").alias("frame"), F.ascii("source").cast("long").alias("id"), F.col("x_m").alias("x"), (F.ascii("source") * 20.0).alias("y"), F.lit(80.0).alias("w"), F.lit(15.0).alias("h"))


@query()
def fixed_population(spark, sf):
    b = _boxes(spark, sf)
    first = b.groupBy("sequence_id").agg(F.min("frame").alias("f"))
    seeds = b.join(first, "sequence_id").where("frame = f").drop("f").withColumn("id", F.col("id") + 1000)
    return Q.fixed_population(b, seeds, 0.3, 2)
