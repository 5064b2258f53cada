"""Queries over the driver's tables, one per operator, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, parse
from ..operators import aggregates as G
from ..operators import joins as J
from ..operators import select as S
from ..operators import trajectories as T
from ..operators import windows as W
from ..sources import readers
from .views import CANDIDATES, MEASUREMENTS, TRAJECTORIES, candidates, measurements, table, trajectories

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def rounded(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in names})


# --- projections, filters, scalar functions

RAW = """
raw AS (
  SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN ' nan ' WHEN o_orderkey % 7 = 1 THEN NULL ELSE ' ' || o_orderstatus || ' ' END AS source,
         CASE WHEN o_orderkey % 5 = 0 THEN 'inf' WHEN o_orderkey % 5 = 1 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR) END AS x,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) || '.0' WHEN o_orderkey % 3 = 1 THEN '00' || CAST(o_custkey AS VARCHAR) ELSE '<NA>' END AS track,
         CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' false' WHEN 2 THEN '1' ELSE NULL END AS used,
         CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey * 1000 AS BIGINT) END AS time_ms,
         CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS sec, CASE WHEN o_orderkey % 2 = 1 THEN 250000000 END AS nanosec
  FROM orders
)"""


def _raw(spark, sf):
    k, o = F.col("o_orderkey"), table(spark, sf, "orders")
    cust = F.col("o_custkey").cast("string")
    return o.select(
        k.alias("key"),
        F.when(k % 7 == 0, " nan ").when(k % 7 == 1, None).otherwise(F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).alias("source"),
        F.when(k % 5 == 0, "inf").when(k % 5 == 1, "bad").otherwise(cust).alias("x"),
        F.when(k % 3 == 0, F.concat(cust, F.lit(".0"))).when(k % 3 == 1, F.concat(F.lit("00"), cust)).otherwise("<NA>").alias("track"),
        F.when(k % 4 == 0, "Yes").when(k % 4 == 1, " false").when(k % 4 == 2, "1").alias("used"),
        F.when(k % 2 == 0, F.col("o_custkey") * 1000).alias("time_ms"),
        F.when(k % 2 == 1, F.col("o_custkey")).alias("sec"),
        F.when(k % 2 == 1, F.lit(250000000)).alias("nanosec"),
    )


@query(f"""WITH {RAW}
SELECT CAST(key AS VARCHAR) AS track_id, CASE WHEN source IS NULL OR lower(trim(source)) IN ('', 'nan', 'none', '<na>', 'null', 'nat') THEN 'candidate' ELSE trim(source) END AS source,
       TRY_CAST(x AS DOUBLE) AS x_m, coalesce(time_ms / 1000.0, sec + nanosec / 1e9)::DOUBLE AS time_s, 'default' AS sequence_id, 1.0::DOUBLE AS confidence FROM raw WHERE isfinite(TRY_CAST(x AS DOUBLE))""")
def normalize_candidates(spark, sf):
    aliased = _raw(spark, sf).select(F.col("key").alias("ID"), F.col("source").alias("Sensor"), F.col("x").alias("East_M"), F.lit(" 2 ").alias("y"), F.lit("3.5").alias("position.z"), F.col("time_ms").alias("Timestamp_ms"), F.col("sec"), F.col("nanosec"))
    out = readers.normalize_candidates(aliased, default_source="candidate", default_sequence="default")
    return out.select("track_id", "source", "x_m", "time_s", "sequence_id", "confidence")


@query(f"WITH {RAW} SELECT key, coalesce(time_ms / 1000.0, sec + nanosec / 1e9)::DOUBLE AS time_s FROM raw")
def normalize_times(spark, sf):
    d = _raw(spark, sf)
    return d.select("key", parse.seconds(d).alias("time_s"))


@query(f"""WITH {RAW} SELECT key, CASE WHEN track = '<NA>' THEN NULL ELSE regexp_replace(track, '^(-?\\d+)\\.0+$', '\\1') END AS track_id FROM raw""")
def canonical_track_id(spark, sf):
    return _raw(spark, sf).select("key", parse.canonical_id(F.col("track")).alias("track_id"))


@query(f"WITH {RAW} SELECT key, CASE lower(trim(used)) WHEN 'yes' THEN true WHEN '1' THEN true WHEN 'false' THEN false END AS used FROM raw")
def persisted_boolean(spark, sf):
    return _raw(spark, sf).select("key", parse.flag(F.col("used"), "used").alias("used"))


ENU = """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey AS key, round(-sl * dx + cl * dy, 4) + 0.0 AS east_m,
       round(-sp * cl * dx - sp * sl * dy + cp * dz, 4) + 0.0 AS north_m, round(cp * cl * dx + cp * sl * dy + sp * dz, 4) + 0.0 AS up_m
FROM (
  SELECT *, (n + alt) * cos(phi) * cos(lam) - (n0 + 100) * cos(radians(35.0)) * cos(radians(-78.0)) AS dx,
         (n + alt) * cos(phi) * sin(lam) - (n0 + 100) * cos(radians(35.0)) * sin(radians(-78.0)) AS dy,
         (n * (1 - e2) + alt) * sin(phi) - (n0 * (1 - e2) + 100) * sin(radians(35.0)) AS dz,
         sin(radians(35.0)) AS sp, cos(radians(35.0)) AS cp, sin(radians(-78.0)) AS sl, cos(radians(-78.0)) AS cl
  FROM (
    SELECT *, 6378137.0 / sqrt(1 - e2 * sin(phi) * sin(phi)) AS n, 6378137.0 / sqrt(1 - e2 * sin(radians(35.0)) * sin(radians(35.0))) AS n0
    FROM (
      SELECT *, radians(35 + l_quantity / 1000) AS phi, radians(-78 + l_discount / 10) AS lam, l_tax * 1000 AS alt,
             (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e2
      FROM lineitem)))"""


@query(ENU)
def enu_projection(spark, sf):
    e, n, u = geo.lla_to_enu(F.lit(35) + F.col("l_quantity") / 1000, F.lit(-78) + F.col("l_discount") / 10, F.col("l_tax") * 1000, (35.0, -78.0, 100.0))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").select(key.alias("key"), (r6(e, 4) + 0.0).alias("east_m"), (r6(n, 4) + 0.0).alias("north_m"), (r6(u, 4) + 0.0).alias("up_m"))


@query(f"""WITH {CANDIDATES} SELECT key, round(x_m * cos(z_m / 20) * sin(y_m / 3), 6) AS x, round(x_m * cos(z_m / 20) * cos(y_m / 3), 6) AS y, round(x_m * sin(z_m / 20), 6) AS z,
round(sqrt((2 * cos(z_m / 20)) ** 2 + (abs(x_m) * cos(z_m / 20) * 0.05) ** 2), 6) AS std_xy_m FROM cand""")
def radar_polar_candidates(spark, sf):
    az, el = F.col("y_m") / 3, F.col("z_m") / 20
    x, y, z = geo.polar_to_cartesian(F.col("x_m"), az, el)
    return candidates(spark, sf).select("key", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"), r6(geo.polar_std(F.col("x_m"), el, 2.0, 0.05, 0.05)[0]).alias("std_xy_m"))


@query(f"WITH {CANDIDATES} SELECT key, round((x_m - 25) * z_m / 500, 6) + 0.0 AS x, round((y_m - 5) * z_m / 480, 6) + 0.0 AS y, z_m AS z FROM cand")
def camera_backprojection(spark, sf):
    x, y, z = geo.backproject_pixel(F.col("x_m"), F.col("y_m"), F.col("z_m"), 500.0, 480.0, 25.0, 5.0)
    return candidates(spark, sf).select("key", (r6(x) + 0.0).alias("x"), (r6(y) + 0.0).alias("y"), z.alias("z"))


CALIBRATION = {"A": (0.0, (1.0, 2.0, 3.0)), "N": (0.5, (0.0, -1.0, 0.0)), "R": (-0.25, (4.0, 0.0, 0.5))}


@query(f"""WITH {CANDIDATES}, cal(source, a, ox, oy, oz) AS (VALUES ('A', 0.0, 1.0, 2.0, 3.0), ('N', 0.5, 0.0, -1.0, 0.0), ('R', -0.25, 4.0, 0.0, 0.5))
SELECT key, round(cos(a) * x_m - sin(a) * y_m + ox, 6) AS x, round(sin(a) * x_m + cos(a) * y_m + oy, 6) AS y, round(z_m + oz, 6) AS z FROM cand JOIN cal USING (source)""")
def transform_candidates(spark, sf):
    cal = spark.createDataFrame([(s, a, *o) for s, (a, o) in CALIBRATION.items()], "source string, a double, ox double, oy double, oz double")
    d = candidates(spark, sf).join(F.broadcast(cal), "source")  # a row per sensor, fixed above
    c, s = F.cos("a"), F.sin("a")
    x, y, z = geo.affine(F.col("x_m"), F.col("y_m"), F.col("z_m"), [[c, -s, 0], [s, c, 0], [0, 0, 1]], [F.col("ox"), F.col("oy"), F.col("oz")])
    return d.select("key", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query(f"WITH {CANDIDATES} SELECT sequence_id, count(*) AS n, avg(CASE WHEN x_m <= 40 THEN 1.0 ELSE 0.0 END) AS share FROM cand WHERE y_m >= 5 GROUP BY sequence_id")
def range_gated_share(spark, sf):
    d = candidates(spark, sf).where("y_m >= 5")  # the class-probability gate
    return d.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("x_m") <= 40).cast("double")).alias("share"))


@query(f"""WITH {MEASUREMENTS}, span AS (SELECT sequence_id, min(time_s) AS a, max(time_s) AS b FROM meas WHERE source = 'purchase' GROUP BY 1)
SELECT key, round(time_s + 1.5, 6) AS shifted_s FROM meas JOIN span USING (sequence_id) WHERE source = 'click' AND time_s + 1.5 BETWEEN a AND b""")
def inside_truth_window(spark, sf):
    m = measurements(spark, sf)
    span = m.where("source = 'purchase'").groupBy("sequence_id").agg(F.min("time_s").alias("a"), F.max("time_s").alias("b"))
    d = m.where("source = 'click'").withColumn("shifted", F.col("time_s") + 1.5).join(span, "sequence_id")
    return d.where("shifted BETWEEN a AND b").select("key", r6("shifted").alias("shifted_s"))


# --- joins

CLICKS = "click AS (SELECT * FROM meas WHERE source = 'click'), buy AS (SELECT sequence_id, time_s, max_by(x_m, key) AS x_m, max_by(y_m, key) AS y_m FROM meas WHERE source = 'purchase' GROUP BY 1, 2)"
BRACKET = f"""{CLICKS}, prev AS (SELECT c.key, b.time_s AS t0, b.x_m AS x0, b.y_m AS y0 FROM click c ASOF LEFT JOIN buy b ON c.sequence_id = b.sequence_id AND c.time_s >= b.time_s),
nxt AS (SELECT c.key, b.time_s AS t1, b.x_m AS x1, b.y_m AS y1 FROM click c ASOF LEFT JOIN buy b ON c.sequence_id = b.sequence_id AND c.time_s < b.time_s),
br AS (SELECT c.*, t0, x0, y0, t1, x1, y1, (t1 IS NOT NULL AND (t0 IS NULL OR t1 - time_s < time_s - t0)) AS later FROM click c JOIN prev USING (key) JOIN nxt USING (key)),
near AS (SELECT *, CASE WHEN later THEN t1 ELSE t0 END AS tm, CASE WHEN later THEN x1 ELSE x0 END AS xm, CASE WHEN later THEN y1 ELSE y0 END AS ym FROM br)"""


def _clicks(spark, sf):
    m = measurements(spark, sf)
    return m.where("source = 'click'"), m.where("source = 'purchase'").select("sequence_id", "time_s", "x_m", "y_m", "key")


@query(f"WITH {MEASUREMENTS}, {BRACKET} SELECT key, round(tm, 6) AS match_s, xm AS match_x FROM near")
def nearest_time_join(spark, sf):
    a, b = _clicks(spark, sf)
    d = J.asof_nearest(a, b, ["sequence_id"], payload=["x_m", "key"], order="key")
    return d.select("key", r6("match.t").alias("match_s"), F.col("match.x_m").alias("match_x"))


@query(f"""WITH {MEASUREMENTS}, {BRACKET} SELECT key, CASE WHEN t0 = time_s THEN round(x0, 6) WHEN least(time_s - t0, t1 - time_s) <= 200000 THEN round(x0 + (x1 - x0) * (time_s - t0) / (t1 - t0), 6) END AS x_at FROM br""")
def interpolate_positions(spark, sf):
    a, b = _clicks(spark, sf)
    d = J.interpolated(a.select("sequence_id", "time_s", "key"), b.drop("key").withColumn("o", F.col("x_m")), ["sequence_id"], ["x_m"], max_delta=200_000.0)
    return d.select("key", r6("x_m_at").alias("x_at"))


@query(f"""WITH {MEASUREMENTS}, {BRACKET}, e AS (SELECT sequence_id, xm, x_m - xm AS rx, y_m - ym AS ry FROM near WHERE abs(tm - time_s) <= 200000)
SELECT sequence_id, count(*) AS n, round(avg(rx), 6) AS mean_rx, round(avg(ry), 6) AS mean_ry, round(covar_samp(rx, rx), 9) AS cov_rx_rx, round(covar_samp(rx, ry), 9) AS cov_rx_ry, round(covar_samp(ry, ry), 9) AS cov_ry_ry
FROM e GROUP BY sequence_id HAVING count(*) > 1""")
def empirical_covariance(spark, sf):
    a, b = _clicks(spark, sf)
    d = J.asof_nearest(a, b, ["sequence_id"], payload=["x_m", "y_m", "key"], order="key", tolerance=200_000.0).where("match IS NOT NULL")
    d = d.select("sequence_id", (F.col("x_m") - F.col("match.x_m")).alias("rx"), (F.col("y_m") - F.col("match.y_m")).alias("ry"))
    out = G.residual_covariance(d, ["sequence_id"], ["rx", "ry"]).where("n > 1")
    return rounded(rounded(out, "mean_rx", "mean_ry"), "cov_rx_rx", "cov_rx_ry", "cov_ry_ry", n=9)


@query(f"""WITH {MEASUREMENTS}, {BRACKET}, ok AS (SELECT key, sequence_id, source, time_s, sqrt((x_m - xm) ** 2 + (y_m - ym) ** 2) AS d FROM near WHERE abs(tm - time_s) <= 300000)
SELECT key, round(d, 6) AS distance_m FROM ok WHERE d <= 40""")
def truth_gated_rows(spark, sf):
    a, b = _clicks(spark, sf)
    d = J.asof_nearest(a, b, ["sequence_id"], payload=["x_m", "y_m", "key"], order="key", tolerance=300_000.0)
    d = d.withColumn("d", geo.distance([F.col("x_m"), F.col("y_m")], [F.col("match.x_m"), F.col("match.y_m")]))
    return d.where("d <= 40").select("key", r6("d").alias("distance_m"))


@query(f"""WITH {CANDIDATES}, p AS (SELECT a.key, b.source AS s, b.candidate_branch AS br, sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2 + (a.z_m - b.z_m) ** 2) AS d
FROM cand a JOIN cand b ON a.sequence_id = b.sequence_id AND a.source <> b.source AND abs(a.time_s - b.time_s) <= 1)
SELECT cand.key, count(d) AS neighbors, count(DISTINCT s) AS sources, count(DISTINCT br) AS branches, round(min(d), 6) AS nearest_m
FROM cand LEFT JOIN p ON cand.key = p.key AND d <= 6 GROUP BY cand.key""")
def branch_consensus(spark, sf):
    out = J.branch_consensus(candidates(spark, sf), 1.0, 6.0)
    return out.select("key", "neighbors", "sources", "branches", r6("nearest_m").alias("nearest_m"))


@query(f"""WITH {CANDIDATES}, f AS (SELECT *, dense_rank() OVER (PARTITION BY sequence_id ORDER BY time_s) AS fr FROM cand),
p AS (SELECT a.key, b.fr - a.fr AS step, sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2 + (a.z_m - b.z_m) ** 2) AS d, abs(a.time_s - b.time_s) AS g
FROM f a JOIN f b ON a.sequence_id = b.sequence_id AND abs(a.fr - b.fr) = 1)
SELECT cand.key, round(min(CASE WHEN step = -1 THEN d END), 6) AS backward_m, round(min(CASE WHEN step = 1 THEN d END), 6) AS forward_m
FROM cand LEFT JOIN p ON cand.key = p.key AND g <= 2 AND d <= g * 5 GROUP BY cand.key""")
def temporal_consensus(spark, sf):
    return rounded(J.temporal_support(candidates(spark, sf), 2.0, 5.0).select("key", "backward_m", "forward_m"), "backward_m", "forward_m")


@query(f"""WITH {MEASUREMENTS}, {BRACKET}, hit AS (SELECT c.key, b.x_m FROM click c JOIN buy b ON c.sequence_id = b.sequence_id AND abs(c.time_s - b.time_s) <= 50000)
SELECT key, false AS fallback, count(*) AS n, round(avg(x_m), 6) AS mean_x FROM hit GROUP BY key UNION ALL SELECT key, true, 1, round(xm, 6) FROM near WHERE tm IS NOT NULL AND key NOT IN (SELECT key FROM hit)""")
def interval_join(spark, sf):
    a, b = _clicks(spark, sf)
    b = b.groupBy("sequence_id", "time_s").agg(F.max_by("x_m", "key").alias("x_m"), F.max("key").alias("key"))
    d = J.interval_groups(a.select("sequence_id", "time_s", "key"), b, ["sequence_id"], 50_000.0)
    return d.groupBy("key", "fallback").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x_m_r")).alias("mean_x"))


@query(f"""WITH {CANDIDATES} SELECT a.sequence_id, a.time_s, count(*) AS pairs, round(min(sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2 + (a.z_m - b.z_m) ** 2)), 6) AS nearest_m
FROM cand a JOIN cand b ON a.sequence_id = b.sequence_id AND a.time_s = b.time_s AND a.key < b.key AND sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2 + (a.z_m - b.z_m) ** 2) <= 5 GROUP BY 1, 2""")
def spatial_radius_join(spark, sf):
    d = J.radius_pairs(candidates(spark, sf), ["sequence_id", "time_s"], "key", 5.0, gridded=("x_m",))  # a frame has few rows
    return d.groupBy("sequence_id", "time_s").agg(F.count(F.lit(1)).alias("pairs"), r6(F.min("distance_m")).alias("nearest_m"))


@query(f"""WITH {CANDIDATES}, a AS (SELECT source, count(*) AS n, avg(x_m) AS m FROM cand WHERE CAST(sequence_id AS INT) < 50 AND source <> 'R' GROUP BY 1),
b AS (SELECT source, count(*) AS n, avg(x_m) AS m FROM cand WHERE CAST(sequence_id AS INT) >= 50 AND source <> 'A' GROUP BY 1)
SELECT source, a.n AS n_train, b.n AS n_heldout, round(a.m, 6) AS mean_train, round(b.m, 6) AS mean_heldout FROM a FULL JOIN b USING (source)""")
def calibration_transfer(spark, sf):
    c = candidates(spark, sf)
    seq = F.col("sequence_id").cast("int")
    part = lambda d, s: d.groupBy("source").agg(F.count(F.lit(1)).alias(f"n_{s}"), r6(F.avg("x_m")).alias(f"mean_{s}"))
    return part(c.where((seq < 50) & (F.col("source") != "R")), "train").join(part(c.where((seq >= 50) & (F.col("source") != "A")), "heldout"), "source", "full_outer")


# --- aggregations

SUMMARY = "count(e) AS n, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS max"
STATS = ("mean", "std", "rmse", "mae", "p50", "p95", "max")


@query(f"WITH {CANDIDATES}, c AS (SELECT source, abs(x_m - 25) + y_m / 10 AS e FROM cand) SELECT source, {SUMMARY} FROM c GROUP BY source")
def error_summary(spark, sf):
    d = candidates(spark, sf).withColumn("e", F.abs(F.col("x_m") - 25) + F.col("y_m") / 10)
    return rounded(d.groupBy("source").agg(*G.error_summary(F.col("e"))), *STATS)


@query(f"WITH {CANDIDATES}, c AS (SELECT sequence_id, abs(x_m - 25) AS e FROM cand) SELECT sequence_id, {SUMMARY} FROM c GROUP BY GROUPING SETS ((), (sequence_id))")
def pooled_and_per_sequence(spark, sf):
    d = candidates(spark, sf).withColumn("e", F.abs(F.col("x_m") - 25))
    return rounded(G.pooled_and_grouped(d, "sequence_id", G.error_summary(F.col("e"))), *STATS)


@query(f"""WITH {CANDIDATES}, g AS (SELECT source, candidate_branch, count(*) AS n, avg(x_m * x_m / 600) AS raw FROM cand GROUP BY 1, 2)
SELECT source, candidate_branch, n, round(raw, 6) AS raw, round(CASE WHEN n >= 20 THEN least(greatest(raw, 0.25), 25) ELSE 1 END, 6) AS scale FROM g""")
def nis_covariance_calibration(spark, sf):
    out = G.scale_calibration(candidates(spark, sf), ["source", "candidate_branch"], F.col("x_m") * F.col("x_m") / 600, 0.25, 25.0, 20)
    return rounded(out, "raw", "scale")


@query(f"""WITH {CANDIDATES}, b AS (SELECT least(floor((y_m / 10) * 10), 9)::INT AS bin, y_m / 10 AS p, CASE WHEN x_m > 25 THEN 1.0 ELSE 0.0 END AS y FROM cand),
g AS (SELECT bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM b GROUP BY bin)
SELECT bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(abs(mean_p - rate), 6) AS gap, round(n / sum(n) OVER () * abs(mean_p - rate), 6) AS ece_share FROM g""")
def reliability_table(spark, sf):
    return rounded(G.reliability(candidates(spark, sf), F.col("y_m") / 10, F.col("x_m") > 25), "mean_p", "rate", "gap", "ece_share")


@query(f"""WITH {CANDIDATES}, v AS (SELECT sequence_id, source AS label, sum(x_m) AS w FROM cand GROUP BY 1, 2)
SELECT sequence_id, label, w FROM v QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY w DESC, label) = 1""")
def class_vote(spark, sf):
    d = candidates(spark, sf).withColumnRenamed("source", "label")
    return G.class_vote(d, ["sequence_id"], "label", F.col("x_m"))


@query(f"""WITH {CANDIDATES}, c AS (SELECT sequence_id, source, count(*) AS c FROM cand GROUP BY 1, 2), p AS (SELECT *, c / sum(c) OVER (PARTITION BY sequence_id) AS p FROM c)
SELECT sequence_id, count(*) AS items, round(max(p), 6) AS dominant, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1""")
def track_purity(spark, sf):
    return rounded(G.shares(candidates(spark, sf), ["sequence_id"], "source", 2.0), "dominant", "entropy")


@query(f"""WITH {CANDIDATES}, d AS (SELECT source, x_m AS v, CAST(sequence_id AS INT) >= 50 AS s FROM cand), g AS (SELECT source, v, count(*) FILTER (NOT s) AS a, count(*) FILTER (s) AS b FROM d GROUP BY 1, 2),
k AS (SELECT source, abs(sum(a) OVER w / nullif(sum(a) OVER (PARTITION BY source), 0) - sum(b) OVER w / nullif(sum(b) OVER (PARTITION BY source), 0)) AS gap FROM g WINDOW w AS (PARTITION BY source ORDER BY v ROWS UNBOUNDED PRECEDING)),
m AS (SELECT source, avg(v) FILTER (NOT s) AS mean_a, avg(v) FILTER (s) AS mean_b, stddev_pop(v) FILTER (NOT s) AS std_a FROM d GROUP BY 1)
SELECT source, round(max(gap), 6) AS ks, round(any_value(mean_a), 6) AS mean_a, round(any_value(mean_b), 6) AS mean_b, round(any_value((mean_b - mean_a) / nullif(std_a, 0)), 6) AS shift FROM k JOIN m USING (source) GROUP BY source""")
def domain_shift(spark, sf):
    out = G.ks_shift(candidates(spark, sf), ["source"], "x_m", F.col("sequence_id").cast("int") >= 50)
    return rounded(out.select("source", "ks", "mean_a", "mean_b", "shift"), "ks", "mean_a", "mean_b", "shift")


@query(f"""WITH {TRAJECTORIES}, r AS (SELECT phase, x_m, count(*) OVER (PARTITION BY phase) AS n, row_number() OVER (PARTITION BY phase ORDER BY x_m) AS rn FROM traj)
SELECT phase, n, least(n, greatest(1, CAST(ceil((n + 1) * 0.9) AS BIGINT))) AS k, x_m AS radius FROM r WHERE rn = least(n, greatest(1, CAST(ceil((n + 1) * 0.9) AS BIGINT)))""")
def conformal_radius(spark, sf):
    return G.conformal_radius(trajectories(spark, sf), ["phase"], "x_m", 0.1)


@query("SELECT d.lang AS truth, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'good' ELSE 'bad' END AS guess, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2")
def classification_confusion(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return G.confusion(d.withColumn("guess", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").otherwise("bad")), "lang", "guess")


PROBS = "probs AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: exp(CAST(x AS DOUBLE))) AS w FROM embeddings), pn AS (SELECT vec_id, label, list_transform(w, lambda x: x / list_sum(w)) AS p FROM probs)"


def _probabilities(spark, sf):
    w = F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x.cast("double")))
    d = table(spark, sf, "embeddings").withColumn("w", w)
    return d.withColumn("p", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda s, y: s + y)))


@query(f"WITH {PROBS} SELECT vec_id, round(-list_sum(list_transform(p, lambda x: greatest(x, 1e-9) * ln(greatest(x, 1e-9)))), 6) AS entropy FROM pn")
def probability_entropy(spark, sf):
    return _probabilities(spark, sf).select("vec_id", r6(parse.entropy(F.col("p"))).alias("entropy"))


@query(f"WITH {PROBS} SELECT count(*) AS n, round(avg(-ln(greatest(p[label % 10 + 1], 1e-9))), 6) AS nll FROM pn")
def multiclass_nll(spark, sf):
    y = F.get("p", (F.col("label") % 10).cast("int"))
    return _probabilities(spark, sf).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(-F.log(F.greatest(y, F.lit(1e-9))))).alias("nll"))


@query(f"""WITH {PROBS}, c AS (SELECT list_max(p) AS conf, CASE WHEN list_position(p, list_max(p)) - 1 = label % 10 THEN 1.0 ELSE 0.0 END AS hit FROM pn), b AS (SELECT least(floor(conf * 10), 9)::INT AS bin, conf, hit FROM c),
g AS (SELECT bin, count(*) AS n, abs(avg(conf) - avg(hit)) AS gap FROM b GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM g""")
def expected_calibration_error(spark, sf):
    d = _probabilities(spark, sf).withColumn("conf", F.array_max("p"))
    hit = F.array_position("p", F.col("conf")) - 1 == F.col("label") % 10
    return G.reliability(d, F.col("conf"), hit).agg(r6(F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


@query(f"""WITH {PROBS}, t(t) AS (VALUES (0.5), (1.0), (1.5), (2.0), (3.0)), s AS (SELECT t, list_transform(p, lambda x: pow(x, 1 / t)) AS q, label FROM pn, t),
g AS (SELECT t AS temperature, round(avg(-ln(greatest(q[label % 10 + 1] / list_sum(q), 1e-9))), 6) AS nll FROM s GROUP BY t) SELECT *, nll = min(nll) OVER () AS best FROM g""")
def temperature_grid(spark, sf):
    """A grid of five literals exploded per row: no join."""
    d = _probabilities(spark, sf).withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in (0.5, 1, 1.5, 2, 3)])))
    d = d.withColumn("q", F.transform("p", lambda x: F.pow(x, 1 / F.col("temperature"))))
    y = F.get("q", (F.col("label") % 10).cast("int")) / F.aggregate("q", F.lit(0.0), lambda s, v: s + v)
    g = d.groupBy("temperature").agg(r6(F.avg(-F.log(F.greatest(y, F.lit(1e-9))))).alias("nll"))
    return g.withColumn("best", F.col("nll") == F.min("nll").over(Window.partitionBy()))


# --- ranking and selection

RANKS = """rk AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY score DESC, key) AS g, row_number() OVER (PARTITION BY sequence_id, time_s, source ORDER BY score DESC, key) AS s,
row_number() OVER (PARTITION BY sequence_id, time_s, candidate_branch ORDER BY score DESC, key) AS b FROM cand)"""


def _reservoir_sql(cap: int | None) -> str:
    capped = f"QUALIFY row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY protected DESC, score DESC, key) <= {cap}" if cap else ""
    return f"""WITH {CANDIDATES}, {RANKS},
kept AS (SELECT *, concat_ws('|', CASE WHEN g <= 2 THEN 'global_top_n' END, CASE WHEN s <= 1 THEN 'source:' || source END, CASE WHEN b <= 1 THEN 'branch:' || candidate_branch END) AS reasons, (s <= 1 OR b <= 1) AS protected
FROM rk WHERE g <= 2 OR s <= 1 OR b <= 1), capped AS (SELECT * FROM kept {capped})
SELECT key, sequence_id, time_s, score, reasons, protected, row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY score DESC, key) AS reservoir_rank FROM capped"""


RESERVOIR = ("key", "sequence_id", "time_s", "score", "reasons", "protected", "reservoir_rank")


@query(_reservoir_sql(None))
def candidate_reservoir(spark, sf):
    return longs(S.reservoir(candidates(spark, sf)).select(*RESERVOIR), "reservoir_rank")


@query(_reservoir_sql(3))
def capped_reservoir(spark, sf):
    return longs(S.reservoir(candidates(spark, sf), cap=3).select(*RESERVOIR), "reservoir_rank")


@query(f"WITH {CANDIDATES} SELECT key, sequence_id, time_s FROM cand WHERE y_m >= 5 QUALIFY row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY y_m DESC, score DESC, key) = 1")
def best_per_frame(spark, sf):
    return S.best_per_frame(candidates(spark, sf).where("y_m >= 5"), S.FRAME, [F.col("y_m").desc(), F.col("score").desc(), F.col("key")]).select("key", "sequence_id", "time_s")


@query(f"WITH {CANDIDATES} SELECT key, row_number() OVER w AS cell_rank FROM cand WINDOW w AS (PARTITION BY sequence_id, time_s, source, candidate_branch ORDER BY score DESC, key) QUALIFY row_number() OVER w <= 2")
def source_branch_quota(spark, sf):
    return S.cell_quota(candidates(spark, sf), 2, F.col("score").desc()).select("key", F.col("cell_rank").cast("long").alias("cell_rank"))


@query(f"WITH {CANDIDATES} SELECT key, row_number() OVER w AS cell_rank FROM cand WINDOW w AS (PARTITION BY sequence_id, time_s, source, candidate_branch ORDER BY z_m, key) QUALIFY row_number() OVER w <= 1")
def uncertainty_quota(spark, sf):
    return S.cell_quota(candidates(spark, sf), 1, F.col("z_m").asc()).select("key", F.col("cell_rank").cast("long").alias("cell_rank"))


@query(f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, time_s, source ORDER BY score DESC, key) AS rd FROM cand)
SELECT key, row_number() OVER w AS pick FROM r WINDOW w AS (PARTITION BY sequence_id, time_s ORDER BY rd, score DESC, key) QUALIFY row_number() OVER w <= 4""")
def stratified_selection(spark, sf):
    return S.stratified(candidates(spark, sf), 4, "source").select("key", F.col("pick").cast("long").alias("pick"))


@query(f"""WITH {CANDIDATES}, g AS (SELECT *, max(score) OVER (PARTITION BY sequence_id, time_s, source) AS gs FROM cand), d AS (SELECT *, dense_rank() OVER (PARTITION BY sequence_id, time_s ORDER BY gs DESC, source) AS group_rank FROM g)
SELECT key, group_rank, row_number() OVER w AS sibling_rank FROM d WHERE group_rank <= 2 WINDOW w AS (PARTITION BY sequence_id, time_s, source ORDER BY score DESC, key) QUALIFY row_number() OVER w <= 2""")
def hypothesis_group_topk(spark, sf):
    return S.group_topk(candidates(spark, sf), "source", 2, 2).select("key", F.col("group_rank").cast("long").alias("group_rank"), F.col("sibling_rank").cast("long").alias("sibling_rank"))


@query(f"""WITH {CANDIDATES}, e AS (SELECT *, exp((x_m - max(x_m) OVER (PARTITION BY sequence_id, time_s)) / 10) AS e FROM cand), p AS (SELECT *, e / sum(e) OVER (PARTITION BY sequence_id, time_s) AS p FROM e),
m AS (SELECT *, round(sum(p) OVER w - p, 9) AS before, row_number() OVER w AS pick FROM p WINDOW w AS (PARTITION BY sequence_id, time_s ORDER BY x_m DESC, key ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, least(5, greatest(1, sum(CASE WHEN before < 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id, time_s))) AS budget FROM m) SELECT key, pick, CAST(budget AS BIGINT) AS budget FROM b WHERE pick <= budget""")
def posterior_mass_topk(spark, sf):
    return S.mass_topk(candidates(spark, sf), 0.9, 1, 5, 10.0, "x_m").select("key", F.col("pick").cast("long").alias("pick"), F.col("budget").cast("long").alias("budget"))


@query(f"""WITH {CANDIDATES}, e AS (SELECT *, exp((x_m - max(x_m) OVER f) / 10) AS e, row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY x_m DESC, key) AS rn FROM cand WINDOW f AS (PARTITION BY sequence_id, time_s)),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY sequence_id, time_s) AS p FROM e)
SELECT sequence_id, time_s, count(*) AS n, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, round(max(x_m) FILTER (rn = 1) - max(x_m) FILTER (rn = 2), 6) AS margin, round(1 / sum(p * p), 6) AS effective_n FROM p GROUP BY 1, 2""")
def candidate_ambiguity(spark, sf):
    out = rounded(S.ambiguity(candidates(spark, sf), 10.0, "x_m"), "entropy", "margin", "effective_n")
    return out.withColumn("entropy", F.col("entropy") + 0.0)


METHODS = "meth AS (SELECT sequence_id AS method, round(avg(x_m), 4) AS p95, round(avg(y_m), 4) AS wall, count(*) AS n FROM cand GROUP BY 1)"


def _methods(spark, sf):
    return candidates(spark, sf).groupBy(F.col("sequence_id").alias("method")).agg(F.round(F.avg("x_m"), 4).alias("p95"), F.round(F.avg("y_m"), 4).alias("wall"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {CANDIDATES}, {METHODS} SELECT method, p95, row_number() OVER (ORDER BY p95, wall, method) AS rank FROM meth")
def leaderboard(spark, sf):
    return S.leaderboard(_methods(spark, sf), [F.col("p95"), F.col("wall"), F.col("method")]).select("method", "p95", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CANDIDATES}, {METHODS}, m AS (SELECT *, wall <= 5 AND n >= 10 AS eligible FROM meth) SELECT method, eligible, CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY p95, method) END AS rank FROM m")
def conservative_rank(spark, sf):
    return S.eligible_rank(_methods(spark, sf), F.expr("wall <= 5 AND n >= 10"), [F.col("p95"), F.col("method")]).select("method", "eligible", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CANDIDATES}, {METHODS} SELECT method, NOT EXISTS (SELECT 1 FROM meth o WHERE o.p95 <= m.p95 AND o.wall <= m.wall AND (o.p95 < m.p95 OR o.wall < m.wall)) AS pareto FROM meth m")
def accuracy_runtime_pareto(spark, sf):
    return S.pareto(_methods(spark, sf), "p95", "wall").select("method", "pareto")


# --- windows, segments, sessions

SEG = """sg AS (SELECT *, sum(nw) OVER (PARTITION BY sequence_id ORDER BY time_s, key ROWS UNBOUNDED PRECEDING) AS segment FROM
(SELECT *, CASE WHEN time_s - lag(time_s) OVER (PARTITION BY sequence_id ORDER BY time_s, key) > 120 THEN 1 ELSE 0 END AS nw FROM traj))"""
SEGT = f"{SEG}, st AS (SELECT sequence_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(time_s) AS start_s, max(time_s) AS end_s, avg(x_m) AS mean, max(x_m) AS mx FROM sg GROUP BY 1, 2)"


def _segments(spark, sf):
    return W.segments(trajectories(spark, sf), ["sequence_id"], ["time_s", "key"], 120.0)


@query(f"WITH {TRAJECTORIES}, {SEGT} SELECT sequence_id, segment, n, start_s, end_s, round(mean, 9) AS mean, mx AS max FROM st")
def continuous_segments(spark, sf):
    return rounded(W.segment_table(_segments(spark, sf), ["sequence_id"], "x_m"), "mean", n=9)


@query(f"""WITH {TRAJECTORIES}, {SEGT} SELECT sequence_id, segment, n, round(mean, 9) AS mean FROM st QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY n DESC, end_s - start_s DESC, mean DESC, start_s, segment) = 1""")
def largest_track_segment(spark, sf):
    t = W.segment_table(_segments(spark, sf), ["sequence_id"], "x_m")
    return rounded(W.largest_segment(t, ["sequence_id"]).select("sequence_id", "segment", "n", "mean"), "mean", n=9)


@query(f"""WITH {TRAJECTORIES}, i AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY time_s, key) AS rn FROM traj), o AS (SELECT *, rn - row_number() OVER (PARTITION BY sequence_id ORDER BY time_s, key) AS g FROM i WHERE x_m > 200)
SELECT sequence_id, min(time_s) AS start_s, max(time_s) AS end_s, count(*) AS n, max(x_m) AS max, max(time_s) - min(time_s) AS duration_s FROM o GROUP BY sequence_id, g""")
def recovery_events(spark, sf):
    return W.runs_above(trajectories(spark, sf), ["sequence_id"], ["time_s", "key"], "x_m", 200.0)


@query(f"""WITH {TRAJECTORIES}, {SEG} SELECT key, row_number() OVER w - 1 AS age, row_number() OVER (PARTITION BY sequence_id, segment ORDER BY time_s, key) AS streak, coalesce(time_s - lag(time_s) OVER w, 0) AS gap_s,
round(avg(x_m) OVER (PARTITION BY sequence_id ORDER BY time_s, key ROWS 9 PRECEDING), 9) AS trail_mean, min(x_m) OVER (PARTITION BY sequence_id ORDER BY time_s, key ROWS 9 PRECEDING) AS trail_min FROM sg WINDOW w AS (PARTITION BY sequence_id ORDER BY time_s, key)""")
def track_level_features(spark, sf):
    out = W.track_features(trajectories(spark, sf), ["sequence_id"], ["time_s", "key"], "x_m", 10, 120.0)
    return rounded(longs(out.select("key", "age", "streak", "gap_s", "trail_mean", "trail_min"), "age", "streak"), "trail_mean", n=9)


@query(f"""WITH {TRAJECTORIES}, o AS (SELECT sequence_id, x_m, time_s - min(time_s) OVER (PARTITION BY sequence_id) AS t FROM traj), w AS (SELECT sequence_id, x_m, unnest(range(CAST(greatest(0, floor((t - 400) / 100) + 1) AS BIGINT), CAST(floor(t / 100) AS BIGINT) + 1)) AS win FROM o)
SELECT sequence_id, win AS "window", count(*) AS n, round(sqrt(avg(x_m * x_m)), 9) AS rmse, round(quantile_cont(x_m, 0.95), 9) AS p95, max(x_m) AS max FROM w GROUP BY 1, 2""")
def sliding_bad_segments(spark, sf):
    return rounded(W.sliding_windows(trajectories(spark, sf), ["sequence_id"], "x_m", 400.0, 100.0), "rmse", "p95", n=9)


@query(f"""WITH {TRAJECTORIES}, o AS (SELECT sequence_id, x_m, CAST(floor((time_s - min(time_s) OVER (PARTITION BY sequence_id)) / 365) AS BIGINT) AS win FROM traj)
SELECT sequence_id, win AS "window", count(*) AS n, round(avg(x_m), 9) AS mean, round(sqrt(avg(x_m * x_m)), 9) AS rmse, max(x_m) AS max FROM o GROUP BY 1, 2""")
def tumbling_error_summary(spark, sf):
    return rounded(W.tumbling(trajectories(spark, sf), ["sequence_id"], "x_m", 365.0), "mean", "rmse", n=9)


@query(f"""WITH {TRAJECTORIES}, l AS (SELECT *, lag(source) OVER w AS p, time_s - lag(time_s) OVER w AS g FROM traj WINDOW w AS (PARTITION BY sequence_id ORDER BY time_s, key))
SELECT sequence_id, count(*) AS n, count(*) FILTER (p IS NOT NULL AND p <> source) AS switches, count(*) FILTER (g > 200) AS long_gaps, round(quantile_cont(g, 0.95), 9) AS gap_p95, max(g) AS gap_max FROM l GROUP BY 1""")
def track_switch_metrics(spark, sf):
    return rounded(W.switches(trajectories(spark, sf), ["sequence_id"], ["time_s", "key"], "source", 200.0), "gap_p95", n=9)


@query(f"""WITH {TRAJECTORIES}, l AS (SELECT *, coalesce(lag(source) OVER w, 'start') AS p, time_s - lag(time_s) OVER w AS g FROM traj WINDOW w AS (PARTITION BY sequence_id ORDER BY time_s, key)),
c AS (SELECT x_m AS e, CASE WHEN g > 200 THEN 'after_long_gap' WHEN source = 'F' AND p <> 'F' THEN 'first_F_after_nonF' WHEN source = 'O' AND p <> 'O' THEN 'first_O_after_nonO' ELSE 'last_' || p END AS label FROM l)
SELECT label, {SUMMARY} FROM c GROUP BY label""")
def error_attribution(spark, sf):
    d = W.transition_labels(trajectories(spark, sf), ["sequence_id"], ["time_s", "key"], "source", 200.0, ("F", "O"))
    return rounded(d.groupBy("label").agg(*G.error_summary(F.col("x_m"))), *STATS)


@query(f"""WITH {TRAJECTORIES}, d AS (SELECT *, x_m - avg(x_m) OVER (PARTITION BY sequence_id) AS d FROM traj), l AS (SELECT sequence_id, d, lag(d, 1) OVER w AS l1, lag(d, 2) OVER w AS l2 FROM d WINDOW w AS (PARTITION BY sequence_id ORDER BY time_s, key)),
g AS (SELECT sequence_id, count(*) AS n, sum(d * l1) / sum(d * d) AS r1, sum(d * l2) / sum(d * d) AS r2 FROM l GROUP BY 1 HAVING count(*) > 3)
SELECT sequence_id, n, round(r1, 6) AS r1, round(r2, 6) AS r2, round(n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)), 6) AS ljung_box FROM g""")
def residual_whiteness(spark, sf):
    return rounded(W.autocorrelation(trajectories(spark, sf), ["sequence_id"], ["time_s", "key"], "x_m", 2), "r1", "r2", "ljung_box")


# --- set operations and audits

@query(f"WITH {CANDIDATES}, t AS (SELECT DISTINCT candidate_branch AS b FROM cand) SELECT 'full' AS pool, count(*) AS n, round(avg(x_m), 6) AS mean FROM cand UNION ALL SELECT 'without_' || b, count(*), round(avg(x_m), 6) FROM cand JOIN t ON candidate_branch <> b GROUP BY b UNION ALL SELECT 'only_' || b, count(*), round(avg(x_m), 6) FROM cand JOIN t ON candidate_branch = b GROUP BY b")
def branch_ablation_pools(spark, sf):
    """Pools from per-branch sums: the candidates are read once and never multiplied."""
    c = candidates(spark, sf)
    sums = c.groupBy("candidate_branch").agg(F.count(F.lit(1)).alias("n"), F.sum("x_m").alias("s"))
    w = Window.partitionBy()
    d = sums.select("candidate_branch", "n", "s", F.sum("n").over(w).alias("all_n"), F.sum("s").over(w).alias("all_s"))
    pool = lambda name, n, s: F.struct(name.alias("pool"), n.alias("n"), r6(s / n).alias("mean"))
    b = F.col("candidate_branch")
    rows = d.select(F.explode(F.array(pool(F.concat(F.lit("without_"), b), F.col("all_n") - F.col("n"), F.col("all_s") - F.col("s")), pool(F.concat(F.lit("only_"), b), F.col("n"), F.col("s")), pool(F.lit("full"), F.col("all_n"), F.col("all_s")))).alias("p"))
    return rows.select("p.*").groupBy("pool").agg(F.first("n").alias("n"), F.first("mean").alias("mean"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_predictions(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT c_custkey AS sequence_id, 'missing' AS status FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'sparse' FROM orders GROUP BY 1 HAVING count(*) < 5")
def prediction_coverage(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    gone = c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.col("c_custkey").alias("sequence_id"), F.lit("missing").alias("status"))
    return gone.union(o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n < 5").select("o_custkey", F.lit("sparse")))


@query(f"WITH {TRAJECTORIES} SELECT sequence_id, time_s, x_m FROM traj QUALIFY row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY key DESC) = 1")
def keep_last_duplicate_time(spark, sf):
    return W.keep_last_time(trajectories(spark, sf), ["sequence_id"], "time_s", "key").select("sequence_id", "time_s", "x_m")


@query(f"WITH {CANDIDATES} SELECT sequence_id, time_s, round(quantile_cont(x_m, 0.5), 6) AS x_m, count(*) AS n FROM cand GROUP BY 1, 2")
def median_truth_by_time(spark, sf):
    return candidates(spark, sf).groupBy("sequence_id", "time_s").agg(r6(F.percentile("x_m", 0.5)).alias("x_m"), F.count(F.lit(1)).alias("n"))


# --- ensembles and repair

FRAMES = "GROUP BY sequence_id, time_s"


@query(f"WITH {CANDIDATES} SELECT sequence_id, time_s, count(*) AS n, round(sum((1 + z_m) * x_m) / sum(1 + z_m), 6) AS x_m, round(sum((1 + z_m) * y_m) / sum(1 + z_m), 6) AS y_m FROM cand {FRAMES}")
def ensemble_weighted_mean(spark, sf):
    return rounded(T.weighted_mean(candidates(spark, sf).withColumn("weight", 1 + F.col("z_m")), S.FRAME, ["x_m", "y_m"]), "x_m", "y_m")


@query(f"""WITH {CANDIDATES}, g AS (SELECT sequence_id, time_s, x_m, sum(1 + z_m) AS w FROM cand GROUP BY 1, 2, 3), c AS (SELECT *, sum(w) OVER (PARTITION BY sequence_id, time_s ORDER BY x_m ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY sequence_id, time_s) AS t FROM g)
SELECT sequence_id, time_s, min(x_m) AS x_m FROM c WHERE c >= t / 2 {FRAMES}""")
def ensemble_weighted_median(spark, sf):
    return T.weighted_median(candidates(spark, sf).withColumn("weight", 1 + F.col("z_m")), S.FRAME, "x_m")


@query(f"""WITH {CANDIDATES}, r AS (SELECT *, count(*) OVER (PARTITION BY sequence_id, time_s) AS n, row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY x_m, key) AS r FROM cand)
SELECT sequence_id, time_s, round(sum((1 + z_m) * x_m) / sum(1 + z_m), 6) AS x_m, count(*) AS kept FROM r WHERE r > floor(n * 0.2) AND r <= n - floor(n * 0.2) {FRAMES}""")
def ensemble_trimmed_mean(spark, sf):
    return rounded(T.trimmed_mean(candidates(spark, sf).withColumn("weight", 1 + F.col("z_m")), S.FRAME, "x_m", 0.2, ["key"]), "x_m")


@query(f"""WITH {CANDIDATES}, w AS (SELECT *, 1 / (least(greatest(y_m, 1), 8) ** 2) AS w FROM cand) SELECT sequence_id, time_s, count(*) AS n, round(sum(w * x_m) / sum(w), 6) AS x_m, round(1 / sqrt(sum(w)), 6) AS sigma FROM w {FRAMES}""")
def uncertainty_ensemble(spark, sf):
    return rounded(T.inverse_variance(candidates(spark, sf), S.FRAME, ["x_m"], "y_m", 1.0, 8.0), "x_m", "sigma")


@query(f"""WITH {CANDIDATES} SELECT sequence_id, time_s, max(x_m) - min(x_m) AS spread, round(CASE WHEN max(x_m) - min(x_m) > 30 THEN arg_max(x_m, (1 + z_m, key)) ELSE sum((1 + z_m) * x_m) / sum(1 + z_m) END, 6) AS x_m, max(x_m) - min(x_m) > 30 AS guarded FROM cand {FRAMES}""")
def spread_guarded_ensemble(spark, sf):
    return rounded(T.spread_guard(candidates(spark, sf).withColumn("weight", 1 + F.col("z_m")), S.FRAME, "x_m", 30.0), "x_m")


@query(f"""WITH {TRAJECTORIES}, a AS (SELECT key, x_m, coalesce(list(x_m) OVER (PARTITION BY sequence_id ORDER BY time_s, key ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) || coalesce(list(x_m) OVER (PARTITION BY sequence_id ORDER BY time_s, key ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS a FROM traj),
a2 AS (SELECT key, x_m, coalesce(a, []) AS a, list_median(a) AS med FROM (SELECT key, x_m, list_filter(a, lambda v: v IS NOT NULL) AS a FROM a)), s AS (SELECT *, greatest(1.4826 * list_median(list_transform(a, lambda v: abs(v - med))), 1) AS sc, abs(x_m - med) AS res FROM a2)
SELECT key, coalesce(len(a) >= 2 AND res > 3 * sc AND res > 3, false) AS spike, round(CASE WHEN coalesce(len(a) >= 2 AND res > 3 * sc AND res > 3, false) THEN med ELSE x_m END, 9) AS repaired FROM s""")
def hampel_repair(spark, sf):
    out = T.hampel(trajectories(spark, sf), ["sequence_id"], ["time_s", "key"], "x_m", 2, 3.0, 1.0, 3.0)
    return rounded(out.select("key", "spike", "repaired"), "repaired", n=9)


@query(f"""WITH {TRAJECTORIES}, n AS (SELECT *, lag(x_m) OVER w AS p, lead(x_m) OVER w AS q, lag(time_s) OVER w AS tp, lead(time_s) OVER w AS tq FROM traj WINDOW w AS (PARTITION BY sequence_id ORDER BY time_s, key)),
l AS (SELECT *, p + (q - p) * (time_s - tp) / nullif(tq - tp, 0) AS ln FROM n), s AS (SELECT *, coalesce(abs(x_m - p) > 2 * (time_s - tp) AND abs(q - x_m) > 2 * (tq - time_s) AND abs(x_m - ln) > 25, false) AS spike FROM l)
SELECT key, spike, round(CASE WHEN spike THEN ln ELSE x_m END, 9) AS repaired FROM s""")
def temporal_spike_repair(spark, sf):
    out = T.temporal_spikes(trajectories(spark, sf), ["sequence_id"], ["time_s", "key"], "x_m", 2.0, 25.0)
    return rounded(out.select("key", "spike", "repaired"), "repaired", n=9)

