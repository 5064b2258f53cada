"""Queries whose keys are large: slices of time, scans, components, sketches, and their SQL twins."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..operators import association as AS
from ..operators import banded
from ..operators import components as N
from ..operators import evaluate as E
from ..operators import fits as FT
from ..operators import joins as J
from ..operators import kernels as K
from ..operators import matching as MT
from ..operators import repair as R
from ..operators import scan
from ..operators import select as S
from ..operators import sketches as SK
from ..operators import spread as SP
from ..operators import tracking_scores as TS
from ..operators import trajectories as T
from ..operators import windows as W
from ..operators.stored import shared_folder
from ..sources.point_source import points_reader
from .reference import BRACKET, PROBS, _clicks, _probabilities, longs, query, r6, rounded
from .reference_more import _single, cv_sql
from .views import CANDIDATES, MEASUREMENTS, TRAJECTORIES, candidates, measurements, table, trajectories

# --- one key over many tasks

ALL = """click AS (SELECT * FROM meas WHERE source = 'click'), buy AS (SELECT time_s, max_by(x_m, key) AS x_m FROM meas WHERE source = 'purchase' GROUP BY 1),
prev AS (SELECT c.key, b.time_s AS t0, b.x_m AS x0 FROM click c ASOF LEFT JOIN buy b ON c.time_s >= b.time_s),
nxt AS (SELECT c.key, b.time_s AS t1, b.x_m AS x1 FROM click c ASOF LEFT JOIN buy b ON c.time_s < b.time_s),
br AS (SELECT c.*, t0, x0, t1, x1, (t1 IS NOT NULL AND (t0 IS NULL OR t1 - time_s < time_s - t0)) AS later FROM click c JOIN prev USING (key) JOIN nxt USING (key))"""


def _all(spark, sf):
    m = measurements(spark, sf).withColumn("sequence_id", F.lit("all"))
    return m.where("source = 'click'").select("sequence_id", "time_s", "key"), m.where("source = 'purchase'").select("sequence_id", "time_s", "x_m", "key")


@query(f"WITH {MEASUREMENTS}, {ALL} SELECT key, round(CASE WHEN later THEN t1 ELSE t0 END, 6) AS match_s, CASE WHEN later THEN x1 ELSE x0 END AS match_x FROM br")
def nearest_time_one_key(spark, sf):
    a, b = _all(spark, sf)
    d = J.asof_nearest(a, b, ["sequence_id"], payload=["x_m", "key"], order="key", slices=64, least=100)
    return d.select("key", r6("match.t").alias("match_s"), F.col("match.x_m").alias("match_x"))


@query(f"WITH {MEASUREMENTS}, {ALL} SELECT key, CASE WHEN t0 = time_s THEN round(x0, 6) WHEN t1 IS NOT NULL THEN round(x0 + (x1 - x0) * (time_s - t0) / (t1 - t0), 6) END AS x_at FROM br")
def interpolate_one_key(spark, sf):
    a, b = _all(spark, sf)
    return J.interpolated(a, b, ["sequence_id"], ["x_m", "key"], order="key", slices=64, least=100).select("key", r6("x_m_at").alias("x_at"))


LONG = f"""{TRAJECTORIES.replace('traj AS', 'traj0 AS')}, traj AS (SELECT phase AS sequence_id, time_s, source, x_m, phase, key FROM traj0)"""


def _long(spark, sf):
    """The orders of each priority as one sequence, of which a few hold all rows."""
    return W.keep_last_time(trajectories(spark, sf).withColumn("sequence_id", F.col("phase")), ["sequence_id"], "time_s", "key")


#: The smoother as a recursion over the filter's rows.
SMOOTH = """sm AS (
  SELECT sequence_id, i, key, time_s, x, v FROM kf WHERE (sequence_id, i) IN (SELECT (sequence_id, max(i)) FROM kf GROUP BY sequence_id)
  UNION ALL
  SELECT f.sequence_id, f.i, f.key, f.time_s, f.x + ((u0 * pc - f.b * pb) * dx + (f.b * pa - u0 * pb) * dv) / det, f.v + ((u1 * pc - f.c * pb) * dx + (f.c * pa - u1 * pb) * dv) / det
  FROM (SELECT *, pa * pc - pb * pb AS det, a + dt * b AS u0, b + dt * c AS u1, nx - x - dt * v AS dx, nv - v AS dv FROM (
    SELECT f.*, s.time_s - f.time_s AS dt, s.x AS nx, s.v AS nv, f.a + 2 * (s.time_s - f.time_s) * f.b + (s.time_s - f.time_s) ** 2 * f.c + 0.25 * (s.time_s - f.time_s) ** 3 / 3 + 1e-12 AS pa,
           f.b + (s.time_s - f.time_s) * f.c + 0.25 * (s.time_s - f.time_s) ** 2 / 2 AS pb, f.c + 0.25 * (s.time_s - f.time_s) + 1e-12 AS pc
    FROM sm s JOIN kf f ON f.sequence_id = s.sequence_id AND f.i = s.i - 1)) f)"""


@query(f"WITH RECURSIVE {LONG}, {cv_sql(None)} SELECT sequence_id, key, round(x, 5) AS state_x_m, round(nis, 5) AS nis FROM kf")
def cv_filter_scan(spark, sf):
    d = scan.cv_filter(_long(spark, sf), ["x_m"], 25.0, 0.5, slices=16, least=100)
    return d.select("sequence_id", "key", r6("state_x_m", 5).alias("state_x_m"), r6("nis", 5).alias("nis"))


@query(f"""WITH RECURSIVE {LONG}, {cv_sql(None)}, {SMOOTH}
SELECT sequence_id, key, round(x, 4) AS state_x_m FROM sm""")
def cv_smooth_scan(spark, sf):
    return scan.cv_smooth(_long(spark, sf), ["x_m"], 25.0, 0.5, slices=16, least=100).select("sequence_id", "key", r6("state_x_m", 4).alias("state_x_m"))


# --- components

FRAME = ["sequence_id", "time_s"]
REACH = """reach AS (SELECT {node} AS a, {node} AS b FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)"""


@query(f"""WITH RECURSIVE {CANDIDATES}, p AS (SELECT *, floor(x_m / 3) AS cx, floor(y_m / 3) AS cy, floor(z_m / 3) AS cz FROM cand),
vox AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sequence_id, time_s, cx, cy, cz) AS v FROM (SELECT sequence_id, time_s, cx, cy, cz, count(*) AS n, min(key) AS least FROM p GROUP BY ALL)),
link AS MATERIALIZED (SELECT a.v AS a, b.v AS b FROM vox a JOIN vox b ON a.sequence_id = b.sequence_id AND a.time_s = b.time_s AND a.v <> b.v AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.cz - b.cz) <= 1),
{REACH.format(node='v', nodes='vox')}, root AS (SELECT a AS v, min(b) AS root FROM reach GROUP BY a),
size AS (SELECT root, sum(n) AS points, min(least) AS cluster FROM vox JOIN root USING (v) GROUP BY root HAVING sum(n) >= 3)
SELECT p.key, s.cluster, CAST(s.points AS BIGINT) AS points FROM p JOIN vox USING (sequence_id, time_s, cx, cy, cz) JOIN root USING (v) LEFT JOIN size s ON s.root = root.root""")
def voxel_clusters(spark, sf):
    return N.voxel_clusters(candidates(spark, sf).select(*FRAME, "key", "x_m", "y_m", "z_m"), FRAME, 3.0, 3).select("key", "cluster", F.col("cluster_points").alias("points"))


@query(f"""WITH RECURSIVE {CANDIDATES}, c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY key) AS v FROM cand), tm AS (SELECT DISTINCT sequence_id, time_s AS anchor_s FROM cand),
near AS MATERIALIZED (SELECT t.anchor_s, c.*, CAST(t.anchor_s AS BIGINT) * 10000000 + v AS node FROM tm t JOIN c ON c.sequence_id = t.sequence_id AND abs(c.time_s - t.anchor_s) <= 1),
link AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM near a JOIN near b ON a.sequence_id = b.sequence_id AND a.anchor_s = b.anchor_s AND a.v <> b.v
  AND (a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2 + (a.z_m - b.z_m) ** 2 <= 4),
{REACH.format(node='node', nodes='near')}, root AS MATERIALIZED (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
comp AS (SELECT root, any_value(sequence_id) AS sequence_id, any_value(anchor_s) AS anchor_s, count(*) AS n, list(v ORDER BY v) AS vs, sum(time_s * score) / sum(score) AS time_s, sum(x_m * score) / sum(score) AS x_m, sum(y_m * score) / sum(score) AS y_m,
  sum(z_m * score) / sum(score) AS z_m, sum(score) AS confidence, max(x_m) - min(x_m) AS ex, max(y_m) - min(y_m) AS ey, max(z_m) - min(z_m) AS ez FROM near JOIN root USING (node) GROUP BY root HAVING count(*) > 1 AND count(DISTINCT source) > 1),
once AS (SELECT * FROM comp QUALIFY row_number() OVER (PARTITION BY vs ORDER BY anchor_s) = 1)
SELECT sequence_id, anchor_s, n, round(time_s, 6) AS time_s, round(x_m, 6) AS x_m, round(y_m, 6) AS y_m, round(z_m, 6) AS z_m, round(confidence, 4) AS confidence, round(greatest(sqrt(ex * ex + ey * ey), 0.5), 6) AS std_xy_m, greatest(ez, 0.5) AS std_z_m FROM once""")
def cross_sensor_clusters(spark, sf):
    out = N.cross_sensor_clusters(candidates(spark, sf), 1.0, 2.0)
    return rounded(rounded(longs(out, "n"), "time_s", "x_m", "y_m", "z_m", "std_xy_m"), "confidence", n=4).select("sequence_id", "anchor_s", "n", "time_s", "x_m", "y_m", "z_m", "confidence", "std_xy_m", "std_z_m")


# --- tracking scores from mergeable counts

BOXES = """tru AS MATERIALIZED (SELECT sequence_id, CAST(time_s AS BIGINT) AS frame, ascii(source) AS id, x_m AS x, y_m AS y FROM cand QUALIFY row_number() OVER (PARTITION BY sequence_id, time_s, source ORDER BY key) = 1),
gue AS MATERIALIZED (SELECT sequence_id, frame, CASE WHEN frame % 5 <> 0 THEN id WHEN id = 65 THEN 78 WHEN id = 78 THEN 82 ELSE 65 END AS id, x + 2 + id / 100.0::DOUBLE AS x, y FROM tru WHERE frame % 7 <> 0)"""


def _scored_boxes(spark, sf):
    c = S.best_per_frame(candidates(spark, sf), [*FRAME, "source"], [F.col("key")])
    b = c.select("sequence_id", F.col("time_s").cast("long").alias("frame"), F.ascii("source").cast("long").alias("id"), F.col("x_m").alias("x"), F.col("y_m").alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    other = F.when(F.col("id") == 65, 78).when(F.col("id") == 78, 82).otherwise(65)
    g = b.where("frame % 7 <> 0").withColumn("x", F.col("x") + 2 + F.col("id") / 100).withColumn("id", F.when(F.col("frame") % 5 != 0, F.col("id")).otherwise(other))
    return b, g


def _option(t: int) -> str:
    return f"o{t} AS MATERIALIZED (SELECT sequence_id, frame, p, w FROM weighed WHERE t = {t} UNION ALL SELECT DISTINCT sequence_id, frame, NULL, 0.0 FROM pair)"


def _identity(t: int) -> str:
    return f"i{t} AS MATERIALIZED (SELECT sequence_id, p, ovl AS n, ovl + {_TIE} AS w FROM ali WHERE t = {t} AND ovl > 0 UNION ALL SELECT DISTINCT sequence_id, NULL, 0, 0.0 FROM ali)"


_TIE = "((t * 31 + p * 17 + t * p * 7) % 97) * (1e-9 / 97)"
#: The best of all one-to-one choices for three identities, by trying each.
_DISTINCT = "coalesce(a.p <> b.p, true) AND coalesce(a.p <> c.p, true) AND coalesce(b.p <> c.p, true)"
SCORES = f"""pair AS MATERIALIZED (SELECT *, i / (200 - i) AS s FROM (SELECT t.sequence_id, t.frame, t.id AS t, g.id AS p,
  greatest(0.0, least(t.x, g.x) + 10 - greatest(t.x, g.x)) * greatest(0.0, least(t.y, g.y) + 10 - greatest(t.y, g.y)) AS i FROM tru t JOIN gue g USING (sequence_id, frame)) WHERE i > 0),
shared AS (SELECT *, s / (sum(s) OVER (PARTITION BY sequence_id, frame, t) + sum(s) OVER (PARTITION BY sequence_id, frame, p) - s) AS part FROM pair),
nt AS (SELECT sequence_id, id AS t, count(*) AS n_t FROM tru GROUP BY 1, 2), np AS (SELECT sequence_id, id AS p, count(*) AS n_p FROM gue GROUP BY 1, 2),
ali AS MATERIALIZED (SELECT sequence_id, t, p, n_t, n_p, ovl, aligned / (n_t + n_p - aligned) AS jaccard FROM
  (SELECT sequence_id, t, p, sum(part) AS aligned, count(*) FILTER (s >= 0.5 - 1e-9) AS ovl FROM shared GROUP BY 1, 2, 3) JOIN nt USING (sequence_id, t) JOIN np USING (sequence_id, p)),
weighed AS MATERIALIZED (SELECT pair.*, jaccard * s + {_TIE} AS w FROM pair JOIN ali USING (sequence_id, t, p)), {_option(65)}, {_option(78)}, {_option(82)},
best AS (SELECT sequence_id, frame, a.p AS pa, b.p AS pb, c.p AS pc FROM o65 a JOIN o78 b USING (sequence_id, frame) JOIN o82 c USING (sequence_id, frame) WHERE {_DISTINCT}
  QUALIFY row_number() OVER (PARTITION BY sequence_id, frame ORDER BY a.w + b.w + c.w DESC) = 1),
chosen AS (SELECT pair.* FROM pair JOIN best USING (sequence_id, frame) WHERE (t = 65 AND p = pa) OR (t = 78 AND p = pb) OR (t = 82 AND p = pc)),
alp AS (SELECT k / 20.0::DOUBLE AS alpha FROM range(1, 20) r(k)),
hit AS (SELECT sequence_id, alpha, t, p, count(*) AS hits, sum(s) AS loc FROM chosen JOIN alp ON s >= alpha - 1e-9 GROUP BY 1, 2, 3, 4),
per AS (SELECT sequence_id, alpha, sum(hits) AS tp, sum(hits * hits / greatest(1, n_t + n_p - hits)) AS ass, sum(loc) AS loc FROM hit JOIN ali USING (sequence_id, t, p) GROUP BY 1, 2),
tot AS (SELECT coalesce(a.sequence_id, b.sequence_id) AS sequence_id, coalesce(a.n, 0) AS n_truth, coalesce(b.n, 0) AS n_guess FROM (SELECT sequence_id, count(*) AS n FROM tru GROUP BY 1) a FULL JOIN (SELECT sequence_id, count(*) AS n FROM gue GROUP BY 1) b USING (sequence_id)),
tab AS (SELECT sequence_id, alpha, sum(coalesce(tp, 0)) AS tp, sum(coalesce(ass, 0)) AS ass, sum(coalesce(loc, 0)) AS loc, sum(n_truth) AS n_truth, sum(n_guess) AS n_guess FROM (tot CROSS JOIN alp) LEFT JOIN per USING (sequence_id, alpha) GROUP BY GROUPING SETS ((sequence_id, alpha), (alpha))),
met AS (SELECT *, tp / greatest(1, n_truth + n_guess - tp) AS det, ass / greatest(1, tp) AS assoc, CASE WHEN tp > 0 THEN loc / tp ELSE 1 END AS place FROM tab), {_identity(65)}, {_identity(78)}, {_identity(82)},
idt AS (SELECT sequence_id, a.n + b.n + c.n AS id_tp FROM i65 a JOIN i78 b USING (sequence_id) JOIN i82 c USING (sequence_id) WHERE {_DISTINCT} QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY a.w + b.w + c.w DESC) = 1),
ids AS (SELECT sequence_id, sum(id_tp) AS id_tp FROM idt GROUP BY GROUPING SETS ((sequence_id), ())),
scores AS (SELECT m.sequence_id, avg(sqrt(det * assoc)) AS hota, min_by(sqrt(det * assoc), alpha) AS hota_low, avg(det) AS det_a, avg(assoc) AS ass_a, avg(place) AS loc_a, any_value(coalesce(id_tp, 0)) AS id_tp, any_value(2 * coalesce(id_tp, 0) / (n_truth + n_guess)) AS idf1
 FROM met m LEFT JOIN ids ON m.sequence_id IS NOT DISTINCT FROM ids.sequence_id GROUP BY m.sequence_id)"""


@query(f"WITH {CANDIDATES}, {BOXES}, {SCORES} SELECT sequence_id, round(hota, 6) AS hota, round(hota_low, 6) AS hota_low, round(det_a, 6) AS det_a, round(ass_a, 6) AS ass_a, round(loc_a, 6) AS loc_a, CAST(id_tp AS BIGINT) AS id_tp, round(idf1, 6) AS idf1 FROM scores")
def pooled_tracking_scores(spark, sf):
    out = TS.lts_scores(*_scored_boxes(spark, sf))
    return rounded(out.select("sequence_id", "hota", "hota_low", "det_a", "ass_a", "loc_a", "id_tp", "idf1"), "hota", "hota_low", "det_a", "ass_a", "loc_a", "idf1")


@query(f"WITH {CANDIDATES}, {BOXES}, {SCORES} SELECT count(*) AS n, round(avg(hota_low), 6) AS hota_low, round(avg(idf1), 6) AS idf1 FROM scores")
def organiser_tracking_means(spark, sf):
    out = TS.organiser_means(TS.lts_scores(*_scored_boxes(spark, sf)))
    return rounded(out.withColumnRenamed("rows", "n"), "hota_low", "idf1")


# --- mergeable sketches

GAMMA = SK.gamma_of(SK.ACCURACY)
_BUCKET = f"CASE WHEN {{v}} = 0 THEN 0 ELSE ceil(ln(abs({{v}})) / {math.log(GAMMA)!r}::DOUBLE) END"


def _sketched(value: str, keys: str, rows: str) -> str:
    return f"""sk AS (SELECT {keys}, sign({value}) AS side, CAST({_BUCKET.format(v=value)} AS INT) AS bucket, count(*) AS n FROM {rows} GROUP BY 1, 2, 3),
cum AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY side, side * bucket) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM sk)"""


_MID = f"max(side * pow({GAMMA!r}::DOUBLE, bucket) * {2 / (1 + GAMMA)!r}::DOUBLE) FILTER (upto - n < {{r}} AND {{r}} <= upto)"


@query(f"""WITH {CANDIDATES}, c AS (SELECT source, abs(x_m - 25) + y_m / 10 AS e FROM cand), {_sketched('e', 'source', 'c')},
q AS (SELECT source, {_MID.format(r='greatest(1, ceil(0.5 * total))')} AS p50, {_MID.format(r='greatest(1, ceil(0.95 * total))')} AS p95 FROM cum GROUP BY 1)
SELECT source, count(*) AS n, round(avg(e), 6) AS mean, round(sqrt(avg(e * e)), 6) AS rmse, round(max(e), 6) AS max, round(any_value(p50), 6) AS p50, round(any_value(p95), 6) AS p95 FROM c JOIN q USING (source) GROUP BY source""")
def sketched_error_summary(spark, sf):
    d = candidates(spark, sf).withColumn("e", F.abs(F.col("x_m") - 25) + F.col("y_m") / 10)
    return rounded(SK.error_summary(d, ["source"], "e").select("source", "n", "mean", "rmse", "max", "p50", "p95"), "mean", "rmse", "max", "p50", "p95")


@query(f"""WITH {TRAJECTORIES}, {_sketched('x_m', 'phase', 'traj')}, k AS (SELECT *, least(total, greatest(1, CAST(ceil((total + 1) * 0.9) AS BIGINT))) AS k FROM cum)
SELECT phase, CAST(any_value(total) AS BIGINT) AS n, CAST(any_value(k) AS BIGINT) AS k, round(max(CASE WHEN side > 0 THEN pow({GAMMA!r}::DOUBLE, bucket) ELSE 0 END) FILTER (upto - n < k AND k <= upto), 6) AS radius FROM k GROUP BY phase""")
def sketched_conformal_radius(spark, sf):
    return rounded(SK.conformal_radius(trajectories(spark, sf), ["phase"], "x_m", 0.1).select("phase", "n", "k", "radius"), "radius")


_NIS = "x_m * x_m / 625 + y_m * y_m / 25"


@query(f"""WITH {CANDIDATES}, c AS (SELECT source, {_NIS} AS e FROM cand), {_sketched('e', 'source', 'c')}, q AS (SELECT source, {_MID.format(r='greatest(1, ceil(0.95 * total))')} AS p95 FROM cum GROUP BY 1)
SELECT source, count(*) AS n, round(avg(e), 6) AS mean, round(avg(CASE WHEN e <= {K.chi2_quantile(0.9, 2)!r} THEN 1.0 ELSE 0.0 END), 6) AS inside_90, round(any_value(p95), 6) AS p95 FROM c JOIN q USING (source) GROUP BY source""")
def sketched_nis_reliability(spark, sf):
    d = candidates(spark, sf).withColumn("e", F.col("x_m") * F.col("x_m") / 625 + F.col("y_m") * F.col("y_m") / 25)
    return rounded(SK.nis_reliability(d, ["source"], "e", {"90": K.chi2_quantile(0.9, 2)}).select("source", "n", "mean", "inside_90", "p95"), "mean", "inside_90", "p95")


# --- score against distance

_APART = "sqrt((r.x - {b}.x) * (r.x - {b}.x) + (r.y - {b}.y) * (r.y - {b}.y) + (r.z - {b}.z) * (r.z - {b}.z))"
_BEST = "list_sort(list_transform(left_, lambda r: {'u': -(r.norm + {W} * (1 - exp(-least(r.d, {CAP}) / {SCALE}))), 's': -r.score, 'key': r.key, 'r': r}))[1].r"


def _greedy_sql(start: str, weight: float, scale: float, cap: float) -> str:
    """Rounds of the choice: ``start`` has sequence_id, time_s, left_ (items with distances d) and need."""
    best = _BEST.replace("{W}", f"{weight}::DOUBLE").replace("{CAP}", f"{cap}::DOUBLE").replace("{SCALE}", f"{scale}::DOUBLE")
    rest = f"list_transform(list_filter(left_, lambda r: r.key <> b.key), lambda r: {{'score': r.score, 'norm': r.norm, 'key': r.key, 'x': r.x, 'y': r.y, 'z': r.z, 'd': least(r.d, {_APART.format(b='b')})}})"
    return f"""rounds AS (SELECT sequence_id, time_s, 1 AS step, need, left_, {best} AS b FROM {start} WHERE need > 0 AND len(left_) > 0
  UNION ALL SELECT sequence_id, time_s, step + 1, need, left_, {best} AS b FROM (SELECT sequence_id, time_s, step, need, {rest} AS left_ FROM rounds) WHERE step < need AND len(left_) > 0)"""


_ITEM = "{'score': score, 'norm': norm, 'key': key, 'x': x_m, 'y': y_m, 'z': z_m, 'd': d}"


@query(f"""WITH RECURSIVE {CANDIDATES}, p AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, time_s, source ORDER BY score DESC, key) <= 1 OR row_number() OVER (PARTITION BY sequence_id, time_s, candidate_branch ORDER BY score DESC, key) <= 1 AS prot,
  CASE WHEN max(score) OVER f > min(score) OVER f THEN (score - min(score) OVER f) / (max(score) OVER f - min(score) OVER f) ELSE 0 END AS norm FROM cand WINDOW f AS (PARTITION BY sequence_id, time_s)),
n AS MATERIALIZED (SELECT *, count(*) FILTER (prot) OVER (PARTITION BY sequence_id, time_s) AS np, count(*) OVER (PARTITION BY sequence_id, time_s) AS nn FROM p),
pool AS (SELECT a.*, CASE WHEN np >= 5 THEN 1e300 ELSE coalesce((SELECT min(sqrt((a.x_m - c.x_m) * (a.x_m - c.x_m) + (a.y_m - c.y_m) * (a.y_m - c.y_m) + (a.z_m - c.z_m) * (a.z_m - c.z_m))) FROM n c WHERE c.prot AND c.sequence_id = a.sequence_id AND c.time_s = a.time_s), 1e300) END AS d
  FROM n a WHERE (np >= 5 AND prot) OR (np < 5 AND NOT prot)),
start AS MATERIALIZED (SELECT sequence_id, time_s, any_value(CASE WHEN np >= 5 THEN 5 ELSE least(5 - np, nn - np) END) AS need, any_value(np) AS np, list({_ITEM}) AS left_ FROM pool GROUP BY 1, 2), {_greedy_sql('start', 1.0, 10.0, 50.0)}
SELECT sequence_id, time_s, key, row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY score DESC, key) AS rank, 'protected' AS reason, NULL::DOUBLE AS min_distance_m FROM n WHERE prot AND np < 5
UNION ALL SELECT r.sequence_id, r.time_s, b.key, CASE WHEN np >= 5 THEN step ELSE np + step END, CASE WHEN np >= 5 THEN 'protected_cap' ELSE 'spatial_fill' END, CASE WHEN b.d < 1e300 THEN round(b.d, 6) END FROM rounds r JOIN start USING (sequence_id, time_s)""")
def spatial_diversity_cap(spark, sf):
    return rounded(longs(SP.spatial_cap(candidates(spark, sf), 5), "rank"), "min_distance_m")


@query(f"""WITH RECURSIVE {CANDIDATES}, g0 AS (SELECT sequence_id, time_s, source AS key, max(x_m) AS score, arg_max({{'x_m': x_m, 'y_m': y_m, 'z_m': z_m}}, x_m) AS a, list({{'s': -x_m, 'key': key, 'x': x_m, 'y': y_m, 'z': z_m}}) AS l FROM cand GROUP BY 1, 2, 3),
g1 AS (SELECT sequence_id, time_s, key, score, list_sort(l)[1].x AS x_m, list_sort(l)[1].y AS y_m, list_sort(l)[1].z AS z_m, 1e300 AS d, CASE WHEN max(score) OVER f > min(score) OVER f THEN (score - min(score) OVER f) / (max(score) OVER f - min(score) OVER f) ELSE 0 END AS norm,
  exp((score - max(score) OVER f) / 10.0::DOUBLE) AS e, count(*) OVER f AS nn FROM g0 WINDOW f AS (PARTITION BY sequence_id, time_s)),
g2 AS MATERIALIZED (SELECT *, (1 - 0.02::DOUBLE) * e / sum(e) OVER (PARTITION BY sequence_id, time_s) + 0.02::DOUBLE / nn AS p FROM g1),
g3 AS MATERIALIZED (SELECT *, row_number() OVER w AS i, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM g2 WINDOW w AS (PARTITION BY sequence_id, time_s ORDER BY p DESC, key)),
start AS MATERIALIZED (SELECT sequence_id, time_s, least(greatest(count(*) FILTER (upto < 0.8 - 1e-12) + 1, 1), 2, count(*)) AS need, list({_ITEM}) AS left_ FROM g3 GROUP BY 1, 2), {_greedy_sql('start', 0.5, 5.0, 30.0)},
own AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, time_s, source ORDER BY x_m DESC, key) AS sibling_rank FROM cand)
SELECT o.key, r.step AS group_rank, o.sibling_rank, CAST(r.need AS BIGINT) AS budget, round(g.upto, 6) AS retained_mass FROM rounds r JOIN own o ON o.sequence_id = r.sequence_id AND o.time_s = r.time_s AND o.source = r.b.key AND o.sibling_rank <= 2
JOIN g3 g ON g.sequence_id = r.sequence_id AND g.time_s = r.time_s AND g.i = r.need""")
def posterior_mass_groups(spark, sf):
    out = SP.group_mass_topk(candidates(spark, sf), "source", 0.8, 1, 2, 2, temperature=10.0, score="x_m")
    return rounded(longs(out.select("key", "group_rank", "sibling_rank", "budget", "retained_mass"), "group_rank", "sibling_rank", "budget"), "retained_mass")


# --- matching of times

CHAINS = """side AS (SELECT sequence_id, time_s, key, CASE source WHEN 'click' THEN 0 ELSE 1 END AS s FROM meas WHERE source IN ('click', 'purchase')),
gap AS (SELECT *, CASE WHEN time_s - lag(time_s) OVER (PARTITION BY sequence_id ORDER BY time_s, s, key) > 40000 THEN 1 ELSE 0 END AS g FROM side),
chain AS (SELECT *, sum(g) OVER (PARTITION BY sequence_id ORDER BY time_s, s, key ROWS UNBOUNDED PRECEDING) AS ch FROM gap),
num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sequence_id, ch, s ORDER BY time_s, key) AS i FROM chain)"""


@query(f"""WITH RECURSIVE {MEASUREMENTS}, {CHAINS}, opt AS MATERIALIZED (SELECT w.sequence_id, w.ch, w.i, f.i AS j, abs(f.time_s - w.time_s) AS d, w.key, f.key AS fk FROM num w JOIN num f ON f.sequence_id = w.sequence_id AND f.ch = w.ch AND w.s = 0 AND f.s = 1 AND abs(f.time_s - w.time_s) <= 40000
  UNION ALL SELECT sequence_id, ch, i, NULL, 0, key, NULL FROM num WHERE s = 0),
st AS (SELECT DISTINCT sequence_id, ch, 0::BIGINT AS i, 0::BIGINT AS j, 0 AS n, 0.0::DOUBLE AS d, []::STRUCT(k BIGINT, m BIGINT)[] AS picks FROM num WHERE s = 0
  UNION ALL SELECT st.sequence_id, st.ch, o.i, coalesce(o.j, st.j), st.n + CASE WHEN o.j IS NULL THEN 0 ELSE 1 END, st.d + o.d, CASE WHEN o.j IS NULL THEN picks ELSE list_append(picks, {{'k': o.key, 'm': o.fk}}) END
  FROM st JOIN opt o ON o.sequence_id = st.sequence_id AND o.ch = st.ch AND o.i = st.i + 1 AND (o.j IS NULL OR o.j > st.j)),
best AS (SELECT sequence_id, unnest(picks) AS p FROM (SELECT * FROM st WHERE (sequence_id, ch, i) IN (SELECT (sequence_id, ch, max(i)) FROM num WHERE s = 0 GROUP BY sequence_id, ch) QUALIFY row_number() OVER (PARTITION BY sequence_id, ch ORDER BY n DESC, d) = 1))
SELECT sequence_id, p.k AS key, p.m AS match_key FROM best""")
def optimal_timestamp_assignment(spark, sf):
    a, b = _clicks(spark, sf)
    return MT.optimal_times(a, b, ["sequence_id"], 40_000.0).select("sequence_id", "key", "match_key")


_TRACK = "CASE WHEN CAST(sequence_id AS INT) % 5 = 0 OR key % 3 = 0 THEN {none} ELSE 't' || (key % {n}) END"


@query(f"""WITH RECURSIVE {MEASUREMENTS}, sub AS (SELECT *, {_TRACK.format(none='NULL', n=3)} AS track FROM meas WHERE source = 'click'), tru AS (SELECT *, {_TRACK.format(none='NULL', n=2)} AS track FROM meas WHERE source = 'purchase'),
tracks AS (SELECT DISTINCT sequence_id, track FROM tru WHERE track IS NOT NULL), rule AS (SELECT t.sequence_id, coalesce(count(DISTINCT k.track), 0) > 1 OR coalesce(bool_or(k.track IN (SELECT track FROM sub WHERE sub.sequence_id = t.sequence_id)), false) AS strict FROM (SELECT DISTINCT sequence_id FROM tru) t LEFT JOIN tracks k USING (sequence_id) GROUP BY 1),
pre AS (SELECT s.*, CASE WHEN r.sequence_id IS NULL THEN 'missing_sequence_truth' WHEN strict AND k.track IS NULL THEN 'track_id_mismatch' END AS why, CASE WHEN strict THEN s.track ELSE '' END AS grp FROM sub s LEFT JOIN rule r USING (sequence_id) LEFT JOIN tracks k ON k.sequence_id = s.sequence_id AND k.track = s.track),
pred AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sequence_id, grp ORDER BY key) AS n FROM pre WHERE why IS NULL),
pool AS MATERIALIZED (SELECT t.sequence_id, CASE WHEN strict THEN track ELSE '' END AS grp, list({{'t': time_s, 'key': key, 'x': x_m, 'y': y_m}}) AS l FROM tru t JOIN rule USING (sequence_id) WHERE NOT strict OR track IS NOT NULL GROUP BY 1, 2),
go AS (SELECT p.sequence_id, p.grp, 0::BIGINT AS n, 0::BIGINT AS key, NULL::STRUCT(t DOUBLE, "key" BIGINT, x DOUBLE, y DOUBLE) AS pick, false AS near, []::BIGINT[] AS used, l FROM (SELECT DISTINCT sequence_id, grp FROM pred) p JOIN pool USING (sequence_id, grp)
  UNION ALL SELECT sequence_id, grp, n, key, CASE WHEN b.d <= 40000 THEN b.r END, near, CASE WHEN b.d <= 40000 THEN list_append(used, b.r.key) ELSE used END, l FROM (
    SELECT g.sequence_id, g.grp, p.n, p.key, g.used, g.l, list_sort(list_transform(list_filter(g.l, lambda r: NOT list_contains(g.used, r.key)), lambda r: {{'d': abs(r.t - p.time_s), 't': r.t, 'k': r.key, 'r': r}}))[1] AS b,
      list_min(list_transform(g.l, lambda r: abs(r.t - p.time_s))) <= 40000 AS near FROM go g JOIN pred p ON p.sequence_id = g.sequence_id AND p.grp = g.grp AND p.n = g.n + 1))
SELECT s.key, g.pick IS NOT NULL AS matched, CASE WHEN g.pick IS NULL THEN coalesce(s.why, CASE WHEN g.near THEN 'duplicate_truth_match' ELSE 'time_gate' END) END AS reason, g.pick.key AS truth_key, round(sqrt((s.x_m - g.pick.x) ** 2 + (s.y_m - g.pick.y) ** 2), 6) AS error_2d_m
FROM pre s LEFT JOIN go g ON g.n > 0 AND g.sequence_id = s.sequence_id AND g.key = s.key""")
def submission_matches(spark, sf):
    a, b = _clicks(spark, sf)
    track = lambda n: F.when((F.col("sequence_id").cast("int") % 5 == 0) | (F.col("key") % 3 == 0), F.lit("nan")).otherwise(F.concat(F.lit("t"), F.col("key") % n))
    out = MT.match_submission(a.withColumn("track_id", track(3)), b.withColumn("track_id", track(2)), 40_000.0, ("x_m", "y_m"))
    return rounded(out.select("key", "matched", "reason", "truth_key", "error_2d_m"), "error_2d_m")


# --- penalised second differences

ELIMINATED = """one AS MATERIALIZED (SELECT *, row_number() OVER w AS i, time_s - lag(time_s) OVER w AS b, lag(time_s) OVER w - lag(time_s, 2) OVER w AS a, lag(x_m) OVER w AS before FROM (SELECT sequence_id, time_s, key, x_m FROM traj QUALIFY row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY key DESC) = 1) WINDOW w AS (PARTITION BY sequence_id ORDER BY time_s)),
gap AS MATERIALIZED (SELECT *, b / a AS r, pow(b * (a + b) / 2, 2) / {weight} AS q FROM one),
down AS (SELECT sequence_id, i, key, x_m AS m1, before AS m2, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 1.0::DOUBLE AS p22 FROM one WHERE i = 2
  UNION ALL SELECT sequence_id, i, key, n1 + s11 / (s11 + 1) * (z - n1), n2 + s12 / (s11 + 1) * (z - n1), s11 - s11 / (s11 + 1) * s11, s12 - s12 / (s11 + 1) * s11, s22 - s12 / (s11 + 1) * s12 FROM (
    SELECT g.sequence_id, g.i, g.key, g.x_m AS z, (1 + r) * m1 - r * m2 AS n1, m1 AS n2, (1 + r) * (1 + r) * p11 - 2 * (1 + r) * r * p12 + r * r * p22 + q AS s11, (1 + r) * p11 - r * p12 AS s12, p11 AS s22 FROM down d JOIN gap g ON g.sequence_id = d.sequence_id AND g.i = d.i + 1)),
up AS (SELECT sequence_id, i, key, m1 AS x1, m2 AS x2 FROM down WHERE (sequence_id, i) IN (SELECT (sequence_id, max(i)) FROM down GROUP BY sequence_id)
  UNION ALL SELECT sequence_id, i, key, m1 + ((f1 * s22 - g1 * s12) * d1 + (g1 * s11 - f1 * s12) * d2) / det, m2 + ((f2 * s22 - g2 * s12) * d1 + (g2 * s11 - f2 * s12) * d2) / det FROM (SELECT *, s11 * s22 - s12 * s12 AS det FROM (
    SELECT d.*, u.x1 - ((1 + r) * m1 - r * m2) AS d1, u.x2 - m1 AS d2, (1 + r) * p11 - r * p12 AS f1, p11 AS g1, (1 + r) * p12 - r * p22 AS f2, p12 AS g2,
      (1 + r) * (1 + r) * p11 - 2 * (1 + r) * r * p12 + r * r * p22 + q AS s11, (1 + r) * p11 - r * p12 AS s12, p11 AS s22 FROM up u JOIN down d ON d.sequence_id = u.sequence_id AND d.i = u.i - 1 JOIN gap g ON g.sequence_id = d.sequence_id AND g.i = d.i + 1)))
SELECT o.key, round(CASE WHEN o.i > 1 THEN u.x1 WHEN s.key IS NULL THEN o.x_m ELSE s.x2 END, 4) AS x_m FROM one o LEFT JOIN up u ON u.sequence_id = o.sequence_id AND u.i = o.i LEFT JOIN up s ON s.sequence_id = o.sequence_id AND s.i = 2"""


@query(f"WITH RECURSIVE {TRAJECTORIES}, {ELIMINATED.format(weight='1e4::DOUBLE')}")
def trajectory_regularizer(spark, sf):
    return banded.smoothed(_single(spark, sf), ["x_m"], 1e4, slices=16, least=100).select("key", r6("x_m", 4).alias("x_m"))


@query(f"WITH RECURSIVE {LONG}, {ELIMINATED.format(weight='1e3::DOUBLE')}")
def long_trajectory_smoothing(spark, sf):
    return banded.smoothed(_long(spark, sf), ["x_m"], 1e3, slices=16, least=100).select("key", r6("x_m", 4).alias("x_m"))


# --- Newton steps, ridge moments, nested hold-outs

def _newton_sql(steps: int) -> str:
    """Steps of the temperature's inverse, unrolled."""
    out = ["b0 AS (SELECT 1.0::DOUBLE AS b)"]
    for k in range(steps):
        out.append(f"""t{k} AS (SELECT l, y, (SELECT b FROM b{k}) AS b FROM lg), e{k} AS (SELECT l, y, list_transform(l, lambda x: exp((x - list_max(l)) * b)) AS e FROM t{k}),
m{k} AS (SELECT l[y] AS own, list_sum(list_transform(list_zip(e, l), lambda v: v[1] * v[2])) / list_sum(e) AS m, list_sum(list_transform(list_zip(e, l), lambda v: v[1] * v[2] * v[2])) / list_sum(e) AS s FROM e{k}),
b{k + 1} AS MATERIALIZED (SELECT least(greatest((SELECT b FROM b{k}) - avg(m - own) / avg(s - m * m), 0.05), 20.0) AS b FROM m{k})""")
    return ", ".join(out)


@query(f"""WITH {PROBS}, lg AS MATERIALIZED (SELECT list_transform(p, lambda x: ln(greatest(x, 1e-9))) AS l, label % 10 + 1 AS y FROM pn WHERE label % 10 < len(p)), {_newton_sql(10)}
SELECT (SELECT count(*) FROM lg) AS n, round(1 / b, 6) AS temperature FROM b10""")
def temperature_newton(spark, sf):
    got = FT.temperature(_probabilities(spark, sf), "p", F.col("label") % 10)
    return spark.range(1).select(F.lit(got["n"]).alias("n"), r6(F.lit(got["temperature"])).alias("temperature"))


def _logit_sql(steps: int) -> str:
    out = ["c0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        out.append(f"""p{k} AS (SELECT x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM xy, c{k}), h{k} AS (SELECT sum(p - y) AS g0, sum((p - y) * x) AS g1, sum(p * (1 - p)) AS h0, sum(p * (1 - p) * x) AS h1, sum(p * (1 - p) * x * x) AS h2 FROM p{k}),
c{k + 1} AS MATERIALIZED (SELECT a - (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b - (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM c{k}, h{k})""")
    return ", ".join(out)


@query(f"""WITH {CANDIDATES}, xy AS (SELECT x_m / 50 AS x, CASE WHEN score > 38000 * (x_m / 50) * (0.5 + y_m / 10) THEN 1.0 ELSE 0.0 END AS y FROM cand), {_logit_sql(10)}
SELECT c.key, round(1 / (1 + exp(-(a + b * c.x_m / 50))), 6) AS p FROM cand c, c10""")
def platt_newton(spark, sf):
    d = candidates(spark, sf).withColumn("x", F.col("x_m") / 50).withColumn("y", (F.col("score") > 38000 * (F.col("x_m") / 50) * (0.5 + F.col("y_m") / 10)).cast("double"))
    model = FT.logistic(d, ["x"], "y")
    return d.select("key", r6(FT.logistic_score(model, ["x"])).alias("p"))


RIDGE = """m AS (SELECT count(*) AS n, avg(t) AS my, avg(x) AS mx, avg(z) AS mz, stddev_pop(x) AS sx, stddev_pop(z) AS sz, covar_pop(x, t) AS cx, covar_pop(z, t) AS cz, covar_pop(x, z) AS xz FROM f),
w AS (SELECT *, n + 1.0 AS d, n * xz / (sx * sz) AS o, n * cx / sx AS bx, n * cz / sz AS bz FROM m), s AS (SELECT *, (d * bx - o * bz) / (d * d - o * o) AS wx, (d * bz - o * bx) / (d * d - o * o) AS wz FROM w)"""


@query(f"""WITH {CANDIDATES}, f AS (SELECT key, x_m AS x, z_m AS z, ln(1 + abs(x_m - 5 * y_m)) AS t FROM cand), {RIDGE}
SELECT key, round(least(greatest(exp(my + wx * (x - mx) / sx + wz * (z - mz) / sz) - 1, 1), 30), 6) AS predicted_sigma_m FROM f, s""")
def candidate_uncertainty(spark, sf):
    d = candidates(spark, sf).withColumn("e", F.abs(F.col("x_m") - 5 * F.col("y_m")))
    return rounded(FT.candidate_sigma(d, ["x_m", "z_m"], "e").select("key", "predicted_sigma_m"), "predicted_sigma_m")


@query(f"""WITH {CANDIDATES}, f AS (SELECT key, x_m AS x, z_m AS z, ln(pow(x_m - 5 * y_m, 2) + 1e-6) AS t FROM cand), {RIDGE} SELECT key, round(exp((my + wx * (x - mx) / sx + wz * (z - mz) / sz) / 2), 6) AS noise_std FROM f, s""")
def heteroscedastic_noise(spark, sf):
    d = candidates(spark, sf).withColumn("e", F.col("x_m") - 5 * F.col("y_m"))
    return rounded(FT.noise_scale(d, ["x_m", "z_m"], "e").select("key", "noise_std"), "noise_std")


@query(f"""WITH {CANDIDATES}, o AS (SELECT sequence_id AS g, count(*) AS n, sum(x_m - 5 * y_m) AS s, sum((x_m - 5 * y_m) ** 2) AS q FROM cand GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(s) AS ts FROM o), st(k) AS (VALUES (0.0::DOUBLE), (10.0), (1000.0), (100000.0)),
i AS (SELECT h.g AS h, k, avg(sqrt((v.q - 2 * b * v.s + v.n * b * b) / v.n)) AS r FROM (SELECT v.g, v.n, v.s, v.q, h.g AS hg, k, (ts - v.s - h.s) / (tn - v.n - h.n + k) AS b FROM o v, o h, t, st WHERE v.g <> h.g) v JOIN o h ON h.g = v.hg GROUP BY 1, 2),
c AS (SELECT h, k, r FROM i QUALIFY row_number() OVER (PARTITION BY h ORDER BY r, k) = 1)
SELECT g AS sequence_id, k AS strength, round(r, 6) AS inner_rmse, round((ts - s) / (tn - n + k), 6) AS correction, round(sqrt((q - 2 * (ts - s) / (tn - n + k) * s + n * ((ts - s) / (tn - n + k)) ** 2) / n), 6) AS heldout_rmse FROM o JOIN c ON c.h = o.g, t""")
def nested_heldout_tuning(spark, sf):
    d = candidates(spark, sf).withColumn("e", F.col("x_m") - 5 * F.col("y_m"))
    return rounded(FT.nested_holdout(d, "sequence_id", "e", [0.0, 10.0, 1000.0, 100000.0]).drop("raw_rmse"), "inner_rmse", "correction", "heldout_rmse")


# --- anchors at frame times, labels of another table, template snap, adaptive noise


@query(f"""WITH {MEASUREMENTS}, {BRACKET}, a AS (SELECT *, t0 = time_s AS exact, t1 - t0 AS gap, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / (t1 - t0) AS speed FROM br WHERE t0 = time_s OR (t0 IS NOT NULL AND t1 IS NOT NULL))
SELECT key, round(CASE WHEN exact THEN x0 ELSE x0 + (x1 - x0) * (time_s - t0) / (t1 - t0) END, 6) AS x_m, NOT exact AS interpolated, round(CASE WHEN exact THEN 5.0 ELSE sqrt(100 + (0.0001 * least(time_s - t0, t1 - time_s)) ** 2) END, 6) AS std_m
FROM a WHERE exact OR (gap <= 400000 AND speed <= 0.001)""")
def stable_segments_at_frames(spark, sf):
    a, b = _clicks(spark, sf)
    out = T.at_frames(a.select("sequence_id", "time_s", "key"), b, ["sequence_id"], ["x_m", "y_m"], 5.0, 400_000.0, 0.001, 2.0, 0.0001)
    return rounded(out.select("key", "x_m", "interpolated", "std_m"), "x_m", "std_m")


@query(f"""WITH {MEASUREMENTS}, {BRACKET} SELECT key, CASE WHEN abs(tm - time_s) <= 150000 THEN CASE WHEN xm > 50 THEN 'a' ELSE 'b' END END AS source_label, round(tm - time_s, 6) AS source_delta_s FROM near""")
def relabel_by_nearest_time(spark, sf):
    a, b = _clicks(spark, sf)
    label = F.when(F.col("x_m") > 50, "a").otherwise("b")
    out = E.relabelled(a.select("sequence_id", "time_s", "key"), b.withColumn("label", label), "by-nearest-time", 150_000.0)
    return rounded(out.select("key", "source_label", "source_delta_s"), "source_delta_s")


@query(f"""WITH {CANDIDATES}, l AS (SELECT sequence_id, time_s, max_by(candidate_branch, key) AS source_label FROM cand WHERE source = 'A' GROUP BY 1, 2) SELECT key, source_label FROM cand LEFT JOIN l USING (sequence_id, time_s) WHERE source <> 'A'""")
def relabel_by_key(spark, sf):
    c = candidates(spark, sf)
    out = E.relabelled(c.where("source <> 'A'").select("sequence_id", "time_s", "key"), c.where("source = 'A'").withColumn("label", F.col("candidate_branch")), "by-key")
    return out.select("key", "source_label")


@query(f"""WITH {CANDIDATES}, f AS (SELECT sequence_id, time_s, avg(x_m * x_m / 850 + y_m * y_m / 35) / 2 AS ratio FROM cand GROUP BY 1, 2) SELECT sequence_id, time_s, round(least(greatest(pow(greatest(ratio, 1e-12), 0.5), 0.25), 4.0), 6) AS noise_scale FROM f""")
def adaptive_noise_scale(spark, sf):
    nis = F.col("x_m") * F.col("x_m") / 850 + F.col("y_m") * F.col("y_m") / 35
    f = candidates(spark, sf).groupBy(*FRAME).agg((F.avg(nis) / 2).alias("ratio"))
    return f.select(*FRAME, r6(AS.adaptive_scale(F.col("ratio"))).alias("noise_scale"))


# --- point files: written, and read by blocks


@query(f"WITH {CANDIDATES} SELECT x_m, count(*) AS n, sum(y_m) AS y, sum(z_m) AS z FROM cand GROUP BY x_m")
def point_files_by_blocks(spark, sf):
    at = f"{shared_folder(spark)}/points_{uuid.uuid4().hex}"
    points_reader(spark)
    candidates(spark, sf).select("x_m", "y_m", "z_m").write.format("points").mode("append").save(at)
    d = spark.read.format("points").schema("x_m double, y_m double, z_m double").option("block", 1 << 17).load(at)
    return d.groupBy("x_m").agg(F.count(F.lit(1)).alias("n"), F.sum("y_m").alias("y"), F.sum("z_m").alias("z"))


# --- results on a template's times

SNAP = """tmpl AS (SELECT sequence_id, t::DOUBLE AS time_s FROM (SELECT sequence_id, unnest(range(CAST(floor(min(time_s) / 90) AS BIGINT), CAST(ceil(max(time_s) / 90) AS BIGINT) + 1)) * 90 AS t FROM traj GROUP BY 1)),
own AS MATERIALIZED (SELECT sequence_id, time_s, max_by(x_m, key) AS x FROM traj WHERE CAST(sequence_id AS BIGINT) % 3 <> 0 GROUP BY 1, 2),
pv AS (SELECT t.sequence_id, t.time_s, o.time_s AS t0, o.x AS x0 FROM tmpl t ASOF LEFT JOIN own o ON t.sequence_id = o.sequence_id AND t.time_s >= o.time_s), nx AS (SELECT t.sequence_id, t.time_s, o.time_s AS t1, o.x AS x1 FROM tmpl t ASOF LEFT JOIN own o ON t.sequence_id = o.sequence_id AND t.time_s < o.time_s),
lab AS (SELECT sequence_id, source AS label FROM (SELECT sequence_id, source, count(*) AS n FROM traj WHERE CAST(sequence_id AS BIGINT) % 3 <> 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY n DESC, source) = 1)"""


@query(f"""WITH {TRAJECTORIES}, {SNAP} SELECT sequence_id, time_s, label, round(CASE WHEN t0 = time_s THEN x0 WHEN t0 IS NULL AND t1 IS NULL THEN 0 WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL THEN x0 WHEN t1 - t0 > 200 THEN CASE WHEN time_s - t0 <= t1 - time_s THEN x0 ELSE x1 END ELSE x0 + (x1 - x0) * (time_s - t0) / (t1 - t0) END, 9) AS x_m,
CASE WHEN t0 = time_s THEN 'exact' WHEN t0 IS NULL AND t1 IS NULL THEN 'empty' WHEN t0 IS NULL OR t1 IS NULL THEN 'held' WHEN t1 - t0 > 200 THEN 'nearest' ELSE 'linear' END AS mode FROM pv JOIN nx USING (sequence_id, time_s) LEFT JOIN lab USING (sequence_id)""")
def template_snap(spark, sf):
    """Results of two thirds of the sequences on a template of all: the rest has no results."""
    t = trajectories(spark, sf)
    g = t.groupBy("sequence_id").agg(F.floor(F.min("time_s") / 90).alias("a"), F.ceil(F.max("time_s") / 90).alias("b"))
    grid = g.select("sequence_id", F.explode(F.sequence("a", "b")).alias("k")).select("sequence_id", (F.col("k") * 90).cast("double").alias("time_s"))
    results = t.where(F.col("sequence_id").cast("long") % 3 != 0).withColumn("label", F.col("source"))
    return rounded(R.snapped(results, grid, ["x_m"], 200.0).select("sequence_id", "time_s", "label", "x_m", "mode"), "x_m", n=9)


# --- centres of candidates around result rows


@query(f"""WITH {CANDIDATES}, f AS (SELECT sequence_id, time_s, avg(x_m) AS x, avg(y_m) AS y, avg(z_m) AS z FROM cand GROUP BY 1, 2),
n AS MATERIALIZED (SELECT f.sequence_id, f.time_s, c.score, c.x_m, c.y_m, c.z_m, sqrt((c.x_m - f.x) ** 2 + (c.y_m - f.y) ** 2 + (c.z_m - f.z) ** 2) AS d, row_number() OVER w AS rn, count(*) OVER (PARTITION BY f.sequence_id, f.time_s) AS n
  FROM f JOIN cand c ON c.sequence_id = f.sequence_id AND abs(c.time_s - f.time_s) <= 1 WINDOW w AS (PARTITION BY f.sequence_id, f.time_s ORDER BY c.score DESC, c.key)), k AS (SELECT * FROM n WHERE rn <= 20),
g AS (SELECT sequence_id, time_s, any_value(n) AS candidate_count, sum(score * x_m) FILTER (rn <= 5) / sum(score) FILTER (rn <= 5) AS w5, sum(score * y_m) FILTER (rn <= 5) / sum(score) FILTER (rn <= 5) AS v5, sum(score * z_m) FILTER (rn <= 5) / sum(score) FILTER (rn <= 5) AS u5,
  sum(score * x_m) FILTER (rn <= 10) / sum(score) FILTER (rn <= 10) AS w10, quantile_cont(x_m, 0.5) FILTER (rn <= 10) AS m10, arg_min(x_m, (d, rn)) AS nx, max(x_m) FILTER (rn = 1) AS t1, max(score) FILTER (rn = 1) - coalesce(max(score) FILTER (rn = 2), 0) AS margin FROM k GROUP BY 1, 2)
SELECT sequence_id, time_s, any_value(candidate_count) AS candidate_count, any_value(t1) AS top1_x_m, round(any_value(w5), 6) AS weighted5_x_m, round(any_value(w10), 6) AS weighted10_x_m, any_value(m10) AS median10_x_m, any_value(nx) AS nearest_x_m, round(any_value(margin), 4) AS top_score_margin,
  round(avg(sqrt((x_m - w5) ** 2 + (y_m - v5) ** 2 + (z_m - u5) ** 2)) FILTER (rn <= 5), 6) AS dispersion5 FROM k JOIN g USING (sequence_id, time_s) GROUP BY 1, 2""")
def candidate_centers(spark, sf):
    c = candidates(spark, sf)
    rows = c.groupBy(*FRAME).agg(*[F.avg(a).alias(a) for a in ("x_m", "y_m", "z_m")])
    out = R.center_statistics(rows, c, 1.0)
    names = ("weighted5_x_m", "weighted10_x_m", "dispersion5")
    return rounded(rounded(out.select(*FRAME, "candidate_count", "top1_x_m", *names, "median10_x_m", "nearest_x_m", "top_score_margin"), *names), "top_score_margin", n=4)


# --- speed gate and local fit

_ONE = "one AS (SELECT sequence_id, time_s, key, x_m FROM traj QUALIFY row_number() OVER (PARTITION BY sequence_id, time_s ORDER BY key DESC) = 1)"


@query(f"""WITH {TRAJECTORIES}, {_ONE}, nb AS (SELECT *, lag(time_s) OVER w AS t0, lag(x_m) OVER w AS x0, lead(time_s) OVER w AS t1, lead(x_m) OVER w AS x1 FROM one WINDOW w AS (PARTITION BY sequence_id ORDER BY time_s)),
o AS (SELECT *, coalesce(abs(x_m - x0) / (time_s - t0) > 1 AND abs(x1 - x_m) / (t1 - time_s) > 1 AND abs(x_m - x0 - (time_s - t0) / (t1 - t0) * (x1 - x0)) > 0.5 * least(time_s - t0, t1 - time_s), false) AS outlier FROM nb),
g AS (SELECT *, last_value(CASE WHEN NOT outlier THEN time_s END IGNORE NULLS) OVER b AS pt, last_value(CASE WHEN NOT outlier THEN x_m END IGNORE NULLS) OVER b AS px, first_value(CASE WHEN NOT outlier THEN time_s END IGNORE NULLS) OVER a AS qt, first_value(CASE WHEN NOT outlier THEN x_m END IGNORE NULLS) OVER a AS qx FROM o
  WINDOW b AS (PARTITION BY sequence_id ORDER BY time_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY sequence_id ORDER BY time_s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
r AS (SELECT *, coalesce(outlier AND qt - pt <= 300, false) AS replaced FROM g), v AS (SELECT sequence_id, time_s, key, outlier, replaced, CASE WHEN replaced THEN px + (time_s - pt) / (qt - pt) * (qx - px) ELSE x_m END AS x FROM r)
SELECT key, outlier, replaced, round(CASE WHEN count(*) OVER w >= 2 AND var_pop(time_s) OVER w > 0 THEN avg(x) OVER w + covar_pop(x, time_s) OVER w / var_pop(time_s) OVER w * (time_s - avg(time_s) OVER w) ELSE x END, 7) AS x_m
FROM v WINDOW w AS (PARTITION BY sequence_id ORDER BY time_s RANGE BETWEEN 120 PRECEDING AND 120 FOLLOWING)""")
def speed_gated_smoothing(spark, sf):
    d = R.speed_gated(_single(spark, sf).select("sequence_id", "time_s", "key", "x_m"), ["sequence_id"], 1.0, ["x_m"], max_gap=300.0)
    return R.locally_fitted(d, ["sequence_id"], 120, ["x_m"]).select("key", "outlier", "replaced", r6("x_m", 7).alias("x_m"))


# --- ensembles of one time, then the smoother

#: The same recursions for another noise: std 10, acceleration 5.
_ENSEMBLE = f"{cv_sql(None)}, {SMOOTH}".replace("625.0", "100.0").replace("0.25", "25.0")


@query(f"""WITH RECURSIVE {CANDIDATES}, traj AS (SELECT sequence_id, time_s, min(key) AS key, sum((1 + z_m) * x_m) / sum(1 + z_m) AS x_m FROM cand GROUP BY 1, 2), {_ENSEMBLE}
SELECT sequence_id, time_s, round(x, 5) AS state_x_m FROM sm""")
def rts_ensemble(spark, sf):
    c, w = candidates(spark, sf), 1 + F.col("z_m")
    mean = c.groupBy(*FRAME).agg((F.sum(w * F.col("x_m")) / F.sum(w)).alias("x_m"), F.min("key").alias("key"))
    return scan.cv_smooth(mean, ["x_m"], 10.0, 5.0, slices=16, least=1000).select(*FRAME, r6("state_x_m", 5).alias("state_x_m"))
