"""Fits from aggregates, nested hold-outs, anchors at frames, labels and times across edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklume.operators import evaluate, fits, trajectories


def test_temperature_is_the_minimum(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(400):
        z = [rnd.gauss(0, 2) for _ in range(3)]
        p = [math.exp(v) / sum(map(math.exp, z)) for v in z]
        soft = [v**0.4 for v in p]
        rows.append((p, rnd.choices(range(3), soft)[0]))
    df = spark.createDataFrame([*rows, (None, 1), ([0.5, None, 0.5], 0), ([0.2, 0.8, 0.0], 7)], "p array<double>, y int").repartition(3)
    got = fits.temperature(df, "p", F.col("y"))

    def nll(t):
        return sum(-math.log(p[y] ** (1 / t) / sum(v ** (1 / t) for v in p)) for p, y in rows) / len(rows)

    assert got["n"] == 400 and 1.5 < got["temperature"] < 4 and abs(got["nll"] - nll(got["temperature"])) < 1e-9
    assert all(nll(got["temperature"]) <= nll(got["temperature"] * (1 + d)) for d in (-1e-3, 1e-3))
    sure = spark.createDataFrame([([0.9, 0.1], 0)] * 5, "p array<double>, y int")
    assert fits.temperature(sure, "p", F.col("y"))["temperature"] == pytest.approx(0.05)  # no minimum: the bound
    assert fits.temperature(sure.limit(0), "p", F.col("y"))["n"] == 0


def test_logistic_and_ridge(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0), (float("nan"), 0.0, 0.0)], "a double, b double, y double")
    for l2 in (0.0, 5.0):
        m = fits.logistic(df, ["a", "b"], "y", l2)
        beta = np.r_[m["intercept"], m["coefficients"]]
        full = np.c_[np.ones(500), x]
        slope = full.T @ (1 / (1 + np.exp(-full @ beta)) - y) + l2 * np.r_[0, beta[1:]]
        assert m["n"] == 500 and np.abs(slope).max() < 1e-6
    scored = df.where("a = a AND a IS NOT NULL").select(fits.logistic_score(m, ["a", "b"]).alias("p")).toPandas().p
    assert np.allclose(scored.dropna().to_numpy()[:500], 1 / (1 + np.exp(-full @ beta)))
    t = 3 + x @ [2.0, 0.5]
    frame = spark.createDataFrame([(*map(float, r), 1.0, float(v)) for r, v in zip(x, t)], "a double, b double, c double, t double")
    m = fits.ridge(frame, ["a", "b", "c"], F.col("t"), 1.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (t - t.mean()))
    assert np.allclose(m["weights"][:2], want) and m["weights"][2] == 0 and m["bias"] == pytest.approx(t.mean())
    sigma = fits.candidate_sigma(frame, ["a"], "t", least=1.0, most=5.0).agg(F.min("predicted_sigma_m"), F.max("predicted_sigma_m")).first()
    assert sigma[0] >= 1 and sigma[1] <= 5


def test_nested_holdout(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.gauss(m, 2)) for g, m in (("a", 3), ("b", 4), ("c", -1), ("d", 2)) for _ in range(rnd.randint(3, 9))] + [("a", None), ("b", float("nan"))]
    strengths = [0.0, 5.0, 100.0]
    got = {r.g: r for r in fits.nested_holdout(spark.createDataFrame(rows, "g string, e double").repartition(3), "g", "e", strengths).collect()}
    by = {g: [e for k, e in rows if k == g and e is not None and e == e] for g in "abcd"}

    def rmse(v, b):
        return math.sqrt(sum((e - b) ** 2 for e in v) / len(v))

    def fit(out, s):
        rest = [e for g, v in by.items() if g not in out for e in v]
        return sum(rest) / (len(rest) + s)

    for h in by:
        inner = {s: sum(rmse(by[v], fit({h, v}, s)) for v in by if v != h) / 3 for s in strengths}
        best = min(inner, key=lambda s: (inner[s], s))
        assert (got[h].strength, round(got[h].inner_rmse, 9), round(got[h].heldout_rmse, 9)) == (best, round(inner[best], 9), round(rmse(by[h], fit({h}, best)), 9))


def test_anchors_at_frames(spark):
    frames = spark.createDataFrame([("s", t, k) for k, t in enumerate([-1.0, 0.0, 1.0, 2.5, 3.0, 11.0, 20.5, 30.0])] + [("t", 1.0, 90), ("u", 1.0, 91)], "sequence_id string, time_s double, key long")
    anchors = spark.createDataFrame([("s", 0.0, 1, 0.0), ("s", 2.0, 2, 4.0), ("s", 3.0, 3, 50.0), ("s", 20.0, 4, 51.0), ("s", 21.0, 5, 52.0), ("s", 21.0, 6, 53.0), ("t", 1.0, 7, 9.0)], "sequence_id string, time_s double, key long, x_m double")
    got = {r.key: r for r in trajectories.at_frames(frames, anchors, ["sequence_id"], ["x_m"], 3.0, max_gap=5.0, max_speed=10.0, std_scale=2.0, gap_std=1.0).collect()}
    assert {k: (r.x_m, r.interpolated) for k, r in got.items()} == {1: (0.0, False), 2: (2.0, True), 4: (50.0, False), 6: (52.0, True), 90: (9.0, False)}
    assert got[1].std_m == 3.0 and got[2].std_m == pytest.approx(math.sqrt(36 + 1)) and got[2].gap_s == 2.0


def test_relabelled(spark):
    a = spark.createDataFrame([("s", 1.0, 1, "x"), ("s", 2.4, 2, "x"), ("t", 1.0, 3, "x")], "sequence_id string, time_s double, key long, label string")
    b = spark.createDataFrame([("s", 1.0, 1, "p"), ("s", 1.0, 2, "q"), ("s", 2.0, 3, "q"), ("s", 9.0, 4, None)], "sequence_id string, time_s double, key long, label string")
    of = lambda *how: {r.key: r.source_label for r in evaluate.relabelled(a, b, *how).collect()}
    assert of("by-key") == {1: "q", 2: None, 3: None}
    assert of("by-nearest-time") == {1: "q", 2: "q", 3: None} and of("by-nearest-time", 0.3) == {1: "q", 2: None, 3: None}
    assert of("by-sequence-majority") == {1: "q", 2: "q", 3: None}
    with pytest.raises(ValueError):
        of("by-guess")


def test_times_align_across_any_edge(spark):
    frame = lambda r: spark.createDataFrame([(s, t, k, "a", 0.0, 0.0, 0.0) for s, t, k in r], "sequence_id string, time_s double, key long, label string, x_m double, y_m double, z_m double")
    truth = [("s", 0.149, 1), ("s", 5.0, 2), ("s", 7.0, 3)]
    found = [("s", 0.151, 1), ("s", 5.04, 2), ("s", 5.05, 3), ("s", 9.0, 4), ("u", 1.0, 5)]
    got = sorted((r.reason or "", r.key) for r in evaluate.aligned_matches(frame(found), frame(truth), 0.1).collect())
    assert got == [("", 1), ("", 2), ("duplicate_prediction", 3), ("extra_prediction", 4), ("extra_prediction", 5), ("missing_prediction", 3)]


def test_time_order_is_checked_or_said_not_to_be(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.5), ("b", 1, 0.1)], "k string, i int, time_s double")
    by = lambda **how: {r.check: (r.value, r.ok) for r in evaluate.artifact_checks(df, ["time_s"], ["k"], **how).collect()}
    assert by()["time_order"] == (None, None) and by(ordinal="i")["time_order"] == (1.0, False) and by()["missing:time_s"] == (0.0, True)


def test_speed_gate_and_local_fit(spark):
    from tracklume.operators import repair

    xs = [0.0, 1.0, 50.0, 3.0, 4.0, 90.0, 95.0, 7.0, 8.0]
    rows = [("s", float(k), k, x, 2.0) for k, x in enumerate(xs)] + [("t", 0.0, 100, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sequence_id string, time_s double, key long, x_m double, y_m double")
    got = {r.key: (r.outlier, r.replaced, r.x_m) for r in repair.speed_gated(df, ["sequence_id"], 5.0, ["x_m", "y_m"], max_gap=2.0).collect()}
    assert got[2] == (True, True, 2.0) and got[3] == (False, False, 3.0) and got[100] == (False, False, 1.0)
    # a pair of wild rows: neither is fast to the other side alone, so the test sees none; wider gates see them
    assert [got[k][0] for k in range(9)] == [False, False, True, False, False, False, False, False, False]
    fit = {r.key: r.x_m for r in repair.locally_fitted(df.where("key < 2 OR key = 100"), ["sequence_id"], 1, ["x_m"]).collect()}
    assert fit[0] == pytest.approx(0.0) and fit[1] == pytest.approx(1.0) and fit[100] == 1.0


def test_center_statistics(spark):
    from tracklume.operators import repair

    rng = np.random.default_rng(5)
    c = [("s", float(t), k, float(w), *map(float, rng.normal(size=3) * 5)) for k, (t, w) in enumerate(zip(rng.integers(0, 3, 60), rng.random(60)))] + [("s", 0.0, 900, None, 0.0, 0.0, 0.0), ("s", 0.0, 901, 5.0, None, 0.0, 0.0)]
    rows = [("s", 0.0, 0.0, 0.0, 0.0), ("s", 9.0, 1.0, 1.0, 1.0)]
    got = {r.time_s: r for r in repair.center_statistics(spark.createDataFrame(rows, "sequence_id string, time_s double, x_m double, y_m double, z_m double"), spark.createDataFrame(c, "sequence_id string, time_s double, key long, score double, x_m double, y_m double, z_m double"), 0.5).collect()}
    own = sorted(((-(r[3] or 0.0), r[2], r[4:]) for r in c if r[1] == 0.0 and r[4] is not None))
    w, x = np.array([-o[0] for o in own][:20]), np.array([o[2] for o in own][:20])
    g = got[0.0]
    assert g.candidate_count == len(own) and got[9.0].candidate_count is None
    five = (w[:5, None] * x[:5]).sum(0) / w[:5].sum()
    assert np.allclose([g.weighted5_x_m, g.weighted5_y_m, g.weighted5_z_m], five) and np.isclose(g.median10_y_m, np.median(x[:10, 1]))
    assert np.isclose(g.weighted10_z_m, (w[:10] * x[:10, 2]).sum() / w[:10].sum()) and np.isclose(g.dispersion5, np.linalg.norm(x[:5] - five, axis=1).mean())
    near = x[np.linalg.norm(x, axis=1).argmin()]
    assert np.allclose([g.nearest_x_m, g.nearest_y_m, g.nearest_z_m], near) and np.isclose(g.top_score_margin, w[0] - w[1])


def test_nested_holdout_deals_the_pairs_of_groups(spark):
    from tracklume.operators import fits

    df = spark.range(400).selectExpr("CAST(id % 40 AS string) AS g", "CAST(id % 7 AS double) AS e")
    plan = fits.nested_holdout(df, "g", "e", [0.0, 10.0])._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
