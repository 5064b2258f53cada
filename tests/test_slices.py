"""Keys that span many tasks: as-of joins by time slices, filter and smoother by scans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklume.operators import banded, joins, kernels, scan, slices


def test_slices_bound_a_hot_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), (F.hash("id") % 5000).cast("double").alias("time_s"))
    out = slices.sliced(rows, ["k"], slices=16, least=100)
    sizes = out.groupBy("k", "_slice").count().toPandas()
    assert sizes["count"].max() < 2 * 20_000 / 16 and (sizes[sizes.k != "hot"]["_slice"] == 0).all()
    assert sizes[sizes.k == "hot"]["_slice"].nunique() == 16
    spans = out.where("k = 'hot'").groupBy("_slice").agg(F.min("time_s").alias("a"), F.max("time_s").alias("b")).orderBy("_slice").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))


def test_slices_spread_a_common_time(spark):
    rows = spark.range(9000).select(F.lit("k").alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("time_s"))
    out = slices.sliced(rows, ["k"], slices=30, least=10, spread=F.lit(True))
    assert out.groupBy("_slice").count().agg(F.max("count")).first()[0] < 600


@pytest.mark.parametrize("n", [1, 7])
def test_sliced_brackets_equal_plain_ones(spark, n):
    rnd = random.Random(n)
    time = lambda: rnd.choice([None, float("nan"), 5.0, 5.0, 5.0, *[round(rnd.uniform(0, 40), 1) for _ in range(20)]])
    left = [(rnd.choice([None, "a", "a", "a", "b"]), time(), k) for k in range(600)]
    right = [(rnd.choice([None, "a", "a", "b", "c"]), time(), k, rnd.random()) for k in range(150)]
    a = spark.createDataFrame(left, "s string, time_s double, i long").repartition(3)
    b = spark.createDataFrame(right, "s string, time_s double, key long, x double").repartition(2)
    of = lambda **how: sorted(map(repr, joins.brackets(a, b, ["s"], payload=["x", "key"], order="key", **how).collect()))
    assert of() == of(slices=8, least=5)
    near = lambda **how: sorted(map(repr, joins.asof_nearest(a, b, ["s"], payload=["x", "key"], order="key", tolerance=0.4, **how).collect()))
    assert near() == near(slices=8, least=5)


def walk(n_sequences, n, seed, gap=0.0):
    rnd, rows = random.Random(seed), []
    for s in range(n_sequences):
        t = x = y = 0.0
        for k in range(n if s else 6 * n):
            t += 0.0 if rnd.random() < 0.05 else rnd.uniform(0.1, 2.0)
            x, y = x + rnd.gauss(0, 1), y + rnd.gauss(0.5, 1)
            rows.append((f"s{s}", t, s * 100_000 + k, x, y))
    return rows


def states(rows, smooth):
    out = {}
    for s in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == s)
        t, z = np.array([r[1] for r in own]), np.array([r[3:] for r in own])
        got = kernels.cv_filter(t, z, np.full(len(t), 2.0), 0.7)
        mean = kernels.rts(t, got["mean"], got["cov"], 0.7) if smooth else got["mean"]
        out |= {r[2]: (*m[:2], *([] if smooth else [n])) for r, m, n in zip(own, mean, got["nis"])}
    return out


@pytest.mark.parametrize("cut", [2, 9, 40])
def test_scans_equal_the_recursion(spark, cut):
    rows = walk(4, 60, cut)
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "sequence_id string, time_s double, key long, x_m double, y_m double").repartition(3)
    rate = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # elements are carried over batches
    try:
        got = scan.cv_filter(df, ["x_m", "y_m"], 2.0, 0.7, slices=cut, least=10).collect()
        smooth = scan.cv_smooth(df, ["x_m", "y_m"], 2.0, 0.7, slices=cut, least=10).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rate)
    want, soft = states(rows, False), states(rows, True)
    assert len(got) == len(smooth) == len(rows)
    for r in got:
        assert all(math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7) for a, b in zip((r.state_x_m, r.state_y_m, r.nis), want[r.key]))
    for r in smooth:
        assert all(math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-5) for a, b in zip((r.state_x_m, r.state_y_m), soft[r.key]))


def test_scan_edges(spark):
    df = spark.createDataFrame([(None, 1.0, 1, 2.0), (None, 2.0, 2, 3.0), ("a", None, 3, 1.0), ("a", 1.0, 4, None), ("a", 1.0, 5, float("nan")), ("b", 1.0, 6, 4.0)], "sequence_id string, time_s double, key long, x_m double")
    got = {r.key: r for r in scan.cv_smooth(df, ["x_m"], 1.0, 1.0, slices=4, least=0).collect()}
    assert set(got) == {1, 2, 6} and got[6].state_x_m == 4.0
    assert scan.cv_filter(df.limit(0), ["x_m"], 1.0, 1.0).count() == 0


@pytest.mark.parametrize("cut,huber", [(12, None), (7, 1.5)])
def test_elimination_equals_the_dense_solution(spark, cut, huber):
    rows, seen = [], set()
    for r in walk(4, 45, cut + 50):
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            rows.append(r)
    rows += [("one", 3.0, 9_000_000, 1.0, 2.0), ("two", 3.0, 9_000_001, 1.0, 2.0), ("two", 4.0, 9_000_002, 5.0, 2.0), (None, 1.0, 9_000_003, 1.0, 1.0), ("two", None, 9_000_004, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sequence_id string, time_s double, key long, x_m double, y_m double").repartition(3)
    got = {r.key: (r.x_m, r.y_m) for r in banded.smoothed(df, ["x_m", "y_m"], 3.0, huber=huber, rounds=2, slices=cut, least=10).collect()}
    assert len(got) == len(rows) - 1
    for s in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == s and r[1] is not None)
        want = kernels.regularized(np.array([r[1] for r in own]), np.array([r[3:] for r in own]), 3.0, np.inf if huber is None else huber, rounds=2)
        for r, x in zip(own, want):
            assert np.allclose(got[r[2]], x, rtol=1e-6, atol=1e-6), (s, r, got[r[2]], x)


def _frames_to_the_end(df):
    return "currentrow$(), unboundedfollowing$()" in df._jdf.queryExecution().optimizedPlan().toString()


def test_interpolation_has_no_window_worked_out_anew_for_every_row(spark):
    a = spark.createDataFrame([("p", float(k), k) for k in range(40)], "sequence_id string, time_s double, key long")
    b = a.selectExpr("sequence_id", "time_s + 0.25 AS time_s", "time_s AS x_m")
    d = joins.interpolated(a, b, ["sequence_id"], ["x_m"], slices=4, least=10)
    assert not _frames_to_the_end(d)
    assert {r.key: r.x_m_at for r in d.collect()} == {0: None, **{k: k - 0.25 for k in range(1, 40)}}


def test_nearest_match_has_no_window_worked_out_anew_for_every_row(spark):
    a = spark.createDataFrame([("p", float(k), k) for k in range(40)], "sequence_id string, time_s double, key long")
    b = a.where("key % 3 = 0").selectExpr("sequence_id", "time_s", "key AS other")
    d = joins.asof_nearest(a, b, ["sequence_id"], payload=["other"], slices=4, least=10)
    assert not _frames_to_the_end(d)
    assert {r.key: r.match.other for r in d.collect()} == {k: min(39, k + (0, -1, 1)[k % 3]) for k in range(40)}


def test_bootstrap_numbers_a_hot_key_in_slices(spark):
    from tracklume.operators import evaluate

    rows = spark.range(3000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("k"), (F.hash("id") % 90).cast("double").alias("time_s"), "id", (F.hash("id") % 11).cast("double").alias("x"))
    cut, whole = (evaluate.block_bootstrap(rows, ["k"], ["time_s", "id"], "x", 7, 20, slices=n, least=10) for n in (16, None))
    fixed = lambda d: sorted((r.k, r.n, r.blocks, round(r.estimate, 9), round(r.lower, 9), round(r.upper, 9)) for r in d.collect())
    assert fixed(cut) == fixed(whole)
    assert "_slice" in cut._jdf.queryExecution().optimizedPlan().toString()
