"""Association, mixture and model operators against brute force and plain recursions."""

import itertools
import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tracklume.operators import association as A
from tracklume.operators import evaluate as E
from tracklume.operators import joins as J
from tracklume.operators import kernels as K
from tracklume.operators import models as M
from tracklume.operators import normalize as N
from tracklume.operators import paths as P
from tracklume.operators import sequence as Q
from tracklume.plans.views import candidates


def frames_of(rng, sizes):
    times = np.cumsum(rng.integers(1, 3, len(sizes))).astype(float)
    return times, [rng.normal(size=(n, 3)) * 3 for n in sizes], [rng.random(n) * 3 for n in sizes]


def total(times, frames, scores, path, speed, miss):
    value, last = 0.0, None
    for f, j in enumerate(path):
        if j < 0:
            value -= miss
            continue
        value += scores[f][j]
        if last is not None:
            value += K._steps(frames[last[0]][last[1]][None], frames[f][j][None], times[f] - times[last[0]], speed)[0, 0]
        last = f, j
    return value


@pytest.mark.parametrize("seed", range(8))
def test_top_paths_are_exact(seed):
    rng = np.random.default_rng(seed)
    times, frames, scores = frames_of(rng, rng.integers(1, 4, 4))
    every = []
    for path in itertools.product(*[[*range(len(x)), -1] for x in frames]):
        run = max((len(list(g)) for j, g in itertools.groupby(path) if j == -1), default=0)
        if run <= 2:
            every.append((total(times, frames, scores, path, 2.0, 1.5), path))
    every.sort(key=lambda e: -e[0])
    got = P.top_paths(times, frames, scores, 2.0, 5, 1.5, 2)
    assert [v for v, _ in got] == pytest.approx([v for v, _ in every[:5]])
    assert all(v == pytest.approx(total(times, frames, scores, p, 2.0, 1.5)) for v, p in got)
    # with a lag over all frames the first choice is that of the best path
    assert P.fixed_lag_path(times, frames, scores, 2.0, 1e9, 1.5, 2)[0] == got[0][1][0]


@pytest.mark.parametrize("ties", [False, True])
def test_top_paths_of_many_sequences_are_those_of_each(ties, monkeypatch):
    rng = np.random.default_rng(3)
    seqs = [frames_of(rng, rng.integers(1, 5, rng.integers(1, 9))) for _ in range(60)]
    if ties:
        seqs = [(t, [np.round(x / 4) for x in f], [np.round(v) for v in s]) for t, f, s in seqs]
    t = np.concatenate([np.repeat(t, [len(x) for x in f]) for t, f, _ in seqs])
    x, v = (np.concatenate([y for q in seqs for y in q[i]]) for i in (1, 2))
    sizes = np.array([len(y) for q in seqs for y in q[1]])
    frames, first = np.cumsum(sizes) - sizes, np.cumsum([0] + [len(q[1]) for q in seqs])[:-1]
    for most, k, pairs in ((3, 2, 1 << 22), (1, 3, 500)):
        monkeypatch.setattr(K, "PAIRS", pairs)
        rows, number, value = P.top_paths_many(t, x, v, frames, first, 2.0, k, 1.5, most)
        want = set()
        for (a, f, s), at in zip(seqs, first):
            for n, (total_, path) in enumerate(P.top_paths(a, f, s, 2.0, k, 1.5, most), 1):
                want |= {(int(frames[at + i]) + j, n, total_) for i, j in enumerate(path) if j >= 0}
        assert set(zip(rows.tolist(), number.tolist(), value.tolist())) == want and len(rows) == len(want)


@pytest.mark.parametrize("seed", range(6))
def test_pair_posteriors_are_exact(seed):
    rng = np.random.default_rng(seed)
    times, frames, scores = frames_of(rng, rng.integers(1, 4, 4))
    weight = [np.zeros(len(x)) for x in frames]
    for path in itertools.product(*[range(len(x)) for x in frames]):
        log = total(times, frames, scores, path, 2.0, 0.0)
        x = [frames[f][j] for f, j in enumerate(path)]
        for i in range(1, 3):
            v1, v0 = (x[i + 1] - x[i]) / (times[i + 1] - times[i]), (x[i] - x[i - 1]) / (times[i] - times[i - 1])
            a = (v1 - v0) / ((times[i + 1] - times[i - 1]) / 2)
            log -= 0.5 * float(a @ a) / 3.0**2
        for f, j in enumerate(path):
            weight[f][j] += math.exp(log)
    got = P.pair_forward_backward(times, frames, scores, 2.0, 3.0)
    assert all(np.allclose(g, w / w.sum()) for g, w in zip(got, weight))


def test_beam_and_stitching():
    start, end = np.array([0.0, 5, 5, 12]), np.array([4.0, 9, 11, 15])
    head = tail = np.array([[0.0], [1], [100], [2]])
    score, rows = np.array([1.0, 2, 9, 4]), np.array([3.0, 4, 6, 2])
    best = P.beam_paths(start, end, head, tail, score, 1.0, 0.1, 2, 10)
    assert best[0][1] == [2] and best[1][1] == [0, 1, 3] and best[1][0] == pytest.approx(7 - 0.1 * (1 + 3))
    assert P.stitched(start, end, head, tail, rows, 1.0) == [0, 1, 3]
    assert P.stitched(start[:0], end[:0], head[:0], tail[:0], rows[:0], 1.0) == []


def test_association_modes_follow_the_target():
    times = np.arange(12.0)
    frames = [np.array([[t, 0.0, 0.0], [900.0, 9.0, 0.0], [t + 0.4, 0.2, 0.0]]) for t in times]
    scores = [np.array([0.9, 0.95 if t else 0.1, 0.2]) for t in times]
    gate = K.chi2_quantile(0.99, 3)
    nis, state, _ = P.associate(times, frames, scores, "nis", 1.0, 0.5, gate)
    assert set(nis.tolist()) <= {0, 2} and abs(state[-1][0] - 11) < 0.6
    assert (P.associate(times, frames, scores, "score", 1.0, 0.5, gate)[0][1:] == -1).all()  # the best score lies outside the gate
    assert P.associate(times, frames, scores, "score-nis", 1.0, 0.5, gate, weight=5.0)[0].tolist() == [0] * 12
    _, pda, _ = P.associate(times, frames, scores, "pda", 1.0, 0.5, gate)
    assert abs(pda[-1][0] - 11.15) < 0.5 and abs(pda[-1][1]) < 0.3
    names = [np.array(["a", "b", "a" if t % 2 else "c"]) for t in range(12)]
    assert P.associate(times, frames, scores, "continuity", 1.0, 0.5, gate, names)[0][0] == 0
    choice, _ = P.hypothesis_bank(times, frames, scores, 1.0, 0.5, gate)
    assert set(choice.tolist()) <= {0, 2}
    with pytest.raises(ValueError):
        P.associate(times, frames, scores, "other", 1.0, 0.5, gate)


def test_alternation_and_targets():
    times = np.arange(10.0)
    frames = [np.array([[2 * t, 0.0, 0.0], [80.0, 50.0, 0.0]]) for t in times]
    scores = [np.array([0.5, 1.0 if t == 4 else 0.1]) for t in times]
    choice, curve = P.alternate(times, frames, scores, 10.0, 5.0)
    assert choice.tolist() == [0] * 10 and np.allclose(curve[:, 0], 2 * times, atol=2)
    labels = P.born_and_aged(times, frames, 1.0, 2.0, 10.0)
    assert [x.tolist() for x in labels] == [[0, 1]] * 10
    late = P.born_and_aged(np.array([0.0, 1, 9]), frames[:3], 1.0, 2.0, 10.0, most_age_s=1.5)
    assert late[2].tolist() == [2, 3]
    assert all((x == -1).all() for x in P.born_and_aged(np.array([0.0]), frames[:1], 1.0, 2.0, 10.0, least_hits=2))


def test_mixture_solve():
    rng = np.random.default_rng(4)
    times = np.cumsum(rng.random(9) + 0.1)
    band = P._system(times, 3.0)
    d = np.zeros((7, 9))
    a, b = np.diff(times)[:-1], np.diff(times)[1:]
    for k in range(7):
        d[k, k : k + 3] = 2 / (a[k] * (a[k] + b[k])), -2 / (a[k] * b[k]), 2 / (b[k] * (a[k] + b[k]))
    full = np.eye(9) + 3.0 * d.T @ d
    rhs = rng.normal(size=(9, 3))
    one = band.copy()
    one[0] += 1
    assert np.allclose(P.banded_solve(one, rhs), np.linalg.solve(full, rhs))
    x = rng.normal(size=(20, 3))
    frame = np.sort(np.append(np.arange(9), rng.integers(0, 9, 11)))
    label = rng.integers(0, 2, 20)
    w = P.responsibilities(x, np.ones(20), np.zeros(20), frame, np.zeros((9, 3)), (label,), 1.0, floor=0.1)
    assert np.allclose(np.bincount(frame, w), 1) and (w > 0).all()
    straight = np.stack([times, times * 0, times * 0], 1)
    both = np.concatenate([straight, straight + [0, 60, 0]])
    order = np.argsort(np.tile(np.arange(9), 2), kind="stable")
    state, w, objective, _ = P.mixture_map(times, both[order], np.ones(18), np.tile([1.0, 0.0], 9), np.repeat(np.arange(9), 2), 10.0)
    assert np.allclose(state, straight, atol=0.01) and objective < 1e-3 and np.allclose(w[::2], 1, atol=1e-6)


def test_population():
    seeds = np.array([[0.0, 0, 10, 10], [50, 50, 10, 10]])
    boxes = [np.array([[51.0, 50, 10, 10], [200, 0, 5, 5], [1, 0, 10, 10]]), np.array([[2.0, 0, 10, 10]])]
    got = P.fixed_population(boxes, [np.array([7, 8, 9]), np.array([9])], seeds, np.array([1, 2]))
    assert [g.tolist() for g in got] == [[2, -1, 1], [1]]


def test_pairs_are_found_once(spark):
    c = candidates(spark, SMALL).limit(800).cache()
    for gridded in (("x_m",), ("x_m", "y_m"), ("x_m", "y_m", "z_m")):
        got = J.radius_pairs(c, ["sequence_id"], "key", 4.0, gridded).select("key", "key_r").collect()
        assert len({frozenset(r) for r in got}) == len(got)
        p = c.toPandas()
        want = 0
        for _, g in p.groupby("sequence_id"):
            x = g[["x_m", "y_m", "z_m"]].to_numpy()
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
            want += int(np.triu(d <= 4.0, 1).sum())
        assert len(got) == want


def test_streamed_sequences_cross_batches(spark):
    df = spark.range(3000).selectExpr("concat('s', id % 3) AS sequence_id", "cast(id AS double) AS time_s", "id AS key", "cast(id % 7 AS double) AS x_m")
    want = {r.key: r for r in Q.cv_track(df, ["x_m"], 1.0, 0.5).collect()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        got = {r.key: r for r in Q.cv_track(df, ["x_m"], 1.0, 0.5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 3000 and got == want
    assert Q.cv_track(df.limit(0), ["x_m"], 1.0, 0.5).count() == 0


def test_one_sided_keys(spark):
    a = spark.createDataFrame([("p", 1.0, "u", 0.0, 0.0, 0.0), ("q", 1.0, "u", 0.0, 0.0, 0.0)], "sequence_id string, time_s double, track string, x_m double, y_m double, z_m double")
    b = a.where("sequence_id = 'q'").unionByName(a.where("sequence_id = 'q'").withColumn("sequence_id", F.lit("r")))
    got = {r.sequence_id: r for r in Q.mot_scores(a, b, 1.0).collect()}
    assert (got["p"].misses, got["q"].matches, got["r"].false_alarms, got["q"].mota) == (1, 1, 1, 1.0) and got["r"].mota is None
    box = lambda d: d.selectExpr("sequence_id", "1L AS frame", "1L AS id", "x_m AS x", "y_m AS y", "5D AS w", "5D AS h")
    hota = {r.sequence_id: r for r in Q.hota_scores(box(a), box(b)).collect()}
    assert (hota["p"].fn, hota["q"].hota, hota["r"].fp) == (1, 1.0, 1)


def test_bootstrap_draws(spark):
    values = [float(i % 11) for i in range(95)] + [None]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    got = E.block_bootstrap(df, ["k"], ["i"], "v", 10, 300).first()
    blocks = [values[i : min(i + 10, 95)] for i in range(0, 95, 10)]
    draws = spark.range(1, 301).selectExpr("id AS r", "explode(sequence(1L, 10L)) AS s").selectExpr("r", "cast(floor(conv(substring(md5(concat_ws('|', '0', 'g', r, s)), 1, 8), 16, 10) / 4294967296D * 10) AS long) AS b").collect()
    by = {}
    for d in draws:
        by.setdefault(d.r, []).extend(blocks[d.b])
    means = [float(np.mean(v)) for v in by.values()]
    assert got.estimate == pytest.approx(np.mean(values[:95])) and got.n == 95
    assert got.lower == pytest.approx(np.percentile(means, 2.5)) and got.upper == pytest.approx(np.percentile(means, 97.5))


def test_tournament(spark):
    rows = [("base", str(i), 0.5, 0.9) for i in range(20)] + [("good", str(i), 0.6 + 0.001 * i, 0.9) for i in range(20)] + [("short", str(i), 0.9, 0.9) for i in range(5)] + [("rough", str(i), 0.7, 0.2) for i in range(20)]
    df = spark.createDataFrame(rows, "method string, sequence_id string, hota double, mota double")
    got = {r.method: r for r in E.guarded_tournament(df, "base", "hota", {"mota": 0.05}, 20).collect()}
    assert got["good"].accepted and got["good"].rank == 1
    assert got["short"].reasons == "incomplete" and got["rough"].reasons == "mota_guard" and "no_gain" in got["base"].reasons


def test_rigid_transform_and_ridge(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 3)) * 5
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    b = a @ q.T + [1.0, 2.0, 3.0]
    df = spark.createDataFrame([("s", *map(float, x), *map(float, y)) for x, y in zip(a, b)] + [("t", *map(float, a[0]), *map(float, b[0]))], "source string, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    got = {r.source: r for r in M.source_transforms(df, "source", "rigid", ["a0", "a1", "a2"], ["b0", "b1", "b2"]).collect()}
    assert np.allclose(np.array(got["s"].matrix).reshape(3, 3), q) and np.allclose(got["s"]["shift"], [1, 2, 3])
    assert np.allclose(np.array(got["t"].matrix).reshape(3, 3), np.eye(3)) and got["t"]["shift"] == [0, 0, 0]
    moved = M.transformed(df.where("source = 's'"), M.source_transforms(df, "source", "rigid", ["a0", "a1", "a2"], ["b0", "b1", "b2"]), "source", ["a0", "a1", "a2"]).toPandas()
    assert np.allclose(moved[["a0", "a1", "a2"]], moved[["b0", "b1", "b2"]])
    r = M.ridge(df.where("source = 's'"), ["source"], ["a0", "a1"], "b0", alpha=2.0).first()
    x = a[:, :2] - a[:, :2].mean(0)
    assert np.allclose(r.coefficients, np.linalg.solve(x.T @ x + 2 * np.eye(2), x.T @ (b[:, 0] - b[:, 0].mean())))


def test_models_learn(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=600) > 0).astype(float)
    df = spark.createDataFrame([(str(i % 3), float(i), str(i), float(a), float(b), float(c), abs(float(a)) * 4 + 1) for i, ((a, b), c) in enumerate(zip(x, y))], "sequence_id string, time_s double, key string, a double, b double, good double, err double")
    out = M.leave_one_out(df, ["a", "b"], "good", "sequence_id", ["0", "1", "2"]).toPandas()
    assert len(out) == 600 and ((out.model_score > 0.5) == (out.good == 1)).mean() > 0.85
    platt = M.scored(M.fit_platt(df.withColumn("p", 1 / (1 + F.exp(-3 * F.col("a")))), "p", "good"), df.withColumn("p", 1 / (1 + F.exp(-3 * F.col("a")))), ["p"]).toPandas()
    assert abs(platt.model_score.mean() - y.mean()) < 0.02
    sigma = M.predicted_sigma(M.fit_uncertainty(df.withColumn("c", F.abs("a")), ["c"], "err", l2=0.0), df.withColumn("c", F.abs("a")), ["c"]).toPandas()
    assert np.corrcoef(sigma.predicted_sigma_m, sigma.err)[0, 1] > 0.9 and sigma.predicted_sigma_m.between(1, 30).all()


def test_perturbation_is_the_same_on_any_partitioning(spark):
    c = candidates(spark, SMALL).select("key", "time_s", "x_m", "y_m", "z_m")
    a, b = (sorted(map(tuple, N.perturbed(c.repartition(n), ["key"], ["x_m"], 3, 0.2, 2.0, 0.5, 0.1).collect())) for n in (1, 5))
    assert a == b and 0.7 < sum(not r[-1] for r in a) / c.count() < 0.9


def test_normalising_edges(spark):
    with pytest.raises(ValueError):
        N.normalize_truth(spark.createDataFrame([("a", 1.0)], "seq string, x double"))
    with pytest.raises(ValueError):
        N.select_radar(spark.createDataFrame([], "x int"), "other")
    rows = spark.createDataFrame([(1.0, 1), (None, 2)], "range_m double, i int")
    assert N.within_range(rows, 2.0).count() == 1 and N.within_range(rows, 2.0, False).count() == 2
    with pytest.raises(Exception, match="range_m is needed"):
        N.require_range(rows).collect()
    twice = spark.createDataFrame([("a", "x"), ("a", "y")], "sequence_id string, split string")
    with pytest.raises(Exception, match="more than one split"):
        N.split_manifest(twice).collect()
    assert A.adaptive_scale(F.lit(4.0)) is not None


def test_assigned_support_is_one_to_one(spark):
    rows = [("s", 0.0, "a", 0.0), ("s", 0.0, "b", 1.0), ("s", 1.0, "c", 0.9), ("s", 1.0, "d", 5.0), ("s", 9.0, "e", 1.0), ("t", 1.0, "f", 0.0)]
    df = spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], "sequence_id string, time_s double, key string, x_m double, y_m double, z_m double")
    got = {r.key: (r.backward_m, r.forward_m) for r in Q.assigned_support(df, 2.0, 4.5).collect()}
    # both could take c; most pairs comes first
    assert got["a"][1] == pytest.approx(0.9) and got["b"][1] == pytest.approx(4.0) and got["c"][0] == pytest.approx(0.9) and got["d"][0] == pytest.approx(4.0)
    assert got["e"] == (None, None) and got["f"] == (None, None)


def test_population_in_sequences(spark):
    box = "sequence_id string, frame long, id long, x double, y double, w double, h double"
    p = spark.createDataFrame([("s", 1, 7, 0.0, 0.0, 10.0, 10.0), ("s", 1, 8, 90.0, 0.0, 10.0, 10.0), ("s", 4, 7, 3.0, 0.0, 10.0, 10.0), ("s", 9, 7, 8.0, 0.0, 10.0, 10.0)], box)
    seeds = spark.createDataFrame([("s", 1, 100, 1.0, 0.0, 10.0, 10.0), ("u", 1, 5, 0.0, 0.0, 1.0, 1.0)], box)
    got = sorted((r.frame, r.id, r.x, r.filled) for r in Q.fixed_population(p, seeds, 0.5, 2).collect())
    assert got == [(1, 100, 0.0, False), (2, 100, 1.0, True), (3, 100, 2.0, True), (4, 100, 3.0, False), (9, 100, 8.0, False)]


def test_lagged_smoothing_sees_no_further():
    t = np.arange(20.0)
    x = np.random.default_rng(1).normal(size=(20, 2))
    whole = K.lagged(t, x, 5.0, np.inf, 100.0)
    assert np.allclose(whole, K.regularized(t, x, 5.0))
    y = x.copy()
    y[15:] += 50
    assert np.allclose(K.lagged(t, x, 5.0, np.inf, 3.0)[:12], K.lagged(t, y, 5.0, np.inf, 3.0)[:12])


def test_mixtures_of_many_sequences_are_those_of_each():
    rng = np.random.default_rng(5)
    seqs = []
    for n in rng.integers(1, 9, 30):
        f = np.sort(np.append(np.arange(n), rng.integers(0, n, 2 * n)))
        seqs.append((np.cumsum(rng.random(n) + 0.1), rng.normal(size=(3 * n, 3)) * 5, 1 + rng.random(3 * n), rng.random(3 * n), f, rng.integers(0, 2, 3 * n)))
    first = np.cumsum([0] + [len(q[0]) for q in seqs])
    t, x, sigma, score, label = (np.concatenate([q[i] for q in seqs]) for i in (0, 1, 2, 3, 5))
    frame = np.concatenate([q[4] + a for q, a in zip(seqs, first)])
    state, w, objective, done = P.mixture_map_many(t, first[:-1], x, sigma, score, frame, 20.0, labels=(label,), balance=0.2)
    each = [P.mixture_map(*q[:5], 20.0, labels=(q[5],), balance=0.2) for q in seqs]
    assert np.allclose(state, np.concatenate([e[0] for e in each])) and np.allclose(w, np.concatenate([e[1] for e in each]))
    assert np.allclose(objective, [e[2] for e in each]) and done.tolist() == [e[3] for e in each] and len(set(done)) > 1


def test_restarts_shuffle_the_rows_once(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"s{k % 5}", float(k // 10), f"k{k}", *rng.normal(size=3).tolist(), 1.0, float(rng.random())) for k in range(100)], "sequence_id string, time_s double, key string, x_m double, y_m double, z_m double, sigma_m double, score double")
    starts = {"a": F.col("score"), "b": -F.col("score") * 5}
    out = A.mixture_restarts(df, 5.0, starts)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    runs = {n: {(r.sequence_id, r.time_s): r for r in A.mixture_map(df.withColumn("score", c), 5.0).collect()} for n, c in starts.items()}
    got = out.collect()
    assert len(got) == len(runs["a"])
    for r in got:
        a, b = (runs[n][r.sequence_id, r.time_s] for n in "ab")
        best = a if a.objective <= b.objective else b
        assert r.restart == ("a" if best is a else "b") and (r.key, round(r.state_x_m, 9)) == (best.key, round(best.state_x_m, 9))


def test_rows_are_matched_as_in_each_frame():
    rng = np.random.default_rng(8)
    frame = np.sort(rng.integers(0, 60, 400))
    x, side = np.round(rng.random((400, 3)) * 4), rng.integers(0, 2, 400)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    got = set(zip(*[v.tolist() for v in K.matched_rows(a, b, frame, x, 1.5)]))
    want = set()
    for f in range(60):
        i, j = a[frame[a] == f], b[frame[b] == f]
        want |= {(int(i[p]), int(j[q]), d) for p, q, d in K.matched_frames([x[i]], [x[j]], 1.5)[0]}
    assert got == want and len(got) > 40
    none = np.zeros(0, int)
    assert all(not len(v) for v in K.matched_rows(none, b, frame, x, 1.5)) and all(not len(v) for v in K.matched_rows(a, none, frame, x, 1.5))
