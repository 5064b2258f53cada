"""Sketches, greedy spread and pooled tracking scores against brute force and known answers."""

import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tracklume.operators import sketches, spread, tracking_scores


def test_sketch_error_bound(spark):
    rnd = random.Random(1)
    values = [rnd.choice([-1, 1]) * math.exp(rnd.uniform(-20, 20)) for _ in range(3000)] + [0.0] * 50
    rows = [("a" if k % 3 else "b", v) for k, v in enumerate(values)] + [("a", None), ("a", float("nan")), ("b", float("inf")), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for accuracy in (0.05, 0.01):
        parts = [sketches.sketch(df.where(F.pmod(F.hash("v"), F.lit(3)) == k), ["g"], "v", accuracy) for k in range(3)]
        whole = sketches.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"])
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sketches.sketch(df, ["g"], "v", accuracy).collect()))  # merging loses nothing
        qs = {f"q{k}": sketches.rank_of(k / 20) for k in range(1, 20)}
        got = {r.g: r for r in sketches.at_ranks(whole, ["g"], qs, accuracy).collect()}
        for g in "ab":
            own = sorted(v for k, v in rows if k == g and v is not None and math.isfinite(v))
            assert got[g].n == len(own)
            for k in range(1, 20):
                want = own[max(1, math.ceil(k / 20 * len(own))) - 1]
                assert abs(got[g][f"q{k}"] - want) <= accuracy * abs(want) * (1 + 1e-9)
    assert whole.groupBy("g").count().agg(F.max("count")).first()[0] < 2 * 40 / math.log(sketches.gamma_of(0.01)) + 2


def test_conformal_radius_covers(spark):
    rnd = random.Random(2)
    own = sorted(rnd.expovariate(1) for _ in range(500))
    r = sketches.conformal_radius(spark.createDataFrame([("a", v) for v in own], "g string, v double"), ["g"], "v", 0.1).first()
    exact = own[math.ceil(501 * 0.9) - 1]
    assert (r.n, r.k) == (500, math.ceil(501 * 0.9)) and exact <= r.radius <= exact * sketches.gamma_of(0.01) * (1 + 1e-9)


def simple_cap(frame, most, weight, scale, cap):
    """(key, reason) in order, by the definition."""
    order = sorted(frame, key=lambda r: (-r["score"], r["key"]))
    best = lambda c: {next(r["key"] for r in order if r[c] == v) for v in {r[c] for r in frame}}
    kept = best("source") | best("candidate_branch")
    low, high = min(r["score"] for r in frame), max(r["score"] for r in frame)
    norm = lambda r: (r["score"] - low) / (high - low) if high > low else 0.0
    dist = lambda a, b: math.dist(*[[x[c] for c in ("x_m", "y_m", "z_m")] for x in (a, b)])
    prot = [r for r in order if r["key"] in kept]
    full = len(prot) >= most
    got, left = ([], prot) if full else (list(prot), [r for r in order if r["key"] not in kept])
    out = [(r["key"], "protected") for r in got]
    while left and len(got) < most:
        d = {r["key"]: min([dist(r, c) for c in got], default=math.inf) for r in left}
        pick = min(left, key=lambda r: (-(norm(r) + weight * (1 - math.exp(-min(d[r["key"]], cap) / scale))), -r["score"], r["key"]))
        got.append(pick)
        left.remove(pick)
        out.append((pick["key"], "protected_cap" if full else "spatial_fill"))
    return out


@pytest.mark.parametrize("most", [2, 5, 50])
def test_spatial_cap(spark, most):
    rnd = random.Random(most)
    names = ["sequence_id", "time_s", "source", "candidate_branch", "key", "x_m", "y_m", "z_m", "score"]
    rows = [dict(zip(names, (rnd.choice("st"), float(rnd.randint(0, 4)), rnd.choice("AB"), rnd.choice("pqr"), k, *(rnd.uniform(0, 60) for _ in range(3)), float(rnd.randint(0, 6))))) for k in range(160)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows] + [("s", 0.0, "C", "z", 999, None, 0.0, 0.0, 9.0)], "sequence_id string, time_s double, source string, candidate_branch string, key long, x_m double, y_m double, z_m double, score double")
    got = {}
    for r in spread.spatial_cap(df, most, weight=0.8, scale=9.0, cap=40.0).orderBy("rank").collect():
        got.setdefault((r.sequence_id, r.time_s), []).append((r.key, r.reason))
    frames = {}
    for r in rows:
        frames.setdefault((r["sequence_id"], r["time_s"]), []).append(r)
    assert got == {k: simple_cap(f, most, 0.8, 9.0, 40.0) for k, f in frames.items()}
    assert spread.spatial_cap(df.limit(0), most).count() == 0


@pytest.mark.parametrize("mode", ["max", "logmeanexp"])
def test_group_mass(spark, mode):
    rows = [("s", 0.0, g, k, float(10 * ord(g) + k), 0.0, 0.0, s) for k, (g, s) in enumerate([("a", 3.0), ("a", 1.0), ("b", 2.9), ("c", 0.0), ("a", 2.0), ("d", -9.0)])]
    df = spark.createDataFrame(rows, "sequence_id string, time_s double, g string, key long, x_m double, y_m double, z_m double, score double")
    got = spread.group_mass_topk(df, "g", 0.9, 1, 3, 2, mode=mode, weight=0.0, blend=0.0).collect()
    score = {g: max(r[-1] for r in rows if r[2] == g) if mode == "max" else math.log(sum(math.exp(r[-1]) for r in rows if r[2] == g) / sum(r[2] == g for r in rows)) for g in "abcd"}
    p = {g: math.exp(s) / sum(map(math.exp, score.values())) for g, s in score.items()}
    order = sorted(score, key=lambda g: -score[g])
    need = next(k + 1 for k in range(4) if sum(p[g] for g in order[: k + 1]) >= 0.9)
    assert {r.g: r.group_rank for r in got} == {g: k + 1 for k, g in enumerate(order[:need])}
    assert {r.budget for r in got} == {need} and all(abs(r.retained_mass - sum(p[g] for g in order[:need])) < 1e-9 for r in got)
    assert {r.key for r in got if r.g == "a"} == {0, 4}


def boxes(spark, rows):
    return spark.createDataFrame([(s, f, i, float(x), 0.0, 10.0, 10.0) for s, f, i, x in rows], "sequence_id string, frame long, id long, x double, y double, w double, h double")


def scores(spark, truth, guess):
    return {r.sequence_id: r for r in tracking_scores.lts_scores(boxes(spark, truth), boxes(spark, guess)).collect()}


def test_known_tracking_scores(spark):
    same = [("a", f, i, 100 * i + f) for f in range(3) for i in (1, 2)]
    got = scores(spark, same, same)
    assert all(abs(getattr(got[k], c) - 1) < 1e-12 for k in ("a", None) for c in ("hota", "hota_low", "det_a", "ass_a", "loc_a", "idf1"))
    # one identity switch in two frames
    got = scores(spark, [("a", 0, 1, 0), ("a", 1, 1, 0)], [("a", 0, 5, 0), ("a", 1, 6, 0)])["a"]
    assert (got.ass_a, round(got.hota, 9), got.idf1, got.det_a) == (0.5, round(math.sqrt(0.5), 9), 0.5, 1.0)
    # an overlap of exactly one third counts for thresholds up to it
    got = scores(spark, [("a", 0, 1, 0)], [("a", 0, 1, 5)])["a"]
    assert abs(got.det_a - 6 / 19) < 1e-12 and got.idf1 == 0
    # one side empty
    got = scores(spark, same, [("b", 0, 1, 0)])
    assert got["a"].hota == got["b"].hota == 0 and got[None].n_truth == 6 and got[None].n_guess == 1


def test_pooled_scores_weigh_by_true_positives(spark):
    rnd = random.Random(3)
    truth = [(s, f, i, 60 * i + rnd.uniform(-4, 4)) for s in "ab" for f in range(6 if s == "a" else 2) for i in range(3)]
    guess = [(s, f, (i + (f > 3)) % 3, x + rnd.uniform(-6, 6)) for s, f, i, x in truth if rnd.random() < 0.8]
    got = scores(spark, truth, guess)
    iou = lambda a, b: max(0.0, 10 - abs(a - b)) / (20 - max(0.0, 10 - abs(a - b)))
    per = {}
    for s in "ab":
        t, g = [r for r in truth if r[0] == s], [r for r in guess if r[0] == s]
        n_t, n_p = {i: sum(r[2] == i for r in t) for i in range(3)}, {i: sum(r[2] == i for r in g) for i in range(3)}
        pairs = {(a[1], a[2], b[2]): iou(a[3], b[3]) for a in t for b in g if a[1] == b[1] and iou(a[3], b[3]) > 0}
        part = {k: v / (sum(w for m, w in pairs.items() if m[:2] == k[:2]) + sum(w for m, w in pairs.items() if (m[0], m[2]) == (k[0], k[2])) - v) for k, v in pairs.items()}
        pot = {(i, j): sum(v for k, v in part.items() if k[1:] == (i, j)) for i in range(3) for j in range(3)}
        jac = {k: v / (n_t[k[0]] + n_p[k[1]] - v) if v else 0.0 for k, v in pot.items()}
        hits = []
        for f in {r[1] for r in t}:
            best = max(permutations(range(3)), key=lambda q: sum(jac[i, j] * pairs.get((f, i, j), 0) for i, j in enumerate(q)))
            hits += [(i, j, pairs[f, i, j]) for i, j in enumerate(best) if (f, i, j) in pairs]
        over = {(i, j): sum(v >= 0.5 - 1e-9 for k, v in pairs.items() if k[1:] == (i, j)) for i in range(3) for j in range(3)}
        id_tp = max(sum(over[i, j] for i, j in enumerate(q)) for q in permutations(range(3)))
        rows = []
        for k in range(1, 20):
            ok = [(i, j, v) for i, j, v in hits if v >= k / 20 - 1e-9]
            c = {(i, j): sum((a, b) == (i, j) for a, b, _ in ok) for i in range(3) for j in range(3)}
            rows.append((len(ok), sum(n * n / max(1, n_t[i] + n_p[j] - n) for (i, j), n in c.items())))
        per[s] = (rows, len(t), len(g), id_tp)
    per[None] = ([(a[0] + b[0], a[1] + b[1]) for a, b in zip(per["a"][0], per["b"][0])], *(x + y for x, y in zip(per["a"][1:], per["b"][1:])))
    for s, (rows, nt, ng, id_tp) in per.items():
        h = [math.sqrt(tp / max(1, nt + ng - tp) * ass / max(1, tp)) for tp, ass in rows]
        assert abs(got[s].hota - sum(h) / 19) < 1e-9 and abs(got[s].hota_low - h[0]) < 1e-9 and abs(got[s].idf1 - 2 * id_tp / (nt + ng)) < 1e-12
    means = tracking_scores.organiser_means(tracking_scores.lts_scores(boxes(spark, truth), boxes(spark, guess))).first()
    assert means["rows"] == 3 and abs(means.idf1 - sum(r.idf1 for r in got.values()) / 3) < 1e-12
