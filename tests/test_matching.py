"""Matching of times against brute force."""

import math
import random

import numpy as np
import pytest

from tracklume.operators import matching


def best_matching(a, b, tol):
    """Most pairs, then least distance, over all one-to-one choices."""
    def go(i, used):
        if i == len(a):
            return 0, 0.0
        best = go(i + 1, used)
        for j, y in enumerate(b):
            if j not in used and abs(a[i] - y) <= tol:
                n, d = go(i + 1, used | {j})
                best = max(best, (n + 1, d - abs(a[i] - y)))
        return best

    return go(0, frozenset())


def test_ordered_assignment_is_optimal():
    rnd = random.Random(1)
    for _ in range(400):
        a = sorted(round(rnd.uniform(0, 6), 1) for _ in range(rnd.randint(0, 6)))
        b = sorted(round(rnd.uniform(0, 6), 1) for _ in range(rnd.randint(0, 6)))
        tol = rnd.choice([0.0, 0.3, 1.0, 9.0])
        got = matching.ordered_assignment(np.array(a), np.array(b), tol)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and all(abs(a[i] - b[j]) <= tol for i, j in got)
        n, d = best_matching(a, b, tol)
        assert len(got) == n and math.isclose(sum(abs(a[i] - b[j]) for i, j in got), -d, abs_tol=1e-9)


def test_ordered_assignment_prefers_number_to_distance():
    assert matching.ordered_assignment(np.array([1.0, 1.4]), np.array([0.7, 1.1]), 0.35) == [(0, 0), (1, 1)]
    n = 3000  # memory and work follow the pairs within the tolerance
    t = np.arange(n, dtype=float)
    assert matching.ordered_assignment(t, t + 0.25, 1.0) == [(i, i) for i in range(n)]


def simple_service(wanted, found, tol):
    free, out = dict(enumerate(found)), []
    for t in wanted:
        near = min((abs(x - t) for x in found), default=math.inf)
        i = min(free, key=lambda k: (abs(free[k] - t), free[k], k), default=None)
        if i is not None and abs(free[i] - t) <= tol:
            out.append((i, True))
            del free[i]
        else:
            out.append((-1, near <= tol))
    return out


def test_first_come():
    rnd = random.Random(2)
    for _ in range(500):
        a = sorted(round(rnd.uniform(0, 5), 1) for _ in range(rnd.randint(0, 9)))
        b = sorted(round(rnd.uniform(0, 5), 1) for _ in range(rnd.randint(0, 9)))
        order = np.array(rnd.sample(range(len(a)), len(a)), int)
        tol = rnd.choice([0.0, 0.4, 2.0])
        got = matching.first_come(np.array(a), order, np.array(b), tol)
        want = simple_service([a[k] for k in order], b, tol)
        assert [got[k] for k in order] == want


def test_optimal_times_over_sequences(spark):
    rnd = random.Random(3)
    rows = lambda n, k: [(rnd.choice(["p", "q", None]), round(rnd.uniform(0, 60), 2), 1000 * k + i) for i in range(n)] + [("p", None, 1000 * k + 900)]
    a, b = rows(120, 1), rows(110, 2)
    frame = lambda r: spark.createDataFrame(r, "sequence_id string, time_s double, key long").repartition(3)
    got = matching.optimal_times(frame(a), frame(b), ["sequence_id"], 0.4).collect()
    for s in ("p", "q", None):
        x, y = (sorted(t for q, t, _ in r if q == s and t is not None) for r in (a, b))
        want = matching.ordered_assignment(np.array(x), np.array(y), 0.4)
        own = [r for r in got if r.sequence_id == s]
        assert len(own) == len(want) and math.isclose(sum(abs(r.time_s - r.match_s) for r in own), sum(abs(x[i] - y[j]) for i, j in want), abs_tol=1e-9)
        assert len({r.key for r in own}) == len({r.match_key for r in own}) == len(own)


def test_match_submission(spark):
    schema = "sequence_id string, time_s double, key long, track_id string, x_m double, y_m double, z_m double"
    truth = [("a", 0.0, 1, "u", 0.0, 0.0, 0.0), ("a", 1.0, 2, "u", 1.0, 0.0, 0.0), ("a", 0.1, 3, "v", 9.0, 0.0, 0.0), ("b", 0.0, 4, "nan", 5.0, 5.0, 5.0)]
    sub = [("a", 0.2, 1, "u", 0.0, 3.0, 4.0), ("a", 0.1, 2, " u ", 0.0, 0.0, 0.0), ("a", 0.1, 3, "w", 0.0, 0.0, 0.0), ("a", 5.0, 4, "v", 0.0, 0.0, 0.0), ("a", 0.1, 5, None, 0.0, 0.0, 0.0), ("b", 0.3, 6, "x", 5.0, 5.0, 6.0), ("b", 0.4, 7, "x", 0.0, 0.0, 0.0), ("c", 0.0, 8, "u", 0.0, 0.0, 0.0), ("b", None, 9, "x", 0.0, 0.0, 0.0)]
    got = {r.key: r for r in matching.match_submission(spark.createDataFrame(sub, schema), spark.createDataFrame(truth, schema), 0.5).collect()}
    assert {k: (r.matched, r.reason, r.truth_key) for k, r in got.items()} == {
        1: (True, None, 1), 2: (False, "duplicate_truth_match", None), 3: (False, "track_id_mismatch", None), 4: (False, "time_gate", None), 5: (False, "track_id_mismatch", None),
        6: (True, None, 4), 7: (False, "duplicate_truth_match", None), 8: (False, "missing_sequence_truth", None), 9: (False, "time_gate", None),
    }
    assert (got[1].error_2d_m, got[1].error_3d_m, got[6].error_3d_m) == (3.0, 5.0, 1.0) and got[2].error_2d_m is None
