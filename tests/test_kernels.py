import itertools

import numpy as np
import pytest

from tracklume.operators import kernels as K


def test_chi2_quantiles():
    assert K.chi2_quantile(0.95, 2) == pytest.approx(5.991464547, abs=1e-6)
    assert K.chi2_quantile(0.99, 3) == pytest.approx(11.34486673, abs=1e-6)
    assert K.chi2_quantile(0.5, 6) == pytest.approx(5.348120627, abs=1e-6)


def test_filter_follows_a_line_and_gates_an_outlier():
    t = np.arange(20.0)
    z = np.stack([3 * t, -t], 1)
    z[10] += 500
    got = K.cv_filter(t, z, np.full(20, 1.0), 0.1, K.chi2_quantile(0.999, 2))
    assert not got["accepted"][10] and got["accepted"].sum() == 19
    assert np.allclose(got["mean"][-1], [57, -19, 3, -1], atol=0.1)
    smooth = K.rts(t, got["mean"], got["cov"], 0.1)
    assert np.allclose(smooth[10, :2], [30, -10], atol=0.5)
    assert np.allclose(K.rts(t, got["mean"], got["cov"], 0.1, lag_s=100.0), smooth)


def _many(rng):
    sizes = [1, 5, 2, 9, 1, 30]
    starts = np.cumsum([0, *sizes[:-1]])
    t = np.concatenate([np.sort(rng.random(n) * 50) for n in sizes])
    return starts, sizes, t


@pytest.mark.parametrize("robust,gate", [("none", None), ("none", 4.0), ("student-t", None), ("huber", 9.0)])
def test_many_sequences_are_filtered_as_each_alone(robust, gate):
    rng = np.random.default_rng(3)
    starts, sizes, t = _many(rng)
    z = rng.normal(size=(len(t), 2)) * 40
    got = K.cv_filter_many(t, z, starts, 5.0, 2.0, gate, robust=robust)
    smooth = K.rts_many(t, got, starts, 2.0)
    for a, n in zip(starts, sizes):
        s = slice(a, a + n)
        want = K.cv_filter(t[s], z[s], np.full(n, 5.0), 2.0, gate, robust=robust)
        assert np.allclose(got["position"][s], want["mean"][:, :2]) and np.allclose(got["velocity"][s], want["mean"][:, 2:])
        assert np.allclose(got["nis"][s], want["nis"]) and (got["accepted"][s] == want["accepted"]).all()
        assert np.allclose(smooth[s], K.rts(t[s], want["mean"], want["cov"], 2.0)[:, :2], atol=1e-6)


@pytest.mark.parametrize("pairs", [1, 1 << 22])
def test_many_paths_as_each_alone(monkeypatch, pairs):
    monkeypatch.setattr(K, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    starts, sizes, _ = _many(rng)
    t = np.concatenate([np.sort(rng.integers(0, 8, n)) for n in sizes]).astype(float)
    x, score = rng.normal(size=(len(t), 3)) * 3, rng.random(len(t))
    new = np.isin(np.arange(len(t)), starts)
    new[1:] |= t[1:] != t[:-1]
    frames = np.flatnonzero(new)
    first = np.searchsorted(frames, starts)
    rows, post = K.viterbi_many(t, x, score, frames, first, 2.0), K.forward_backward_many(t, x, score, frames, first, 2.0)
    ends = np.append(frames[1:], len(t))
    for a, b in zip(first, [*first[1:], len(frames)]):
        cut = [slice(frames[k], ends[k]) for k in range(a, b)]
        times, parts, s = np.array([t[c.start] for c in cut]), [x[c] for c in cut], [score[c] for c in cut]
        path = K.viterbi(times, parts, s, 2.0)
        assert [c.start + k for c, k in zip(cut, path)] == [r for r in rows if cut[0].start <= r < cut[-1].stop]
        assert np.allclose(np.concatenate(K.forward_backward(times, parts, s, 2.0)), post[cut[0].start : cut[-1].stop])


def test_turns():
    t = np.arange(30.0)
    z = np.stack([100 * np.sin(0.1 * t), 100 * (1 - np.cos(0.1 * t))], 1)
    got = K.imm_filter(t, z, np.full(30, 0.5), (1.0,), turns=(0.1, -0.1), turn_accel=0.5)
    assert got["weight"][-1].argmax() == 1
    assert np.allclose(K.turn_transition(1.0, 1e-12, 2), K.transition(1.0, 2))


def test_jerk_and_local_lines():
    t = np.arange(12.0)
    x = np.stack([2 * t, t * 0], 1)
    y = x.copy()
    y[6] += 30
    got = K.jerk_limited(t, y, 5.0, weight=100.0, rounds=3)
    assert np.abs(got[6] - x[6]).max() < 20 and np.allclose(K.jerk_limited(t, x, 5.0), x)
    assert np.allclose(K.local_linear(t, x, 3.0), x)
    assert 5 < np.abs(K.local_linear(t, y, 3.0, most_m=10.0)[6] - y[6]).max() <= 10 + 1e-9


def test_imm_weights_sum_to_one():
    t = np.arange(10.0)
    got = K.imm_filter(t, np.stack([t, t], 1), np.full(10, 1.0))
    assert np.allclose(got["weight"].sum(1), 1) and got["weight"][-1].argmax() == 0


@pytest.mark.parametrize("seed", range(20))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2).tolist()
    c = rng.random((n, m))
    got = sum(c[i, j] for i, j in K.assignment(c))
    k = min(n, m)
    best = min(sum(c[i, j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    assert got == pytest.approx(best)


def test_matching_prefers_more_pairs():
    got = K.matched_frames([np.array([[0.0], [3.0]])], [np.array([[1.0], [-2.0]])], 2.1)
    assert sorted((i, j) for i, j, _ in got[0]) == [(0, 1), (1, 0)]
    assert sum(d for *_, d in got[0]) == pytest.approx(4.0)


def test_hota_cases():
    box = np.array([[0.0, 0, 10, 10]])
    one = K.iou_matrix(box, box)
    same = K.hota([np.array([5]), np.array([5])], [np.array([5]), np.array([5])], [one, one])
    assert same["hota"] == same["mota"] == same["idf1"] == 1
    switch = K.hota([np.array([5]), np.array([5])], [np.array([5]), np.array([6])], [one, one])
    assert switch["ass_a"] == pytest.approx(0.5) and switch["hota"] == pytest.approx(0.5**0.5)
    assert switch["mota"] == 0.5 and switch["idf1"] == 0.5 and switch["id_switches"] == 1
    assert K.iou_matrix(box, box + [5, 0, 0, 0])[0, 0] == pytest.approx(1 / 3)


def test_paths():
    times = np.arange(4.0)
    frames = [np.array([[t, 0.0, 0], [50.0 - t, 0, 0]]) for t in times]
    scores = [np.array([0.1, 0.2]) if i else np.array([1.0, 0.0]) for i in range(4)]
    assert K.viterbi(times, frames, scores, 2.0) == [0, 0, 0, 0]
    post = K.forward_backward(times, frames, scores, 2.0)
    assert all(p[0] > 0.5 and p.sum() == pytest.approx(1) for p in post)


def test_repairs():
    t = np.arange(5.0)
    assert np.allclose(K.speed_limit(t, np.array([[0.0], [1], [10], [3], [4]]), 1.5)[:, 0], [0, 1, 2.5, 3, 4])
    assert np.allclose(K.vertical_spikes(t, np.array([0.0, 0, 50, 0, 0]), 20, 10, 15), 0)
    line = np.stack([t, 2 * t], 1)
    assert np.allclose(K.regularized(t, line, 100.0), line)
    assert np.allclose(K.geometric_median(np.array([[0.0, 0], [0, 0], [9, 9]]), np.ones(3)), 0, atol=1e-3)


def test_suppression():
    xyz = np.array([[0.0, 0, 0], [1, 0, 0], [9, 0, 0]])
    assert K.spatial_nms(xyz, np.array([1.0, 2, 0]), 3.0, 5) == [1, 2]


def _sequences(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 20, 40)
    t = [np.cumsum(rng.integers(1, 200, n)).astype(float) for n in sizes]
    return np.cumsum(sizes) - sizes, t, [rng.normal(size=(n, 2)) * 200 for n in sizes]


def test_smoothing_of_many_sequences_is_that_of_each(monkeypatch):
    def by_rows(t, x, weight, huber):  # the plain solve, sequence by sequence
        n, y = len(t), x
        if n < 3:
            return x
        d = np.zeros((n - 2, n))
        a, b = np.diff(t)[:-1], np.diff(t)[1:]
        for k in range(n - 2):
            d[k, k : k + 3] = 2 / (a[k] * (a[k] + b[k])), -2 / (a[k] * b[k]), 2 / (b[k] * (a[k] + b[k]))
        for _ in range(5):
            w = np.minimum(1.0, huber / np.maximum(np.sqrt(((x - y) ** 2).sum(1)), 1e-12))
            new = np.linalg.solve(np.diag(w) + weight * d.T @ d, w[:, None] * x)
            if np.allclose(new, y, atol=1e-9):
                return new
            y = new
        return y

    starts, t, x = _sequences(1)
    seen = [np.searchsorted(s, s + 200.0, "right") for s in t]
    lagged = [np.stack([by_rows(s[:e], z[:e], 1e4, 100.0)[i] for i, e in enumerate(ends)]) for s, z, ends in zip(t, x, seen)]
    for alone, prefixes in ((4096, 1 << 18), (8, 50)):
        monkeypatch.setattr(K, "LONG", alone)
        monkeypatch.setattr(K, "PREFIXES", prefixes)
        assert np.allclose(K.regularized_many(np.concatenate(t), np.concatenate(x), starts, 1e4, 100.0), np.concatenate([by_rows(s, z, 1e4, 100.0) for s, z in zip(t, x)]))
        assert np.allclose(K.lagged_many(np.concatenate(t), np.concatenate(x), starts, 1e4, 100.0, 200.0), np.concatenate(lagged))
