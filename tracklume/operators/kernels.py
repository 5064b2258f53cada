"""NumPy kernels for recursions in time; no Spark here, so each is testable alone."""

from __future__ import annotations

import math

import numpy as np


# --- constant-velocity filter

def transition(dt: float, dims: int) -> np.ndarray:
    eye = np.eye(dims)
    return np.block([[eye, dt * eye], [np.zeros((dims, dims)), eye]])


def process_noise(dt: float, accel_std: float, dims: int) -> np.ndarray:
    """White acceleration: q [[dt^3/3, dt^2/2], [dt^2/2, dt]]."""
    eye = np.eye(dims) * accel_std**2
    return np.block([[eye * dt**3 / 3, eye * dt**2 / 2], [eye * dt**2 / 2, eye * dt]])


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_quantile(p: float, df: int) -> float:
    """Quantile of the chi-square distribution, by bisection."""
    if not 0 < p < 1:
        raise ValueError("a probability between 0 and 1")
    lo, hi = 0.0, 1.0
    while _gamma_p(df / 2, hi / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def student_t_scale(nis: float, dim: int, dof: float = 4.0) -> float:
    """Covariance inflation of a Student-t likelihood: (dof + NIS) / (dof + dim), at least 1."""
    return max(1.0, (dof + nis) / (dof + dim))


def huber_scale(nis: float, threshold: float = 2.0) -> float:
    """Covariance inflation of Huber's loss: residual norm over the threshold, at least 1."""
    return max(1.0, math.sqrt(max(nis, 0.0)) / threshold)


def cv_filter(t: np.ndarray, z: np.ndarray, std: np.ndarray, accel_std: float = 4.0, gate: float | None = None, velocity_std: float = 15.0, robust: str = "none") -> dict[str, np.ndarray]:
    """Time-ordered constant-velocity Kalman filter with an NIS gate and robust scaling.

    Rows must be sorted; the first initialises.  A gated row coasts.  Joseph-form updates.
    """
    n, d = z.shape
    mean = np.concatenate([z[0], np.zeros(d)])
    cov = np.diag(np.concatenate([np.full(d, std[0] ** 2), np.full(d, velocity_std**2)])).astype(float)
    h = np.hstack([np.eye(d), np.zeros((d, d))])
    out = {"mean": np.empty((n, 2 * d)), "cov": np.empty((n, 2 * d, 2 * d)), "nis": np.zeros(n), "accepted": np.ones(n, bool), "scale": np.ones(n)}
    for i in range(n):
        if i:
            dt = max(0.0, float(t[i] - t[i - 1]))
            f = transition(dt, d)
            mean, cov = f @ mean, f @ cov @ f.T + process_noise(dt, accel_std, d)
            r = z[i] - h @ mean
            noise = np.eye(d) * std[i] ** 2
            s = h @ cov @ h.T + noise
            nis = float(r @ np.linalg.solve(s, r))
            out["nis"][i] = nis
            if gate is not None and nis > gate:
                out["accepted"][i] = False
            else:
                scale = student_t_scale(nis, d) if robust == "student-t" else huber_scale(nis) if robust == "huber" else 1.0
                out["scale"][i] = scale
                noise = noise * scale
                gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + noise)
                mean = mean + gain @ r
                keep = np.eye(2 * d) - gain @ h
                cov = keep @ cov @ keep.T + gain @ noise @ gain.T
        out["mean"][i], out["cov"][i] = mean, cov
    return out


def rts(t: np.ndarray, mean: np.ndarray, cov: np.ndarray, accel_std: float, lag_s: float | None = None) -> np.ndarray:
    """Rauch-Tung-Striebel smoothing of a filter's records; with a lag each row only sees so far ahead."""
    n, d = len(t), mean.shape[1] // 2

    def back(last: int, first: int) -> np.ndarray:
        m, out = mean[last], {}
        out[last] = m
        for i in range(last - 1, first - 1, -1):
            dt = float(t[i + 1] - t[i])
            f = transition(dt, d)
            p = f @ cov[i] @ f.T + process_noise(dt, accel_std, d) + 1e-12 * np.eye(2 * d)
            g = cov[i] @ f.T @ np.linalg.inv(p)
            m = mean[i] + g @ (m - f @ mean[i])
            out[i] = m
        return out

    if lag_s is None:
        got = back(n - 1, 0)
        return np.array([got[i] for i in range(n)])
    ends = np.searchsorted(t, t + lag_s, "right") - 1
    return np.array([back(int(ends[i]), i)[i] for i in range(n)])


def _steps_of(starts: np.ndarray, n: int):
    """Rows by their place within their sequence: arrays of rows, one per step, of the sequences that are long enough."""
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    sizes, first = sizes[order], starts[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        yield first[: int(np.searchsorted(-sizes, -k, "left"))] + k


def cv_filter_many(t: np.ndarray, z: np.ndarray, starts: np.ndarray, std_m: float, accel_std: float = 4.0, gate: float | None = None, velocity_std: float = 15.0, robust: str = "none") -> dict[str, np.ndarray]:
    """:func:`cv_filter` of many sequences at once, step by step.

    Axes share their noise, so one 2x2 covariance (position, velocity) serves all axes of a sequence.
    """
    n, d = z.shape
    x, v = z.copy(), np.zeros_like(z)
    p = np.tile([std_m**2, 0.0, velocity_std**2], (n, 1))
    out = {"position": x, "velocity": v, "cov": p, "nis": np.zeros(n), "accepted": np.ones(n, bool)}
    q, r0 = accel_std**2, std_m**2
    for k, rows in enumerate(_steps_of(starts, n)):
        if not k:
            continue
        dt = np.maximum(0.0, t[rows] - t[rows - 1])
        p00, p01, p11 = p[rows - 1].T
        p00, p01, p11 = p00 + 2 * dt * p01 + dt * dt * p11 + q * dt**3 / 3, p01 + dt * p11 + q * dt * dt / 2, p11 + q * dt
        at, speed = x[rows - 1] + dt[:, None] * v[rows - 1], v[rows - 1]
        miss = z[rows] - at
        nis = (miss * miss).sum(1) / (p00 + r0)
        ok = np.ones(len(rows), bool) if gate is None else nis <= gate
        if robust == "student-t":
            scale = np.maximum(1.0, (4.0 + nis) / (4.0 + d))
        elif robust == "huber":
            scale = np.maximum(1.0, np.sqrt(nis) / 2.0)
        else:
            scale = 1.0
        r = r0 * scale
        g0, g1 = np.where(ok, p00 / (p00 + r), 0.0), np.where(ok, p01 / (p00 + r), 0.0)
        x[rows], v[rows] = at + g0[:, None] * miss, speed + g1[:, None] * miss
        p[rows] = np.stack([(1 - g0) * p00, (1 - g0) * p01, p11 - g1 * p01], 1)
        out["nis"][rows], out["accepted"][rows] = nis, ok
    return out


def rts_many(t: np.ndarray, got: dict[str, np.ndarray], starts: np.ndarray, accel_std: float) -> np.ndarray:
    """Rauch-Tung-Striebel smoothing of :func:`cv_filter_many`'s records: positions."""
    x, v, p = got["position"].copy(), got["velocity"].copy(), got["cov"]
    q = accel_std**2
    for rows in list(_steps_of(starts, len(t)))[:0:-1]:
        rows = rows - 1  # each has a successor
        dt = t[rows + 1] - t[rows]
        p00, p01, p11 = p[rows].T
        a, b, c = p00 + 2 * dt * p01 + dt * dt * p11 + q * dt**3 / 3 + 1e-12, p01 + dt * p11 + q * dt * dt / 2, p11 + q * dt + 1e-12
        det = a * c - b * b
        u0, u1 = p00 + dt * p01, p01 + dt * p11  # covariance of now with next: [[u0, p01], [u1, p11]]
        g = [[(u0 * c - p01 * b) / det, (p01 * a - u0 * b) / det], [(u1 * c - p11 * b) / det, (p11 * a - u1 * b) / det]]
        dx, dv = x[rows + 1] - got["position"][rows] - dt[:, None] * got["velocity"][rows], v[rows + 1] - got["velocity"][rows]
        x[rows] += g[0][0][:, None] * dx + g[0][1][:, None] * dv
        v[rows] += g[1][0][:, None] * dx + g[1][1][:, None] * dv
    return x


def turn_transition(dt: float, rate: float, dims: int) -> np.ndarray:
    """Constant turn of the first two axes at a fixed rate (rad/s); the other axes move straight."""
    f = transition(dt, dims)
    if dims < 2 or abs(rate) < 1e-9:
        return f
    s, c = math.sin(rate * dt), math.cos(rate * dt)
    f[0:2, dims : dims + 2] = [[s / rate, -(1 - c) / rate], [(1 - c) / rate, s / rate]]
    f[dims : dims + 2, dims : dims + 2] = [[c, -s], [s, c]]
    return f


def mode_switching(k: int, dt: float, dwell_s: float) -> np.ndarray:
    """Modes stay with probability exp(-dt / dwell) and else move to each other mode alike."""
    stay = math.exp(-dt / dwell_s)
    move = np.full((k, k), (1 - stay) / max(1, k - 1))
    np.fill_diagonal(move, stay if k > 1 else 1.0)
    return move


def imm_filter(t: np.ndarray, z: np.ndarray, std: np.ndarray, accels: tuple = (1.0, 4.0, 12.0), dwell_s: float = 10.0, turns: tuple = (), turn_accel: float = 4.0) -> dict[str, np.ndarray]:
    """Interacting multiple models: constant-velocity modes of several accelerations, and modes that turn at fixed rates."""
    n, d = z.shape
    modes = [(0.0, a) for a in accels] + [(w, turn_accel) for w in turns]
    k = len(modes)
    h = np.hstack([np.eye(d), np.zeros((d, d))])
    means = np.repeat(np.concatenate([z[0], np.zeros(d)])[None], k, 0)
    covs = np.repeat(np.diag(np.concatenate([np.full(d, std[0] ** 2), np.full(d, 225.0)]))[None], k, 0)
    weight = np.full(k, 1 / k)
    out = {"mean": np.empty((n, 2 * d)), "weight": np.empty((n, k))}
    for i in range(n):
        if i:
            dt = max(0.0, float(t[i] - t[i - 1]))
            move = mode_switching(k, dt, dwell_s)
            prior = weight @ move
            mix = move * weight[:, None] / prior[None, :]
            mixed = mix.T @ means
            diff = means[None, :, :] - mixed[:, None, :]
            spread = np.einsum("ij,iab->jab", mix, covs) + np.einsum("ij,jia,jib->jab", mix, diff, diff)
            f = np.stack([turn_transition(dt, w, d) for w, _ in modes])
            noise = np.stack([process_noise(dt, a, d) for _, a in modes])
            m, c = np.einsum("jab,jb->ja", f, mixed), f @ spread @ f.transpose(0, 2, 1) + noise
            r, s = z[i] - m[:, :d], c[:, :d, :d] + np.eye(d) * std[i] ** 2
            inv = np.linalg.inv(s)
            like = -0.5 * (np.einsum("ja,jab,jb->j", r, inv, r) + np.linalg.slogdet(2 * math.pi * s)[1])
            gain = c @ h.T @ inv
            means, covs = m + np.einsum("jab,jb->ja", gain, r), c - gain @ s @ gain.transpose(0, 2, 1)
            w = prior * np.exp(like - like.max())
            weight = w / w.sum()
        out["mean"][i], out["weight"][i] = weight @ means, weight
    return out


# --- paths over candidates in frames

def _steps(prev: np.ndarray, now: np.ndarray, dt: float, speed: float) -> np.ndarray:
    """Log score of moving from each previous candidate to each present one: Gaussian in speed."""
    v = np.sqrt(((now[None, :, :] - prev[:, None, :]) ** 2).sum(-1)) / max(dt, 1e-9)
    return -0.5 * (v / speed) ** 2


def viterbi(times: np.ndarray, frames: list[np.ndarray], scores: list[np.ndarray], speed: float) -> list[int]:
    """Index of the best path's candidate in every frame; ties go to the first."""
    best, back = scores[0].astype(float), []
    for i in range(1, len(frames)):
        total = best[:, None] + _steps(frames[i - 1], frames[i], float(times[i] - times[i - 1]), speed)
        back.append(total.argmax(0))
        best = total.max(0) + scores[i]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(times: np.ndarray, frames: list[np.ndarray], scores: list[np.ndarray], speed: float) -> list[np.ndarray]:
    """Posterior of each candidate in its frame, in log space."""
    n = len(frames)
    moves = [_steps(frames[i], frames[i + 1], float(times[i + 1] - times[i]), speed) for i in range(n - 1)]
    fwd = [scores[0].astype(float)]
    for i in range(1, n):
        fwd.append(_lse(fwd[-1][:, None] + moves[i - 1], 0) + scores[i])
    bwd = [np.zeros(len(scores[-1]))]
    for i in range(n - 2, -1, -1):
        bwd.append(_lse(moves[i] + (bwd[-1] + scores[i + 1])[None, :], 1))
    out = []
    for f, b in zip(fwd, bwd[::-1]):
        p = np.exp(f + b - (f + b).max())
        out.append(p / p.sum())
    return out


#: Numbers of a block of transition scores.
PAIRS = 1 << 22


def _frame_steps(frames: np.ndarray, first: np.ndarray, n: int, factor: int = 1):
    """Blocks of sequences; of each block a list of steps: (sequences of the block that reach it, rows of their candidates, mask).

    A block's padded transitions, ``factor`` for each pair of candidates, hold at most ``PAIRS`` numbers (one sequence may exceed it alone).
    """
    ends = np.append(frames[1:], n)
    sizes, lengths = ends - frames, np.diff(np.append(first, len(frames)))
    widest = np.maximum.reduceat(sizes, first) if len(first) else np.zeros(0, int)
    order = np.lexsort((-lengths, widest))
    at = 0
    while at < len(order):
        last = at + 1
        while last < len(order) and factor * (last + 1 - at) * int(widest[order[last]]) ** 2 <= PAIRS:
            last += 1
        block = order[at:last]
        block = block[np.argsort(-lengths[block], kind="stable")]
        steps = []
        for k in range(int(lengths[block[0]])):
            f = first[block[lengths[block] > k]] + k
            width = int(sizes[f].max())
            inside = np.arange(width) < sizes[f][:, None]
            steps.append((np.where(inside, frames[f][:, None] + np.arange(width), frames[f][:, None]), inside))
        yield steps
        at = last


def _moves(t: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, speed: float, kind: np.ndarray | None = None, switch: float = 0.0) -> np.ndarray:
    """Log scores of moving from candidates a (rows, by sequence) to b: Gaussian in speed, a penalty for another source."""
    dt = np.maximum(t[b[:, :1]] - t[a[:, :1]], 1e-9)[:, :, None]
    v2 = ((x[b][:, None, :, :] - x[a][:, :, None, :]) ** 2).sum(-1) / dt**2
    out = -0.5 * v2 / speed**2
    return out if kind is None or not switch else out - switch * (kind[b][:, None, :] != kind[a][:, :, None])


def viterbi_many(t: np.ndarray, x: np.ndarray, score: np.ndarray, frames: np.ndarray, first: np.ndarray, speed: float) -> np.ndarray:
    """Rows of the best path of each sequence; ties go to the first candidate."""
    out = []
    for steps in _frame_steps(frames, first, len(t)):
        back: list[np.ndarray] = []
        best = np.where(steps[0][1], score[steps[0][0]], -np.inf)
        finals: list[np.ndarray] = []
        for (a, _), (b, inside) in zip(steps, steps[1:]):
            m = len(b)
            finals.append(best[m:].argmax(1))
            total = best[:m, :, None] + _moves(t, x, a[:m], b, speed)
            back.append(total.argmax(1))
            best = np.where(inside, total.max(1) + score[b], -np.inf)
        finals.append(best.argmax(1))
        at = np.zeros(0, int)
        for k in range(len(steps) - 1, -1, -1):  # sequences that end at a step join there
            at = np.concatenate([np.take_along_axis(back[k], at[:, None], 1)[:, 0] if k < len(back) else at, finals[k]])
            out.append(np.take_along_axis(steps[k][0], at[:, None], 1)[:, 0])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, int)


def forward_backward_many(t: np.ndarray, x: np.ndarray, score: np.ndarray, frames: np.ndarray, first: np.ndarray, speed: float, kind: np.ndarray | None = None, switch: float = 0.0) -> np.ndarray:
    """Posterior of each row in its frame, in log space, for many sequences."""
    out = np.zeros(len(t))
    for steps in _frame_steps(frames, first, len(t)):
        fwd = [np.where(steps[0][1], score[steps[0][0]], -np.inf)]
        moves = []
        for (a, _), (b, inside) in zip(steps, steps[1:]):
            moves.append(_moves(t, x, a[: len(b)], b, speed, kind, switch))
            fwd.append(np.where(inside, _lse(fwd[-1][: len(b), :, None] + moves[-1], 1) + score[b], -np.inf))
        bwd = np.zeros((0, 0))
        for k in range(len(steps) - 1, -1, -1):
            rows, inside = steps[k]
            here = np.zeros(rows.shape)
            if len(bwd):
                b, ok = steps[k + 1]
                here[: len(b)] = _lse(moves[k] + np.where(ok, bwd + score[b], -np.inf)[:, None, :], 2)
            total = np.where(inside, fwd[k] + here, -np.inf)
            e = np.exp(total - total.max(1, keepdims=True))
            out[rows[inside]] = (e / e.sum(1, keepdims=True))[inside]
            bwd = here
    return out


# --- repair and smoothing

def speed_limit(t: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Forward, then backward projection onto the ball that the speed limit allows around the neighbour."""
    x = x.copy()
    for order in (range(1, len(t)), range(len(t) - 2, -1, -1)):
        for i in order:
            j = i - 1 if isinstance(order, range) and order.step == 1 else i + 1
            step, room = x[i] - x[j], most * abs(float(t[i] - t[j]))
            far = float(np.sqrt((step * step).sum()))
            if far > room:
                x[i] = x[j] + step * (room / far if far else 0.0)
    return x


def vertical_spikes(t: np.ndarray, z: np.ndarray, most_speed: float, neighbour_speed: float, residual: float) -> np.ndarray:
    """One Gauss-Seidel pass: the previous row is the repaired one."""
    z = z.copy()
    for i in range(1, len(z) - 1):
        a, b, c = float(t[i] - t[i - 1]), float(t[i + 1] - t[i]), float(t[i + 1] - t[i - 1])
        if min(a, b) <= 0:
            continue
        line = z[i - 1] + (z[i + 1] - z[i - 1]) * a / c
        fast = abs(z[i] - z[i - 1]) / a > most_speed or abs(z[i + 1] - z[i]) / b > most_speed
        if fast and abs(z[i + 1] - z[i - 1]) / c <= neighbour_speed and abs(z[i] - line) > residual:
            z[i] = line
    return z


def banded_solve(band: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """A symmetric positive definite system of five bands by its LDL' factors: linear in the rows."""
    n = band.shape[1]
    d, l1, l2 = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        d[i] = band[0, i] - (l1[i - 1] ** 2 * d[i - 1] if i else 0.0) - (l2[i - 2] ** 2 * d[i - 2] if i > 1 else 0.0)
        l1[i] = (band[1, i] - (l1[i - 1] * l2[i - 1] * d[i - 1] if i else 0.0)) / d[i]
        l2[i] = band[2, i] / d[i]
    y = rhs.astype(float).copy()
    for i in range(n):
        if i:
            y[i] -= l1[i - 1] * y[i - 1]
        if i > 1:
            y[i] -= l2[i - 2] * y[i - 2]
    y /= d[:, None]
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            y[i] -= l1[i] * y[i + 1]
        if i + 2 < n:
            y[i] -= l2[i] * y[i + 2]
    return y


#: Rows of the prefixes that are solved at a time.
PREFIXES = 1 << 18
#: Rows from which a sequence is solved alone: along a step arrays over few sequences cost more than numbers.
LONG = 4096


def banded_solve_many(band: np.ndarray, rhs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """:func:`banded_solve` for the sequences that begin at ``starts``, step by step for all of them; no band may cross a start."""
    n = band.shape[1]
    sizes = np.diff(np.append(starts, n))
    out = np.empty(rhs.shape)
    for a, b in zip(starts[sizes > LONG].tolist(), (starts + sizes)[sizes > LONG].tolist()):
        out[a:b] = banded_solve(band[:, a:b], rhs[a:b])
    few = sizes <= LONG
    rows = np.flatnonzero(np.repeat(few, sizes))
    if not len(rows):
        return out
    band, y = band[:, rows], rhs[rows].astype(float)
    at = np.cumsum(sizes[few]) - sizes[few]
    steps = list(_steps_of(at, len(rows)))
    d, l1, l2 = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
    for k, r in enumerate(steps):
        v, u = band[0, r], band[1, r]
        if k:
            v, u = v - l1[r - 1] ** 2 * d[r - 1], u - l1[r - 1] * l2[r - 1] * d[r - 1]
            y[r] -= l1[r - 1, None] * y[r - 1]
        if k > 1:
            v = v - l2[r - 2] ** 2 * d[r - 2]
            y[r] -= l2[r - 2, None] * y[r - 2]
        d[r], l1[r], l2[r] = v, u / v, band[2, r] / v
    y /= d[:, None]
    for k in range(len(steps) - 2, -1, -1):
        r = steps[k][: len(steps[k + 1])]
        y[r] -= l1[r, None] * y[r + 1]
        if k + 2 < len(steps):
            r = r[: len(steps[k + 2])]
            y[r] -= l2[r, None] * y[r + 2]
    out[rows] = y
    return out


def regularized(t: np.ndarray, x: np.ndarray, weight: float, huber: float = np.inf, rounds: int = 5) -> np.ndarray:
    """Penalised second differences with Huber weights on the data: a system of five bands, linear in the rows."""
    return regularized_many(t, x, np.zeros(min(len(t), 1), int), weight, huber, rounds)


def regularized_many(t: np.ndarray, x: np.ndarray, starts: np.ndarray, weight: float, huber: float = np.inf, rounds: int = 5) -> np.ndarray:
    """:func:`regularized` for the sequences that begin at ``starts``; one that no longer moves, or has fewer than three rows, stays."""
    n = len(t)
    sizes = np.diff(np.append(starts, n))
    number = np.repeat(np.arange(len(starts)), sizes)
    i = np.flatnonzero(number[2:] == number[:-2])  # three rows of one sequence from here
    a, b = np.maximum(t[i + 1] - t[i], 1e-9), np.maximum(t[i + 2] - t[i + 1], 1e-9)
    p, q, r = 2 / (a * (a + b)), -2 / (a * b), 2 / (b * (a + b))
    band = np.zeros((3, n))
    band[0, i] += p * p
    band[0, i + 1] += q * q
    band[0, i + 2] += r * r
    band[1, i] += p * q
    band[1, i + 1] += q * r
    band[2, i] += p * r
    band *= weight
    y, moving = x.astype(float), sizes >= 3
    for _ in range(rounds):
        rows = np.flatnonzero(np.repeat(moving, sizes))
        if not len(rows):
            break
        first = np.cumsum(sizes[moving]) - sizes[moving]
        was, data, own = y[rows], x[rows], band[:, rows]
        off = np.sqrt(((data - was) ** 2).sum(1))
        w = np.minimum(1.0, huber / np.maximum(off, 1e-12)) if np.isfinite(huber) else np.ones(len(rows))
        own[0] += w
        new = banded_solve_many(own, w[:, None] * data, first)
        near = np.logical_and.reduceat(np.isclose(new, was, atol=1e-9).all(1), first)
        y[rows] = new
        moving[np.flatnonzero(moving)[near]] = False
    return y


def lagged(t: np.ndarray, x: np.ndarray, weight: float, huber: float, lag_s: float) -> np.ndarray:
    """:func:`regularized` where each row sees the rows up to ``lag_s`` behind it."""
    return lagged_many(t, x, np.zeros(min(len(t), 1), int), weight, huber, lag_s)


def lagged_many(t: np.ndarray, x: np.ndarray, starts: np.ndarray, weight: float, huber: float, lag_s: float) -> np.ndarray:
    """:func:`lagged` for the sequences that begin at ``starts``: what a row sees is a sequence of its own, solved once for the rows that see the same.

    Those of about ``PREFIXES`` rows are solved at a time; the rows of all of them grow with the square of a sequence.
    """
    n = len(t)
    ends = np.concatenate([a + np.searchsorted(t[a:b], t[a:b] + lag_s, "right") for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n])]) if n else starts
    begin = np.repeat(starts, np.diff(np.append(starts, n)))
    new = np.ones(n, bool)
    new[1:] = (ends[1:] != ends[:-1]) | (begin[1:] != begin[:-1])
    of_row = np.cumsum(new) - 1
    begin, sizes = begin[new], (ends - begin)[new]
    y = np.empty(x.shape)
    total = np.cumsum(sizes)
    for c in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(total // PREFIXES)) + 1):
        first = np.cumsum(sizes[c]) - sizes[c]
        seen = np.repeat(begin[c] - first, sizes[c]) + np.arange(sizes[c].sum())
        got = regularized_many(t[seen], x[seen], first, weight, huber)
        rows = np.arange(*np.searchsorted(of_row, [c[0], c[-1] + 1])) if len(c) else c
        y[rows] = got[first[of_row[rows] - c[0]] + rows - begin[of_row[rows]]] if len(c) else y[rows]
    return y


def jerk_limited(t: np.ndarray, x: np.ndarray, most: float, weight: float = 10.0, least_m: float = 1.0, most_m: float | None = None, rounds: int = 1, blend: float = 1.0) -> np.ndarray:
    """Rows in a stretch of four whose jerk exceeds the limit move towards the trajectory of least third differences."""
    x, n = x.copy(), len(t)
    if n < 4:
        return x
    gaps = np.maximum(np.diff(t), 1e-9)

    def differences(y: np.ndarray) -> np.ndarray:
        v = np.diff(y, axis=0) / gaps[:, None]
        a = np.diff(v, axis=0) / ((gaps[1:] + gaps[:-1]) / 2)[:, None]
        return np.diff(a, axis=0) / np.maximum((t[3:] - t[:-3]) / 3, 1e-9)[:, None]

    d = differences(np.eye(n))
    smooth = np.linalg.inv(np.eye(n) + weight * (d.T @ d) / max(1e-12, np.abs(d).max() ** 2)) if n <= 64 else None
    for _ in range(rounds):
        hot = np.sqrt((differences(x) ** 2).sum(1)) > most
        if not hot.any():
            break
        rows = np.zeros(n, bool)
        for k in range(4):
            rows[k : n - 3 + k] |= hot
        new = smooth @ x if smooth is not None else np.linalg.solve(np.eye(n) + weight * (d.T @ d) / max(1e-12, np.abs(d).max() ** 2), x)
        step = new - x
        far = np.sqrt((step * step).sum(1))
        if most_m is not None:
            step *= np.minimum(1.0, most_m / np.maximum(far, 1e-12))[:, None]
        rows &= far >= least_m
        if not rows.any():
            break
        x[rows] += blend * step[rows]
    return x


def local_linear(t: np.ndarray, x: np.ndarray, window_s: float = 15.0, blend: float = 1.0, most_m: float = 10.0, least: int = 3) -> np.ndarray:
    """Weighted straight-line fits around each row (Gaussian weights of half the window's width) at the row's time."""
    lo, hi = np.searchsorted(t, t - window_s, "left"), np.searchsorted(t, t + window_s, "right")
    out = x.copy()
    for i in np.flatnonzero(hi - lo >= least).tolist():
        s = slice(int(lo[i]), int(hi[i]))
        d = t[s] - t[i]
        w = np.exp(-0.5 * (d / (window_s / 2)) ** 2)
        s0, s1, s2 = w.sum(), (w * d).sum(), (w * d * d).sum()
        y0, y1 = w @ x[s], (w * d) @ x[s]
        det = s0 * s2 - s1 * s1
        fit = (s2 * y0 - s1 * y1) / det if det > 1e-12 * max(1.0, s0 * s2) else y0 / s0
        step = blend * (fit - x[i])
        far = float(np.sqrt((step * step).sum()))
        out[i] = x[i] + step * (min(1.0, most_m / far) if far else 0.0)
    return out


def geometric_median(x: np.ndarray, w: np.ndarray, rounds: int = 64, tolerance: float = 1e-4) -> np.ndarray:
    """Weiszfeld's iteration in the form that stays defined on a data point (Vardi and Zhang, 2000)."""
    y = (w[:, None] * x).sum(0) / w.sum()
    for _ in range(rounds):
        d = np.sqrt(((x - y) ** 2).sum(1))
        on = d < 1e-12
        v = w[~on] / d[~on]
        if not len(v):
            return y
        t = (v[:, None] * x[~on]).sum(0) / v.sum()
        r = np.sqrt((((v[:, None] * (x[~on] - y)).sum(0)) ** 2).sum())
        eta = w[on].sum()
        new = t if eta == 0 else max(0.0, 1 - eta / r) * t + min(1.0, eta / r) * y if r > 0 else y
        if np.sqrt(((new - y) ** 2).sum()) <= tolerance:
            return new
        y = new
    return y


# --- assignment and multi-object scores

def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Optimal pairs of a rectangular cost matrix, by shortest augmenting paths (O(n^2 m)); infinite cost: never."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    if not n:
        return []
    big = 1 + 2 * (np.abs(c[np.isfinite(c)]).sum() if np.isfinite(c).any() else 1.0)
    c = np.where(np.isfinite(c), c, big)
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            cur = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = cur < least[free]
            least[free[better]], way[free[better]] = cur[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    pairs = [(i, j) for i, j in pairs if c[i, j] < big]
    return sorted((j, i) for i, j in pairs) if flip else sorted(pairs)


def matched_frames(truth: list[np.ndarray], guess: list[np.ndarray], gate: float) -> list[list[tuple[int, int, float]]]:
    """Per frame: most pairs within the gate, then least total distance."""
    out = []
    for a, b in zip(truth, guess):
        d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)) if len(a) and len(b) else np.zeros((len(a), len(b)))
        cost = np.where(d <= gate, d - (gate + 1) * (min(d.shape) + 1 if d.size else 1), np.inf)
        out.append([(i, j, float(d[i, j])) for i, j in assignment(cost)])
    return out


def matched_rows(truth: np.ndarray, guess: np.ndarray, frame: np.ndarray, x: np.ndarray, gate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`matched_frames` of many frames: rows of truth and guess (both sorted by ``frame``) that are pairs, and their distances.

    Pairs within the gate of which neither row has another partner stand; only frames with others are assigned.
    """
    low = np.searchsorted(frame[guess], frame[truth], "left")
    i, j, k = np.arange(len(truth)), low, 0
    parts = []
    while len(i := i[low[i] + k < len(guess)]) and len(i := i[frame[guess[low[i] + k]] == frame[truth[i]]]):
        j = low[i] + k
        d = np.sqrt(((x[truth[i]] - x[guess[j]]) ** 2).sum(1))
        ok = d <= gate
        parts.append((i[ok], j[ok], d[ok]))
        k += 1
    i, j, d = (np.concatenate([q[c] for q in parts] or [np.zeros(0, int)]) for c in range(3))
    shared = (np.bincount(i, minlength=len(truth))[i] > 1) | (np.bincount(j, minlength=len(guess))[j] > 1)
    hard = np.unique(frame[truth[i[shared]]])
    easy = ~np.isin(frame[truth[i]], hard)
    out = [(truth[i[easy]], guess[j[easy]], d[easy])]
    cut = [(np.searchsorted(frame[r], hard, "left"), np.searchsorted(frame[r], hard, "right")) for r in (truth, guess)]
    for a0, a1, b0, b1 in zip(*[c.tolist() for side in cut for c in side]):
        a, b = truth[a0:a1], guess[b0:b1]
        got = matched_frames([x[a]], [x[b]], gate)[0]
        out.append((a[[g[0] for g in got]], b[[g[1] for g in got]], np.array([g[2] for g in got])))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))  # type: ignore[return-value]


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Boxes (left, top, width, height)."""
    lo = np.maximum(a[:, None, :2], b[None, :, :2])
    hi = np.minimum(a[:, None, :2] + a[:, None, 2:], b[None, :, :2] + b[None, :, 2:])
    both = np.prod(np.maximum(hi - lo, 0), -1)
    total = a[:, None, 2] * a[:, None, 3] + b[None, :, 2] * b[None, :, 3] - both
    return np.where(total > 0, both / np.where(total > 0, total, 1), 0.0)


def hota(ids_t: list[np.ndarray], ids_p: list[np.ndarray], ious: list[np.ndarray]) -> dict[str, float]:
    """HOTA over 19 thresholds (Luiten et al., 2021), CLEAR and identity scores at 0.5."""
    alphas = np.arange(0.05, 0.99, 0.05)
    nt, np_ = sum(map(len, ids_t)), sum(map(len, ids_p))
    all_t, all_p = sorted({x for f in ids_t for x in f}), sorted({x for f in ids_p for x in f})
    at, ap = {x: i for i, x in enumerate(all_t)}, {x: i for i, x in enumerate(all_p)}
    if not nt or not np_:
        zero = 1.0 if nt == np_ else 0.0
        return {"hota": zero, "det_a": zero, "ass_a": zero, "mota": 1.0 if not nt and not np_ else (0.0 - np_ / nt if nt else 0.0), "idf1": zero, "id_switches": 0, "tp": 0, "fp": np_, "fn": nt}
    potential, ct, cp = np.zeros((len(all_t), len(all_p))), np.zeros(len(all_t)), np.zeros(len(all_p))
    frames = [(np.array([at[x] for x in t], int), np.array([ap[x] for x in p], int), s) for t, p, s in zip(ids_t, ids_p, ious)]
    for t, p, s in frames:
        np.add.at(ct, t, 1)
        np.add.at(cp, p, 1)
        if s.size:
            den = s.sum(0)[None, :] + s.sum(1)[:, None] - s
            potential[np.ix_(t, p)] += np.where(den > 1e-12, s / np.where(den > 1e-12, den, 1), 0)
    jaccard = potential / (ct[:, None] + cp[None, :] - potential)
    tp, hits = np.zeros(len(alphas)), np.zeros((len(alphas), len(all_t), len(all_p)))
    for t, p, s in frames:
        if not s.size:
            continue
        pairs = assignment(-(jaccard[np.ix_(t, p)] * s))
        for i, j in pairs:
            ok = s[i, j] >= alphas - 1e-9
            tp += ok
            hits[:, t[i], p[j]] += ok
    fn, fp = nt - tp, np_ - tp
    den = np.maximum(1, ct[None, :, None] + cp[None, None, :] - hits)
    ass = (hits * (hits / den)).sum((1, 2)) / np.maximum(1, tp)
    det = tp / np.maximum(1, tp + fn + fp)
    # CLEAR at 0.5, with matches carried over from the previous frame first
    last: dict[int, int] = {}
    tps = switches = 0
    overlap = np.zeros((len(all_t), len(all_p)))
    for t, p, s in frames:
        if s.size:
            overlap[np.ix_(t, p)] += s >= 0.5 - 1e-9
            carried = np.array([[1000.0 if last.get(a) == b else 0.0 for b in p] for a in t])
            cost = np.where(s >= 0.5 - 1e-9, -(s + carried), np.inf)
            for i, j in assignment(cost):
                tps += 1
                if last.get(t[i], p[j]) != p[j]:
                    switches += 1
                last[t[i]] = p[j]
    idtp = sum(overlap[i, j] for i, j in assignment(-overlap))
    return {
        "hota": float(np.sqrt(det * ass).mean()),
        "det_a": float(det.mean()),
        "ass_a": float(ass.mean()),
        "mota": 1 - (nt - tps + np_ - tps + switches) / nt,
        "idf1": 2 * idtp / (nt + np_),
        "id_switches": switches,
        "tp": tps,
        "fp": np_ - tps,
        "fn": nt - tps,
    }



def spatial_nms(xyz: np.ndarray, score: np.ndarray, radius: float, most: int) -> list[int]:
    """Greedy selection by score: a row within the radius of a kept one goes; ties go to the first."""
    kept: list[int] = []
    for i in np.argsort(-score, kind="stable"):
        if len(kept) >= most:
            break
        if all(((xyz[i] - xyz[j]) ** 2).sum() > radius**2 for j in kept):
            kept.append(int(i))
    return kept
