"""Association of candidates with targets: policies and blends as expressions, paths and filters as kernels per sequence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from . import paths as P
from .sequence import AXES, ID, MANY, _each, _frame_rows, _numbers, _with, streamed

FRAME = ["sequence_id", "time_s"]

#: Thresholds of the update policy.
POLICY = {
    "soften_nis": 16.0, "skip_nis": 36.0, "anchor_soften_nis": 16.0, "anchor_skip_nis": 25.0, "entropy_soften": 1.0, "entropy_defer": 1.35,
    "effective_candidates_soften": 2.0, "effective_candidates_defer": 3.0, "recovery_miss_streak": 2.0, "max_covariance_scale": 25.0,
}


def update_policy(df: DataFrame, policy: dict[str, float] | None = None) -> DataFrame:
    """apply, soften (with a covariance scale), defer or skip, with reasons, from nis, anchor_nis, entropy, effective and miss_streak (nulls say nothing)."""
    p = POLICY | (policy or {})
    terms = [("nis", "skip_nis", "soften_nis"), ("anchor_nis", "anchor_skip_nis", "anchor_soften_nis"), ("entropy", "entropy_defer", "entropy_soften"), ("effective", "effective_candidates_defer", "effective_candidates_soften")]
    over = lambda c, limit: F.coalesce(F.col(c) >= p[limit], F.lit(False))
    severe = [(c, hard) for c, hard, _ in terms]
    mild = [(c, soft) for c, _, soft in terms]
    any_of = lambda pairs: F.greatest(*[over(c, limit).cast("int") for c, limit in pairs]) == 1
    why = lambda pairs: F.array_join(F.array_compact(F.array(*[F.when(over(c, limit), f"{c}>={p[limit]:g}") for c, limit in pairs])), ";")
    scales = [F.when(over(c, limit), F.col(c) / p[limit] + (1.0 if c == "entropy" else 0.0)) for c, limit in mild]
    scale = F.least(F.greatest(*scales, F.lit(1.0)), F.lit(p["max_covariance_scale"]))
    return df.withColumns({
        "action": F.when(any_of(severe), F.when(F.coalesce("miss_streak", F.lit(0)) >= p["recovery_miss_streak"], "defer").otherwise("skip")).when(any_of(mild), "soften").otherwise("apply"),
        "covariance_scale": F.when(~any_of(severe) & any_of(mild), scale).otherwise(F.lit(1.0)),
        "reason": F.when(any_of(severe), why(severe)).when(any_of(mild), why(mild)).otherwise("nominal"),
    })


def association_features(df: DataFrame, current_track: Column | None = None) -> DataFrame:
    """Candidates with nis, residual columns and cat_prob_uav, per frame: logs, norms, rank of the NIS with ties averaged, margins, missing flags, track change."""
    frame = Window.partitionBy(*FRAME)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*FRAME, "nis"))
    nis = F.greatest(F.col("nis"), F.lit(0.0))
    norm = lambda names: F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)))
    out = {
        "log_nis": F.log1p(nis),
        "sqrt_nis": F.sqrt(nis),
        "residual_xy": norm(["rx", "ry"]),
        "residual_xyz": norm(["rx", "ry", "rz"]),
        "nis_rank": F.rank().over(frame.orderBy("nis")) + (ties - 1) / 2.0,
        "nis_margin": F.col("nis") - F.min("nis").over(frame),
        "frame_n": F.count(F.lit(1)).over(frame),
        "prob": F.coalesce("prob", F.lit(0.0)),
        "prob_missing": F.col("prob").isNull().cast("double"),
        "log_range": F.log1p(F.greatest(F.coalesce("range_m", F.lit(0.0)), F.lit(0.0))),
        "range_missing": F.col("range_m").isNull().cast("double"),
        "track_change": (~F.col("track").eqNullSafe(current_track)).cast("double") if current_track is not None else F.lit(0.0),
    }
    return df.withColumns(out)


def blended_posteriors(df: DataFrame, local: str, pair: str, least: float = 0.0, most: float = 1.0, power: float = 1.0, agreement_power: float = 1.0, epsilon: float = 1e-12) -> DataFrame:
    """Two posteriors of each frame's candidates, blended in the logarithm: the pair's weight grows with its confidence
    (one less its normalised entropy) and with their agreement (one less the normalised Jensen-Shannon divergence)."""
    frame = Window.partitionBy(*FRAME)
    n = F.count(F.lit(1)).over(frame)
    d = df.withColumn("_p", F.col(local) / F.sum(local).over(frame)).withColumn("_q", F.col(pair) / F.sum(pair).over(frame)).withColumn("_n", n)
    log = lambda c: F.log(F.greatest(c, F.lit(epsilon)))
    p, q = F.col("_p"), F.col("_q")
    m = (p + q) / 2
    entropy = -F.sum(q * log(q)).over(frame)
    js = F.sum(0.5 * p * (log(p) - log(m)) + 0.5 * q * (log(q) - log(m))).over(frame)
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    d = d.withColumn("_c", clip(1 - F.when(F.col("_n") > 1, entropy / F.log(F.col("_n").cast("double"))).otherwise(0.0))).withColumn("_a", clip(1 - js / F.log(F.lit(2.0))))
    w = least + (most - least) * clip(F.pow("_c", F.lit(power)) * F.pow("_a", F.lit(agreement_power)))
    d = d.withColumn("pair_weight", w).withColumn("_l", (1 - F.col("pair_weight")) * log(p) + F.col("pair_weight") * log(q))
    e = F.exp(F.col("_l") - F.max("_l").over(frame))
    return d.withColumn("_e", e).withColumn("posterior", F.col("_e") / F.sum("_e").over(frame)).drop("_p", "_q", "_n", "_c", "_a", "_l", "_e")


def adaptive_scale(ratio: Column, exponent: float = 0.5, least: float = 0.25, most: float = 4.0) -> Column:
    """Process noise scale from the ratio of observed to expected NIS: a bounded power."""
    return F.least(F.greatest(F.pow(F.greatest(ratio, F.lit(1e-12)), F.lit(exponent)), F.lit(least)), F.lit(most))


def delayed_hypotheses(df: DataFrame, window_s: float, most: int, position_std: float = 50.0, velocity_std: float = 15.0) -> DataFrame:
    """Starting hypotheses of each sequence: its best candidates of the first ``window_s`` seconds, with prior deviations."""
    first = F.min("time_s").over(Window.partitionBy("sequence_id"))
    d = df.withColumn("_t0", first).where(F.col("time_s") <= F.col("_t0") + window_s)
    w = Window.partitionBy("sequence_id").orderBy(F.col("score").desc(), "time_s", "key")
    d = d.withColumn("hypothesis", F.row_number().over(w)).where(F.col("hypothesis") <= most).drop("_t0")
    return d.withColumn("position_std_m", F.lit(position_std)).withColumn("velocity_std_mps", F.lit(velocity_std))


def _frames(p: pa.Table, s: slice, frames: np.ndarray, first: int, last: int, score: np.ndarray, x: np.ndarray, t: np.ndarray):
    """Bounds, times, positions and scores of a sequence's frames."""
    cut = [slice(int(a), int(b)) for a, b in zip(frames[first:last], [*frames[first + 1 : last], s.stop])]
    return cut, t[frames[first:last]], [x[c] for c in cut], [score[c] for c in cut]


def _by_sequence(p: pa.Table, starts: np.ndarray, score: str, scale: float):
    t, x, v = _numbers(p, "time_s"), _numbers(p, *AXES), _numbers(p, score) / scale
    frames, first = _frame_rows(p, starts)
    for s, a, b in zip(_each(starts, len(t)), first.tolist(), [*first[1:].tolist(), len(frames)]):
        yield s, *_frames(p, s, frames, a, b, v, x, t)


def _kind(df: DataFrame) -> str:
    return f"sequence_id string, time_s double, key {df.schema['key'].dataType.simpleString()}"


def _picked(df: DataFrame, score: str, scale: float, choose, extra: str = "") -> DataFrame:
    """Rows that choose(times, frames, scores) -> index per frame (-1: none) picks."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        rows = [c.start + j for _, cut, *seq in _by_sequence(p, starts, score, scale) for c, j in zip(cut, choose(*seq)) if j >= 0]
        return p.select(ID).take(pa.array(rows, pa.int64()))

    return streamed(df, ["sequence_id"], ["time_s", "key"], _kind(df), kernel)


def top_k_paths(df: DataFrame, score: str, scale: float, speed: float, k: int, miss: float, most_misses: int = 3) -> DataFrame:
    """The k best paths of every sequence: (sequence_id, time_s, key, path, path_score)."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        frames, first = _frame_rows(p, starts)
        rows, number, value = P.top_paths_many(_numbers(p, "time_s"), _numbers(p, *AXES), _numbers(p, score) / scale, frames, first, speed, k, miss, most_misses)
        return _with(p.take(pa.array(rows, pa.int64())), ID, path=pa.array(number, pa.int64()), path_score=pa.array(value, pa.float64()))

    return streamed(df.select(*ID, *AXES, score), ["sequence_id"], ["time_s", "key"], f"{_kind(df)}, path long, path_score double", kernel, MANY)


def fixed_lag_path(df: DataFrame, score: str, scale: float, speed: float, lag_s: float, miss: float) -> DataFrame:
    return _picked(df, score, scale, lambda t, x, s: P.fixed_lag_path(t, x, s, speed, lag_s, miss))


def alternating_path(df: DataFrame, score: str, scale: float, gate: float, weight: float, rounds: int = 3) -> DataFrame:
    """Association and smoothing by coordinate descent."""
    return _picked(df, score, scale, lambda t, x, s: P.alternate(t, x, s, gate, weight, rounds)[0])


def pair_prior(df: DataFrame, score: str, scale: float, speed: float, accel: float) -> DataFrame:
    """Posterior of each candidate under pairs of neighbouring candidates."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        out = [q for _, _, *seq in _by_sequence(p, starts, score, scale) for q in P.pair_forward_backward(*seq, speed, accel)]
        return _with(p, ID, posterior=np.concatenate(out))

    return streamed(df, ["sequence_id"], ["time_s", "key"], f"{_kind(df)}, posterior double", kernel)


TRACK = "sequence_id string, time_s double, key {}, state_x_m double, state_y_m double, state_z_m double, nis double, updated boolean"


def _tracked(df: DataFrame, score: str, scale: float, run) -> DataFrame:
    """One row per frame from run(times, frames, scores, rows) -> (choice, positions, NIS); the key is that of the chosen candidate, null where it coasts."""
    kind = df.schema["key"].dataType.simpleString()

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        rows, parts, heads = [], [], []
        for _, cut, *seq in _by_sequence(p, starts, score, scale):
            choice, state, nis = run(*seq, cut, p)
            rows += [c.start + int(j) if j >= 0 else None for c, j in zip(cut, choice)]
            heads += [c.start for c in cut]
            parts.append((state, nis, choice >= 0))
        state, nis, used = (np.concatenate([q[i] for q in parts]) for i in range(3))
        out = p.select(["sequence_id", "time_s"]).take(pa.array(heads)).append_column("key", p.column("key").take(pa.array(rows, pa.int64())))
        for i, a in enumerate(AXES):
            out = out.append_column(f"state_{a}", pa.array(state[:, i]))
        return out.append_column("nis", pa.array(nis, mask=np.isnan(nis))).append_column("updated", pa.array(used))

    return streamed(df, ["sequence_id"], ["time_s", "key"], TRACK.format(kind), kernel)


def associated_track(df: DataFrame, score: str, scale: float, mode: str, std_m: float, accel_std: float, gate_probability: float = 0.99, track: str | None = None, weight: float = 1.0, switch: float = 4.0) -> DataFrame:
    """A filter that picks its candidates: ``mode`` is one of score, nis, score-nis, continuity (needs ``track``), pda."""
    gate = K.chi2_quantile(gate_probability, 3)

    def run(t, x, s, cut, p):
        names = [p.column(track)[c.start : c.stop].to_numpy() for c in cut] if track else None
        return P.associate(t, x, s, mode, std_m, accel_std, gate, names, weight, switch)

    return _tracked(df, score, scale, run)


def hypothesis_track(df: DataFrame, score: str, scale: float, std_m: float, accel_std: float, gate_probability: float = 0.99, beam: int = 8, branch: int = 3, miss: float = 4.0) -> DataFrame:
    """The best of a bounded bank of hypotheses."""
    gate = K.chi2_quantile(gate_probability, 3)

    def run(t, x, s, cut, p):
        choice, state = P.hypothesis_bank(t, x, s, std_m, accel_std, gate, beam, branch, miss)
        return choice, state, np.full(len(choice), np.nan)

    return _tracked(df, score, scale, run)


def path_then_filter(df: DataFrame, score: str, scale: float, std_m: float, accel_std: float, speed: float, mode: str = "viterbi", track: str = "source") -> DataFrame:
    """A path of candidates (Viterbi, or the best-scoring track seen at two times or more, else the best of each frame), then a filter along it."""
    from .sequence import cv_track, viterbi_path

    if mode == "viterbi":
        picked = df.join(viterbi_path(df, score, scale, speed).select("sequence_id", "key"), ["sequence_id", "key"], "left_semi")
    else:
        g = df.groupBy("sequence_id", track).agg(F.countDistinct("time_s").alias("_n"), F.sum(score).alias("_s")).where("_n >= 2")
        best = g.groupBy("sequence_id").agg(F.max_by(track, F.struct("_s", track)).alias("_best"))
        d = df.join(best, "sequence_id", "left").where(F.col("_best").isNull() | (F.col(track) == F.col("_best")))
        w = Window.partitionBy(*FRAME).orderBy(F.col(score).desc(), "key")
        picked = d.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_best")
    return cv_track(picked, AXES, std_m, accel_std)


def multi_object_tracks(df: DataFrame, std_m: float, accel_std: float, gate_m: float, most_age_s: float = 1.5, least_hits: int = 1) -> DataFrame:
    """Candidates with the number of the target they belong to; those of targets with too few hits go."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        out = [g for _, _, t, x, _ in _by_sequence(p, starts, "score", 1.0) for g in P.born_and_aged(t, x, std_m, accel_std, gate_m, most_age_s, least_hits)]
        label = np.concatenate(out)
        return _with(p, ID, target=label).filter(pa.array(label >= 0))

    return streamed(df, ["sequence_id"], ["time_s", "key"], f"{_kind(df)}, target long", kernel)


def tracklets(df: DataFrame, track: str, most_gap: float, score: str = "score") -> DataFrame:
    """Segments of each track without long gaps: ends, positions at the ends, rows and summed score."""
    from .windows import segments

    d = segments(df, ["sequence_id", track], ["time_s", "key"], most_gap)
    at = F.struct("time_s", "key")
    ends = [f(F.col(a), at).alias(f"{name}_{a}") for name, f in (("head", F.min_by), ("tail", F.max_by)) for a in AXES]
    return d.groupBy("sequence_id", track, "segment").agg(F.count(F.lit(1)).alias("rows"), F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"), F.sum(score).alias("score"), *ends)


def _chains(df: DataFrame, track: str, choose) -> DataFrame:
    """(sequence_id, track, segment, chain) of the chains that choose(...) gives for each sequence's tracklets."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        start, end, score, rows = (_numbers(p, c) for c in ("start_s", "end_s", "score", "rows"))
        head, tail = (_numbers(p, *[f"{e}_{a}" for a in AXES]) for e in ("head", "tail"))
        parts = [(s.start, choose(start[s], end[s], head[s], tail[s], score[s], rows[s])) for s in _each(starts, len(start))]
        got = [(first + n, k) for first, chains in parts for k, chain in enumerate(chains, 1) for n in chain]
        out = p.select(["sequence_id", track, "segment"]).take(pa.array([g for g, _ in got], pa.int64()))
        return out.append_column("chain", pa.array([k for _, k in got], pa.int64()))

    kind = df.schema["segment"].dataType.simpleString()
    return streamed(df, ["sequence_id"], ["start_s", track, "segment"], f"sequence_id string, {track} string, segment {kind}, chain long", kernel)


def beam_chains(tracklet_table: DataFrame, track: str, speed: float, gap_cost: float, k: int, beam: int = 64) -> DataFrame:
    """The k best chains of tracklets by beam search."""
    return _chains(tracklet_table, track, lambda a, b, h, t, v, n: [c for _, c in P.beam_paths(a, b, h, t, v, speed, gap_cost, k, beam)])


def stitched_segments(tracklet_table: DataFrame, track: str, speed: float, least_rows: int = 1) -> DataFrame:
    """The chain of most rows whose joins keep the speed limit."""
    return _chains(tracklet_table.where(F.col("rows") >= least_rows), track, lambda a, b, h, t, v, n: [P.stitched(a, b, h, t, n, speed)])


def segment_source_gate(df: DataFrame, switch: float, label: str = "source", cost: str = "cost") -> DataFrame:
    """Inputs (sequence_id, time_s, key, label, cost): the cheapest choice of one input per time, where a change costs ``switch``."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        names = p.column(label).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        value, t = _numbers(p, cost), _numbers(p, "time_s")
        frames, first = _frame_rows(p, starts)
        rows: list[int] = []
        for s, a, b in zip(_each(starts, len(t)), first.tolist(), [*first[1:].tolist(), len(frames)]):
            cut = [slice(int(x), int(y)) for x, y in zip(frames[a:b], [*frames[a + 1 : b], s.stop])]
            best, back = value[cut[0]], []
            for x, y in zip(cut, cut[1:]):
                total = best[:, None] + switch * (names[x][:, None] != names[y][None, :])
                back.append(total.argmin(0))
                best = total.min(0) + value[y]
            at = [int(best.argmin())]
            for step in reversed(back):
                at.append(int(step[at[-1]]))
            rows += [c.start + j for c, j in zip(cut, reversed(at))]
        return p.select([*ID, label]).take(pa.array(rows, pa.int64()))

    return streamed(df, ["sequence_id"], ["time_s", label, "key"], f"{_kind(df)}, {label} string", kernel)


def _mixtures(p: pa.Table, starts: np.ndarray, scores: list[np.ndarray], smoothness: float, sigma: str, rounds: int, huber: float, balance: float, floor: float):
    """Of each score: rows of the frames' dominant candidates, states, effective counts; objectives and rounds by sequence.  And the frames' first rows and sequences."""
    t, x, s = _numbers(p, "time_s"), _numbers(p, *AXES), _numbers(p, sigma)
    labels = [p.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(int) for c in ("candidate_branch", "source") if balance > 0]
    frames, first = _frame_rows(p, starts)
    n = len(frames)
    f = np.searchsorted(frames, np.arange(len(t)), "right") - 1
    runs = []
    for v in scores:
        state, w, objective, done = P.mixture_map_many(t[frames], first, x, s, v, f, smoothness, rounds, labels=tuple(labels), balance=balance, huber=huber, floor=floor)
        chosen = np.lexsort((np.arange(len(f)), -w, f))[frames]  # rows are sorted by frame, so a frame's first place is its first row's
        entropy = -np.bincount(f, w * np.log(np.maximum(w, 1e-300)), n)
        runs.append((chosen, state, np.exp(entropy), objective, done))
    return runs, frames, np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))


def _mixture_rows(p: pa.Table, names: list[str], frames: np.ndarray, number: np.ndarray, run) -> pa.Table:
    chosen, state, count, objective, done = run
    out = p.select([*names, "time_s"]).take(pa.array(frames)).append_column("key", p.column("key").take(pa.array(chosen)))
    for i, axis in enumerate(AXES):
        out = out.append_column(f"state_{axis}", pa.array(state[:, i]))
    return out.append_column("effective_n", pa.array(count)).append_column("objective", pa.array(objective[number])).append_column("iterations", pa.array(done[number].astype(np.int64)))


def _mixture_schema(df: DataFrame, more: str = "") -> str:
    kind = df.schema["key"].dataType.simpleString()
    return f"sequence_id string{more}, time_s double, key {kind}, state_x_m double, state_y_m double, state_z_m double, effective_n double, objective double, iterations long"


def mixture_map(df: DataFrame, smoothness: float, sigma: str = "sigma_m", score: str = "score", scale: float = 1.0, rounds: int = 5, huber: float = 3.0, balance: float = 0.0, floor: float = 0.0, by: str | None = None) -> DataFrame:
    """One smooth trajectory per sequence through mixtures of candidates: a row per frame with position, dominant candidate, effective count and the sequence's objective.

    ``by`` names a further key (restart, pool): its runs are independent.
    """
    keys = ["sequence_id", *([by] if by else [])]

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        (run,), frames, number = _mixtures(p, starts, [_numbers(p, score) / scale], smoothness, sigma, rounds, huber, balance, floor)
        return _mixture_rows(p, keys, frames, number, run)

    return streamed(df, keys, ["time_s", "key"], _mixture_schema(df, f", {by} string" if by else ""), kernel, MANY)


def mixture_restarts(df: DataFrame, smoothness: float, restarts: dict[str, Column], per_sequence: bool = True, **options) -> DataFrame:
    """Mixture trajectories from several starts (a score column each); the run of least objective stays, per sequence or for all sequences together."""
    score = options.pop("score", "score")
    if not per_sequence:
        runs = F.explode(F.array(*[F.struct(F.lit(n).alias("restart"), c.cast("double").alias("_score")) for n, c in restarts.items()])).alias("_r")
        d = df.select(*[c for c in df.columns if c != score], runs).select(*[c for c in df.columns if c != score], "_r.restart", F.col("_r._score").alias(score))
        return _least(mixture_map(d, smoothness, score=score, by="restart", **options), "restart", False)
    names = sorted(restarts)  # ties go to the first name
    o = {"sigma": "sigma_m", "rounds": 5, "huber": 3.0, "balance": 0.0, "floor": 0.0} | options
    scale = o.pop("scale", 1.0)

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        runs, frames, number = _mixtures(p, starts, [_numbers(p, f"_score{k}") / scale for k in range(len(names))], smoothness, **o)
        size = np.bincount(number, minlength=len(starts))
        value = np.stack([r[3] / size for r in runs])
        best = np.where(np.isnan(value), np.inf, value).argmin(0)
        pick = lambda i, at: np.stack([r[i] for r in runs])[best[at], np.arange(len(at))]
        run = (*(pick(i, number) for i in range(3)), *(pick(i, np.arange(len(starts))) for i in (3, 4)))
        return _mixture_rows(p, ["sequence_id"], frames, number, run).append_column("restart", pa.array(np.array(names, object)[best[number]], pa.string()))

    labels = ["candidate_branch", "source"] if o["balance"] > 0 else []
    d = df.select(*ID, *AXES, o["sigma"], *labels, *[restarts[n].cast("double").alias(f"_score{k}") for k, n in enumerate(names)])
    return streamed(d, ["sequence_id"], ["time_s", "key"], _mixture_schema(df, ", restart string"), kernel, MANY)


def pool_selector(df: DataFrame, smoothness: float, pool: str, **options) -> DataFrame:
    """Mixture trajectories of several candidate pools; each sequence keeps the pool of least objective per frame."""
    return _least(mixture_map(df, smoothness, by=pool, **options), pool, True)


def _least(runs: DataFrame, by: str, per_sequence: bool) -> DataFrame:
    keys = ["sequence_id"] if per_sequence else []
    g = runs.groupBy("sequence_id", by).agg(F.first("objective").alias("_o"), F.count(F.lit(1)).alias("_n"))
    g = g.groupBy(*keys, by).agg((F.sum("_o") / F.sum("_n")).alias("_o"))
    best = g.groupBy(*keys).agg(F.min_by(by, F.struct("_o", by)).alias(by))
    return runs.join(best, [*keys, by], "left_semi")
