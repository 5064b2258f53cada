"""Kernels over whole sequences: rows are dealt by sequence, sorted, and stream through Arrow batches.

A batch holds many sequences; a kernel takes all of them at once and works along their
steps, vectorised over sequences.  A sequence that crosses batches is held until it is whole,
so a task's memory grows with its longest sequence, not with its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

AXES = ["x_m", "y_m", "z_m"]
#: Rows of a call of a kernel whose steps cost the same for one sequence and for many.
MANY = 50_000


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the runs of equal keys (null equals null)."""
    new = np.zeros(table.num_rows, bool)
    if table.num_rows:
        new[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def streamed(df: DataFrame, keys: list[str], order: list[str], schema: str, kernel: Callable[[pa.Table, np.ndarray], pa.Table], many: int = 0) -> DataFrame:
    """kernel(table, first rows of its sequences) over whole sequences, sorted; it gives the columns of ``schema``.

    Batches are put together until a call has ``many`` rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    made = to_arrow_schema(kind)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some: list[pa.RecordBatch] = []
            for b in batches:
                if b.num_rows:
                    some.append(b)
                if some and sum(s.num_rows for s in some) >= many:
                    yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
                    some = []
            if some:
                yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]

        def done(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(parts).combine_chunks()
            out = kernel(table, starts_of(table, keys))
            yield from out.select(made.names).cast(made).to_batches()

        for b in joined(batches):
            table = pa.Table.from_batches([b])
            cut = int(starts_of(table, keys)[-1])
            if held and cut == 0 and len(starts_of(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table.slice(0, 1)]), keys)) == 1:
                held.append(table)  # still the same sequence
                continue
            if held or cut:
                yield from done([*held, table.slice(0, cut)])
            held = [table.slice(cut)]
        if held:
            yield from done(held)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(go, kind)


def _numbers(table: pa.Table, *names: str) -> np.ndarray:
    """Columns as one array of doubles, a null as NaN."""
    return np.stack([table.column(n).cast(pa.float64()).to_numpy() for n in names], 1) if len(names) > 1 else table.column(names[0]).cast(pa.float64()).to_numpy()


def _with(table: pa.Table, names: list[str], **columns) -> pa.Table:
    out = table.select(names)
    for name, values in columns.items():
        out = out.append_column(name, values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values))
    return out


def _each(starts: np.ndarray, n: int) -> Iterator[slice]:
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n]):
        yield slice(a, b)


ID = ["sequence_id", "time_s", "key"]


def _id_schema(df: DataFrame) -> str:
    return f"sequence_id string, time_s double, key {df.schema['key'].dataType.simpleString()}"


def cv_track(df: DataFrame, axes: list[str], std_m: float, accel_std: float, gate_probability: float | None = None, smooth: bool = False, robust: str = "none") -> DataFrame:
    """(sequence_id, time_s, key, axes) -> filtered or smoothed positions, NIS and decision per row."""
    gate = K.chi2_quantile(gate_probability, len(axes)) if gate_probability else None

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        t, z = _numbers(p, "time_s"), _numbers(p, *axes).reshape(p.num_rows, len(axes))
        got = K.cv_filter_many(t, z, starts, std_m, accel_std, gate, robust=robust)
        mean = K.rts_many(t, got, starts, accel_std) if smooth else got["position"]
        return _with(p, ID, **{f"state_{a}": mean[:, i] for i, a in enumerate(axes)}, nis=got["nis"], accepted=got["accepted"])

    state = ", ".join(f"state_{a} double" for a in axes)
    return streamed(df, ["sequence_id"], ["time_s", "key"], f"{_id_schema(df)}, {state}, nis double, accepted boolean", kernel)


def imm_track(df: DataFrame, axes: list[str], std_m: float, accels: tuple = (1.0, 4.0, 12.0), turns: tuple = ()) -> DataFrame:
    """Interacting constant-velocity modes, and constant-turn modes (rates in rad/s, needs two axes or more)."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        t, z = _numbers(p, "time_s"), _numbers(p, *axes).reshape(p.num_rows, len(axes))
        mean, weight = np.empty((len(t), 2 * len(axes))), np.empty((len(t), len(accels) + len(turns)))
        for s in _each(starts, len(t)):
            got = K.imm_filter(t[s], z[s], np.full(s.stop - s.start, std_m), accels, turns=turns)
            mean[s], weight[s] = got["mean"], got["weight"]
        return _with(p, ID, **{f"state_{a}": mean[:, i] for i, a in enumerate(axes)}, mode=weight.argmax(1), mode_weight=weight.max(1))

    state = ", ".join(f"state_{a} double" for a in axes)
    return streamed(df, ["sequence_id"], ["time_s", "key"], f"{_id_schema(df)}, {state}, mode long, mode_weight double", kernel)


def _frame_rows(p: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the frames (equal sequence and time), and each sequence's first frame."""
    t = _numbers(p, "time_s")
    new = np.zeros(len(t), bool)
    new[starts] = True
    new[1:] |= t[1:] != t[:-1]
    frames = np.flatnonzero(new)
    return frames, np.searchsorted(frames, starts)


def viterbi_path(df: DataFrame, score: str, scale: float, speed: float) -> DataFrame:
    """The best path's candidate of every frame."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        frames, first = _frame_rows(p, starts)
        rows = K.viterbi_many(_numbers(p, "time_s"), _numbers(p, *AXES), _numbers(p, score) / scale, frames, first, speed)
        return p.select(ID).take(pa.array(rows))

    return streamed(df, ["sequence_id"], ["time_s", "key"], "sequence_id string, time_s double, key string", kernel)


def forward_backward_prior(df: DataFrame, score: str, scale: float, speed: float, switch: float = 0.0, source: str | None = None) -> DataFrame:
    """Posterior of every candidate along its sequence; ``switch`` is a penalty (log) for changing the source."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        frames, first = _frame_rows(p, starts)
        kind = p.column(source).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if source else None
        return _with(p, ID, posterior=K.forward_backward_many(_numbers(p, "time_s"), _numbers(p, *AXES), _numbers(p, score) / scale, frames, first, speed, kind, switch))

    return streamed(df, ["sequence_id"], ["time_s", "key"], "sequence_id string, time_s double, key string, posterior double", kernel)


def per_sequence(df: DataFrame, axes: list[str], f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """f(times, positions) -> positions, for each sequence."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        t, x = _numbers(p, "time_s"), _numbers(p, *axes).reshape(p.num_rows, len(axes))
        out = np.concatenate([f(t[s], x[s]).reshape(-1, len(axes)) for s in _each(starts, len(t))]) if len(t) else x
        return _with(p, ID, **{a: out[:, i] for i, a in enumerate(axes)})

    return streamed(df, ["sequence_id"], ["time_s", "key"], f"{_id_schema(df)}, " + ", ".join(f"{a} double" for a in axes), kernel)


def speed_limited(df: DataFrame, axes: list[str], most: float) -> DataFrame:
    return per_sequence(df, axes, lambda t, x: K.speed_limit(t, x, most))


def vertical_repair(df: DataFrame, axis: str, most_speed: float, neighbour_speed: float, residual: float, rounds: int = 1) -> DataFrame:
    def f(t: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = x[:, 0]
        for _ in range(rounds):
            new = K.vertical_spikes(t, z, most_speed, neighbour_speed, residual)
            if np.array_equal(new, z):
                break
            z = new
        return z

    return per_sequence(df, [axis], f)


def regularized(df: DataFrame, axes: list[str], weight: float, huber: float) -> DataFrame:
    return per_sequence(df, axes, lambda t, x: K.regularized(t, x, weight, huber))


def jerk_limited(df: DataFrame, axes: list[str], most: float, weight: float = 10.0, least_m: float = 1.0, most_m: float | None = None, rounds: int = 1, blend: float = 1.0) -> DataFrame:
    """Rows whose jerk exceeds the limit move towards the trajectory of least third differences."""
    return per_sequence(df, axes, lambda t, x: K.jerk_limited(t, x, most, weight, least_m, most_m, rounds, blend))


def local_linear(df: DataFrame, axes: list[str], window_s: float = 15.0, blend: float = 1.0, most_m: float = 10.0, least: int = 3) -> DataFrame:
    """Kernel regression of first order in a window around each row; corrections are bounded."""
    return per_sequence(df, axes, lambda t, x: K.local_linear(t, x, window_s, blend, most_m, least))


def robust_map(df: DataFrame, axes: list[str], weight: float, huber: float, lag_s: float | None = None) -> DataFrame:
    """Smoothing by reweighted least squares; with a lag each row sees no further ahead than that."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        t, x = _numbers(p, "time_s"), _numbers(p, *axes).reshape(p.num_rows, len(axes))
        y = K.regularized_many(t, x, starts, weight, huber) if lag_s is None else K.lagged_many(t, x, starts, weight, huber, lag_s)
        return _with(p, ID, **{a: y[:, i] for i, a in enumerate(axes)})

    return streamed(df.select(*ID, *axes), ["sequence_id"], ["time_s", "key"], f"{_id_schema(df)}, " + ", ".join(f"{a} double" for a in axes), kernel, MANY)


def rts_ensemble(df: DataFrame, keys: list[str], axes: list[str], std_m: float, accel_std: float, weight: str = "weight") -> DataFrame:
    """Inputs of one time as their weighted mean, then a filter and its smoother along the sequence."""
    w = F.col(weight)
    mean = df.groupBy(*keys).agg(*[(F.sum(w * F.col(a)) / F.sum(w)).alias(a) for a in axes], F.min("key").alias("key"))
    return cv_track(mean, axes, std_m, accel_std, None, True)


def assigned_support(df: DataFrame, max_gap: float, max_speed: float) -> DataFrame:
    """Per candidate: the partner's distance in the previous and next frame, where candidates of neighbouring frames are paired one to one (most pairs, then least distance)."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        t, x = _numbers(p, "time_s"), _numbers(p, *AXES)
        frames, first = _frame_rows(p, starts)
        ends = np.append(frames[1:], len(t))
        back, ahead = np.full(len(t), np.nan), np.full(len(t), np.nan)
        opens = set(first.tolist())
        for k in range(1, len(frames)):
            dt = t[frames[k]] - t[frames[k - 1]]
            if k in opens or dt > max_gap:
                continue
            a, b = slice(frames[k - 1], ends[k - 1]), slice(frames[k], ends[k])
            for i, j, d in K.matched_frames([x[a]], [x[b]], max_speed * dt)[0]:
                ahead[a.start + i], back[b.start + j] = d, d
        return _with(p, ID, backward_m=pa.array(back, mask=np.isnan(back)), forward_m=pa.array(ahead, mask=np.isnan(ahead)))

    return streamed(df, ["sequence_id"], ["time_s", "key"], f"{_id_schema(df)}, backward_m double, forward_m double", kernel)


def fixed_population(df: DataFrame, seeds: DataFrame, least_iou: float = 0.5, most_gap: int = 1) -> DataFrame:
    """Predicted boxes (sequence_id, frame, id, x, y, w, h) relabelled by the seeds of the first frame; births go, gaps of ``most_gap`` frames are filled on the line."""
    from .paths import fixed_population as relabel

    box = ["x", "y", "w", "h"]

    def kernel(key: str, a: pd.DataFrame, b: pd.DataFrame) -> list[tuple]:
        parts = [g for _, g in a.groupby("frame", sort=True)]
        got = relabel([g[box].to_numpy(float) for g in parts], [g["id"].to_numpy() for g in parts], b[box].to_numpy(float), b["id"].to_numpy(), least_iou)
        rows: list[tuple] = []
        last: dict[int, tuple] = {}
        for g, ids in zip(parts, got):
            for i, values in zip(ids.tolist(), g[["frame", *box]].to_numpy(float)):
                if i < 0:
                    continue
                old = last.get(i)
                if old is not None and 1 < values[0] - old[0] <= most_gap + 1:
                    for f in range(int(old[0]) + 1, int(values[0])):
                        w = (f - old[0]) / (values[0] - old[0])
                        rows.append((key, f, int(i), *(float(o + w * (v - o)) for o, v in zip(old[1:], values[1:])), True))
                rows.append((key, int(values[0]), int(i), *map(float, values[1:]), False))
                last[i] = tuple(values)
        return rows

    columns = ["sequence_id", "frame", "id", *box]
    schema = "sequence_id string, frame long, id long, x double, y double, w double, h double, filled boolean"
    return two_sided(df.select(columns), seeds.select(columns), ["frame", "id"], schema, kernel)


def geometric_median(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        x, w = _numbers(p, *AXES), _numbers(p, weight)
        m = np.array([K.geometric_median(x[s], w[s]) for s in _each(starts, len(w))]).reshape(-1, 3)
        return _with(p.take(pa.array(starts)), keys, **{a: m[:, i] for i, a in enumerate(AXES)})

    return streamed(df, keys, [weight, *AXES], "sequence_id string, time_s double, x_m double, y_m double, z_m double", kernel)


def diversified(df: DataFrame, keys: list[str], score: str, radius: float, most: int) -> DataFrame:
    """Per frame: greedy non-maximum suppression in space."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        x, v = _numbers(p, *AXES), _numbers(p, score)
        rows, picks = [], []
        for s in _each(starts, len(v)):
            keep = K.spatial_nms(x[s], v[s], radius, most)
            rows += [s.start + k for k in keep]
            picks += range(1, len(keep) + 1)
        return _with(p.take(pa.array(rows, pa.int64())), ID, pick=np.array(picks, np.int64))

    return streamed(df, keys, ["key"], "sequence_id string, time_s double, key string, pick long", kernel)


def two_sided(a: DataFrame, b: DataFrame, order: list[str], schema: str, kernel: Callable[[str, pd.DataFrame, pd.DataFrame], list[tuple]]) -> DataFrame:
    """Rows from kernel(sequence, a's rows, b's rows) for each sequence of either table.

    Both sides travel as one sorted table: a cogroup of tables with a common ancestor loses columns when its result is only counted.
    """
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    names = [c.split()[0] for c in schema.split(", ")]

    def go(p: pa.Table, starts: np.ndarray) -> pa.Table:
        rows = []
        for s in _each(starts, p.num_rows):
            one = p.slice(s.start, s.stop - s.start).to_pandas()
            left, right = (one[one["_side"] == k].drop(columns="_side").reset_index(drop=True) for k in (0, 1))
            rows += kernel(one["sequence_id"].iloc[0], left, right)
        return pa.table({n: pa.array([r[i] for r in rows]) for i, n in enumerate(names)})

    return streamed(both, ["sequence_id"], ["_side", *order], schema, go)


def mot_scores(truth: DataFrame, guess: DataFrame, gate: float) -> DataFrame:
    """Truth and estimates (sequence_id, time_s, track, axes) -> matches, misses, false alarms, switches, MOTA per sequence."""
    schema = "sequence_id string, frames long, truth_n long, guess_n long, matches long, misses long, false_alarms long, switches long, mean_distance double, mota double"
    columns = ["sequence_id", "time_s", "track", *AXES]
    both = truth.select(*columns, F.lit(0).alias("_side")).unionByName(guess.select(*columns, F.lit(1).alias("_side")))

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        n, m = p.num_rows, len(starts)
        number = np.searchsorted(starts, np.arange(n), "right") - 1
        t, x, side = _numbers(p, "time_s"), _numbers(p, *AXES), p.column("_side").to_numpy()
        track = p.column("track").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((side, t, number))  # stable: tracks stay sorted
        new = np.ones(n, bool)
        new[1:] = (number[order][1:] != number[order][:-1]) | (t[order][1:] != t[order][:-1])
        frame = np.empty(n, np.int64)
        frame[order] = np.cumsum(new) - 1
        a, b, d = K.matched_rows(order[side[order] == 0], order[side[order] == 1], frame, x, gate)
        at = np.lexsort((a, frame[a], track[a], number[a]))  # a track's matches along its sequence
        a, b, d = a[at], b[at], d[at]
        same = (number[a][1:] == number[a][:-1]) & (track[a][1:] == track[a][:-1])
        count = lambda v: np.bincount(v, minlength=m)
        switches = count(number[a][1:][same & (track[b][1:] != track[b][:-1])])
        frames, truth_n, guess_n, hits = count(number[order][new]), count(number[side == 0]), count(number[side == 1]), count(number[a])
        misses, extra = truth_n - hits, guess_n - hits
        total = np.bincount(number[a], d, m)
        cols = {"frames": frames, "truth_n": truth_n, "guess_n": guess_n, "matches": hits, "misses": misses, "false_alarms": extra, "switches": switches}
        cols |= {"mean_distance": pa.array(total / np.maximum(hits, 1), mask=hits == 0), "mota": pa.array(1 - (misses + extra + switches) / np.maximum(truth_n, 1), mask=truth_n == 0)}
        return _with(p.take(pa.array(starts)), ["sequence_id"], **cols)

    return streamed(both, ["sequence_id"], ["_side", "time_s", "track"], schema, kernel, MANY)


def hota_scores(truth: DataFrame, guess: DataFrame) -> DataFrame:
    """Boxes (sequence_id, frame, id, x, y, w, h) -> HOTA, CLEAR and identity scores per sequence."""
    names = ["hota", "det_a", "ass_a", "mota", "idf1", "id_switches", "tp", "fp", "fn"]
    schema = "sequence_id string, " + ", ".join(f"{n} {'double' if n in names[:5] else 'long'}" for n in names)
    box = ["x", "y", "w", "h"]

    def kernel(key: str, a: pd.DataFrame, b: pd.DataFrame) -> list[tuple]:
        at, bt = dict(list(a.groupby("frame"))), dict(list(b.groupby("frame")))
        frames = sorted(set(at) | set(bt))
        fa, fb = [at.get(t, a.iloc[:0]) for t in frames], [bt.get(t, b.iloc[:0]) for t in frames]
        got = K.hota([x["id"].to_numpy() for x in fa], [x["id"].to_numpy() for x in fb], [K.iou_matrix(x[box].to_numpy(float), y[box].to_numpy(float)) for x, y in zip(fa, fb)])
        return [(key, *(got[n] for n in names))]

    columns = ["sequence_id", "frame", "id", *box]
    return two_sided(truth.select(columns), guess.select(columns), ["frame", "id"], schema, kernel)
