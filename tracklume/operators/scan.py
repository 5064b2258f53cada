"""Constant-velocity filter and smoother as associative scans: a sequence may span many tasks.

A filter step is an element (A, b, C, eta, J), a smoother step an affine map (E, g); both
combine associatively (Sarkka and Garcia-Fernandez, 2021).  So

1. rows are dealt by sequence and time slice (``slices``); only sequences with a large share of all rows
   have several slices;
2. each slice folds its rows into one element;
3. a prefix over a sequence's slices, one element each, gives the state that enters each slice;
4. each slice runs its rows from that state.

Inside a task rows stream through Arrow batches; a batch is scanned by doubling, and only an element
is carried from batch to batch.  No task holds a sequence or a slice.
A gate or a robust loss depends on the state and is no scan; ``sequence.cv_track`` has these.

Rows with a null or NaN time or position are dropped; rows of one time are taken in the order of ``key``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import LEAST, SLICES, carried, sliced, with_carried
from .stored import saved

Element = tuple[np.ndarray, ...]


def _inverse(m: np.ndarray) -> np.ndarray:
    """Of 2 x 2 matrices."""
    a, b, c, d = m[:, 0, 0], m[:, 0, 1], m[:, 1, 0], m[:, 1, 1]
    return np.stack([np.stack([d, -b], 1), np.stack([-c, a], 1)], 1) / (a * d - b * c)[:, None, None]


def _turned(m: np.ndarray) -> np.ndarray:
    return m.transpose(0, 2, 1)


def combine_filter(x: Element, y: Element) -> Element:
    """x before y."""
    a, b, c, eta, j = x
    a2, b2, c2, eta2, j2 = y
    inner = a2 @ _inverse(np.eye(2) + c @ j2)
    outer = _turned(a) @ _inverse(np.eye(2) + j2 @ c)
    return inner @ a, inner @ (b + c @ eta2) + b2, inner @ c @ _turned(a2) + c2, outer @ (eta2 - j2 @ b) + eta, outer @ j2 @ a + j


def combine_smoother(x: Element, y: Element) -> Element:
    """x the later one in time: rows come by falling time."""
    return y[0] @ x[0], y[0] @ x[1] + y[1]


def running(x: Element, first: np.ndarray, combine: Callable[[Element, Element], Element]) -> Element:
    """The combination of each row with all rows before it back to the last ``first`` one, by doubling."""
    segment = np.cumsum(first)
    longest = int(np.bincount(segment).max()) if len(segment) else 0
    d = 1
    while d < longest:
        at = np.flatnonzero(segment[d:] == segment[:-d]) + d
        new = combine(tuple(v[at - d] for v in x), tuple(v[at] for v in x))
        x = tuple(v.copy() for v in x)
        for v, u in zip(x, new):
            v[at] = u
        d *= 2
    return x


def _motion(dt: np.ndarray, accel_std: float) -> tuple[np.ndarray, np.ndarray]:
    f, q = np.zeros((len(dt), 2, 2)), np.empty((len(dt), 2, 2))
    f[:, 0, 0] = f[:, 1, 1] = 1
    f[:, 0, 1] = dt
    q[:, 0, 0], q[:, 1, 1] = dt**3 / 3, dt
    q[:, 0, 1] = q[:, 1, 0] = dt**2 / 2
    return f, q * accel_std**2


def filter_elements(dt: np.ndarray, z: np.ndarray, std: float, accel_std: float, velocity_std: float) -> Element:
    """dt NaN: the row initialises its sequence."""
    n, dims = z.shape
    start = np.isnan(dt)
    f, q = _motion(np.where(start, 0, np.maximum(dt, 0)), accel_std)
    s = q[:, 0, 0] + std**2
    k = q[:, :, 0] / s[:, None]
    keep = np.tile(np.eye(2), (n, 1, 1))
    keep[:, :, 0] -= k
    seen = f[:, 0, :] / s[:, None]  # F' H' / S
    a, b, c = keep @ f, k[:, :, None] * z[:, None, :], keep @ q
    eta, j = seen[:, :, None] * z[:, None, :], seen[:, :, None] * f[:, 0, None, :]
    for v in (a, eta, j):
        v[start] = 0
    b[start, 0], b[start, 1] = z[start], 0
    c[start] = np.diag([std**2, velocity_std**2])
    return a, b, c, eta, j


def smoother_elements(dt: np.ndarray, mean: np.ndarray, cov: np.ndarray, accel_std: float) -> Element:
    """dt to the next row, NaN at the end of a sequence."""
    end = np.isnan(dt)
    f, q = _motion(np.where(end, 0, np.maximum(dt, 0)), accel_std)
    e = cov @ _turned(f) @ _inverse(f @ cov @ _turned(f) + q + 1e-12 * np.eye(2))
    e[end] = 0
    return e, mean - e @ (f @ mean)


def _flat(x: Element) -> pa.Array:
    """One list of numbers for each element."""
    rows = np.concatenate([v.reshape(len(v), -1) for v in x], 1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _shapes(kind: str, dims: int) -> list[tuple]:
    return {"filter": [(2, 2), (2, dims), (2, 2), (2, dims), (2, 2)], "smoother": [(2, 2), (2, dims)]}[kind]


def _unflat(flat: np.ndarray, shapes: list[tuple]) -> Element:
    out, at = [], 0
    for s in shapes:
        out.append(flat[:, at : at + s[0] * s[1]].reshape(-1, *s))
        at += s[0] * s[1]
    return tuple(out)


def _lists(col, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a list, their numbers)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    has = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    return has, col.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(has), width)


def _new(b: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Rows whose keys differ from those of the row before (null equals null), and the last row's keys."""
    first = np.zeros(b.num_rows, bool)
    cols = [b.column(b.schema.get_field_index(k)) for k in keys]
    first[0] = last is None or tuple(c[0].as_py() for c in cols) != last
    for c in cols:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first[1:] |= codes[1:] != codes[:-1]
    return first, tuple(c[-1].as_py() for c in cols)


def _last(x: Element, i: int) -> Element:
    return tuple(v[i : i + 1].copy() for v in x)


class _Scan:
    """What a task carries from batch to batch: the last row's keys, time and element."""

    def __init__(self, kind: str, dims: int, make: Callable, keys: list[str]):
        self.combine = combine_filter if kind == "filter" else combine_smoother
        self.shapes, self.make, self.keys = _shapes(kind, dims), make, keys
        self.kind, self.dims = kind, dims
        self.last, self.time, self.carry = None, np.nan, None

    def step(self, b: pa.RecordBatch):
        """(first rows, elements so far, elements before each row, whether a row has one before it)."""
        t = b.column(b.schema.get_field_index("_t")).to_numpy(zero_copy_only=False)
        first, last = _new(b, self.keys, self.last)
        near = np.concatenate([[self.time], t[:-1]])
        edge = b.column(b.schema.get_field_index("_edge")).cast(pa.float64()).to_numpy(zero_copy_only=False)
        near[first] = edge[first]
        x = self.make(b, np.abs(t - near))
        lead = tuple(np.zeros((b.num_rows, *s)) for s in self.shapes)
        has = np.zeros(b.num_rows, bool)
        if not first[0]:
            has[0] = True
            for v, c in zip(lead, self.carry):
                v[0] = c[0]
        at, flat = _lists(b.column(b.schema.get_field_index("_state")), 4 + 2 * self.dims)
        entered = at[first[at]]  # rows of a later slice carry the state; its first row uses it
        for i, f in zip(entered, flat[first[at]]):
            has[i] = True
            # (covariance or nothing, mean): an element that forgets all before it
            lead[1][i] = f[4:].reshape(2, self.dims)
            if self.kind == "filter":
                lead[2][i] = f[:4].reshape(2, 2)
        rows = np.flatnonzero(has)
        if len(rows):
            new = self.combine(tuple(v[rows] for v in lead), tuple(v[rows] for v in x))
            for v, u in zip(x, new):
                v[rows] = u
        head = first.copy()
        head[0] = True
        x = running(x, head, self.combine)
        before = tuple(np.concatenate([np.zeros((1, *v.shape[1:])), v[:-1]]) for v in x)
        for v, u in zip(before, lead):
            v[head] = u[head]
        known = ~head | has
        self.last, self.time, self.carry = last, t[-1], _last(x, b.num_rows - 1)
        return first, x, before, known


def _folded(kind: str, dims: int, make: Callable, keys: list[str], out: pa.Schema):
    """mapInArrow: sorted rows -> one element for each run of equal keys."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Scan(kind, dims, make, keys)

        def row(key: tuple, x: Element) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], f.type) for k, f in zip(key, out)), _flat(x)], schema=out)

        for b in batches:
            if not b.num_rows:
                continue
            before_key, before_x = s.last, s.carry
            first, x, _, _ = s.step(b)
            if before_key is not None and first[0]:
                yield row(before_key, before_x)
            ends = np.flatnonzero(first[1:])
            if len(ends):
                cols = [b.column(b.schema.get_field_index(k)).take(pa.array(ends)) for k in keys]
                yield pa.RecordBatch.from_arrays([*cols, _flat(tuple(v[ends] for v in x))], schema=out)
        if s.last is not None:
            yield row(s.last, s.carry)

    return go


def _prefixed(kind: str, dims: int, keys: list[str], out: pa.Schema):
    """mapInArrow: slices' elements, sorted -> the state (covariance or zeros, mean) at the end of each slice."""
    shapes, combine = _shapes(kind, dims), combine_filter if kind == "filter" else combine_smoother
    width = sum(a * b for a, b in shapes)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, None
        for b in batches:
            if not b.num_rows:
                continue
            before = last
            first, last = _new(b, keys, before)
            x = _unflat(_lists(b.column(b.schema.get_field_index("_element")), width)[1].copy(), shapes)
            if not first[0]:
                for v, u in zip(x, combine(carry, _last(x, 0))):
                    v[0] = u[0]
            head = first.copy()
            head[0] = True
            x = running(x, head, combine)
            carry = _last(x, b.num_rows - 1)
            state = (x[2], x[1]) if kind == "filter" else (np.zeros_like(x[0]), x[1])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in [*keys, "_slice"]), _flat(state)], schema=out)

    return go


def _arrow(df: DataFrame, names: list[str], more: list[pa.Field]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([*to_arrow_schema(df.select(*names).schema), *more])


LIST = pa.list_(pa.float64())


def _scanned(rows: DataFrame, keys: list[str], kind: str, dims: int, make: Callable, order: list, edges: DataFrame, back: bool) -> DataFrame:
    """rows (with _slice, _t) and, for each, its slice's ``_edge`` time and entering ``_state``."""
    edge, at = ("_after", F.col("_slice").desc()) if back else ("_before", F.col("_slice").asc())
    near = carried(edges, keys, "_first" if back else None, None if back else "_last")
    rows = with_carried(rows, near, keys).withColumnRenamed(edge, "_edge")
    # slices of sequences that have several: fold, prefix
    many = with_carried(rows, edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias("_before")).join(edges.select(*keys, "_slice"), keys), keys).where("_before").drop("_before")
    part = [*keys, "_slice"]
    fold = many.withColumn("_state", F.lit(None).cast("array<double>")).repartition(*part).sortWithinPartitions(*keys, at, *order)
    schema = _arrow(rows, part, [pa.field("_element", LIST)])
    sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*part).schema)
    folded = fold.mapInArrow(_folded(kind, dims, make, part, schema), f"{sql}, _element array<double>")
    states = folded.repartition(*keys).sortWithinPartitions(*keys, at).mapInArrow(_prefixed(kind, dims, keys, _arrow(rows, part, [pa.field("_s", LIST)])), f"{sql}, _s array<double>")
    entering = carried(states, keys, "_s" if back else None, None if back else "_s")
    rows = with_carried(rows, entering, keys).withColumnRenamed(edge, "_state")
    return rows.repartition(*part).sortWithinPartitions(*keys, at, *order)


def cv_filter(df: DataFrame, axes: list[str], std_m: float, accel_std: float, keys: list[str] = ["sequence_id"], velocity_std: float = 15.0, slices: int = SLICES, least: int = LEAST) -> DataFrame:
    """(keys, time_s, key, axes) -> the same with ``state_<axis>``, ``velocity_<axis>``, ``nis`` and the covariance (``cov``, 4 numbers) of every axis."""
    return _filtered(df, axes, std_m, accel_std, keys, velocity_std, slices, least).drop("_slice")


def _filtered(df: DataFrame, axes: list[str], std_m: float, accel_std: float, keys: list[str], velocity_std: float, slices: int, least: int) -> DataFrame:
    dims = len(axes)
    t = F.col("time_s").cast("double")
    fine = t.isNotNull() & ~F.isnan(t)
    for a in axes:
        fine = fine & F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double"))
    rows = df.where(fine).select(*keys, "time_s", "key", t.alias("_t"), *[F.col(a).cast("double").alias(f"_z{i}") for i, a in enumerate(axes)])
    rows = sliced(rows, keys, "_t", slices, least)
    edges = rows.groupBy(*keys, "_slice").agg(F.max("_t").alias("_last"))

    def z_of(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([b.column(b.schema.get_field_index(f"_z{i}")).to_numpy(zero_copy_only=False) for i in range(dims)], 1)

    def make(b: pa.RecordBatch, dt: np.ndarray) -> Element:
        return filter_elements(dt, z_of(b), std_m, accel_std, velocity_std)

    made = [*[f"state_{a}" for a in axes], *[f"velocity_{a}" for a in axes], "nis"]
    names = [*keys, "time_s", "key", "_slice"]
    out = _arrow(rows, names, [*[pa.field(n, pa.float64()) for n in made], pa.field("cov", LIST)])
    part = [*keys, "_slice"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Scan("filter", dims, make, part)
        for b in batches:
            if not b.num_rows:
                continue
            t, edge = (b.column(b.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("_t", "_edge"))
            time = s.time
            first, x, before, known = s.step(b)
            near = np.concatenate([[time], t[:-1]])
            near[first] = edge[first]
            f, q = _motion(np.where(known, np.maximum(np.nan_to_num(t - near), 0), 0), accel_std)
            p = (f @ before[2] @ _turned(f) + q)[:, 0, 0] + std_m**2
            off = z_of(b) - (f @ before[1])[:, 0, :]
            nis = np.where(known, (off**2).sum(1) / p, 0.0)
            numbers = [*x[1][:, 0, :].T, *x[1][:, 1, :].T, nis]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), *(pa.array(np.ascontiguousarray(v)) for v in numbers), _flat((x[2],))], schema=out)

    ready = _scanned(rows, keys, "filter", dims, make, ["_t", "key"], edges, False)
    sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return ready.mapInArrow(go, sql + "".join(f", `{n}` double" for n in made) + ", cov array<double>")


def cv_smooth(df: DataFrame, axes: list[str], std_m: float, accel_std: float, keys: list[str] = ["sequence_id"], velocity_std: float = 15.0, slices: int = SLICES, least: int = LEAST) -> DataFrame:
    """(keys, time_s, key, axes) -> the same rows with the smoothed ``state_<axis>`` and ``velocity_<axis>`` (Rauch, Tung and Striebel)."""
    dims = len(axes)
    rows = saved(_filtered(df, axes, std_m, accel_std, keys, velocity_std, slices, least)).withColumn("_t", F.col("time_s").cast("double"))
    edges = rows.groupBy(*keys, "_slice").agg(F.min("_t").alias("_first"))

    def make(b: pa.RecordBatch, dt: np.ndarray) -> Element:
        of = lambda c: np.stack([b.column(b.schema.get_field_index(f"{c}_{a}")).to_numpy(zero_copy_only=False) for a in axes], 1)
        cov = _lists(b.column(b.schema.get_field_index("cov")), 4)[1].reshape(-1, 2, 2)
        return smoother_elements(dt, np.stack([of("state"), of("velocity")], 1), cov, accel_std)

    names = [*keys, "time_s", "key"]
    made = [*[f"state_{a}" for a in axes], *[f"velocity_{a}" for a in axes]]
    out = _arrow(rows, names, [pa.field(n, pa.float64()) for n in made])
    part = [*keys, "_slice"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Scan("smoother", dims, make, part)
        for b in batches:
            if b.num_rows:
                _, x, _, _ = s.step(b)
                numbers = [*x[1][:, 0, :].T, *x[1][:, 1, :].T]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), *(pa.array(np.ascontiguousarray(v)) for v in numbers)], schema=out)

    ready = _scanned(rows, keys, "smoother", dims, make, [F.col("_t").desc(), F.col("key").desc()], edges, True)
    sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return ready.mapInArrow(go, sql + "".join(f", `{n}` double" for n in made))
