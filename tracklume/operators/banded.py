"""Penalised second differences as block elimination over time slices.

The trajectory x of least sum of w (x - z)^2 + weight * (second difference)^2 solves a system of five bands.  Its
blocks of two neighbours are eliminated forwards and put back backwards, and both steps are the associative
elements of :mod:`scan`: with state (x_i, x_(i-1)) the penalty is a motion without drift, and the first two
rows, which no difference ties to anything before, begin it exactly.  So a slice hands on one 2 x 2 block at its edge,
cost is linear in the rows, and a sequence may span any number of tasks.
Huber weights repeat the solution with weights from its residuals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import LIST, Element, _arrow, _flat, _inverse, _lists, _Scan, _scanned, _turned
from .slices import LEAST, SLICES, same_keys, sliced
from .stored import saved

#: Times are at least this far apart.
CLOSE = 1e-9


def _motion(a: np.ndarray, b: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """x_(i+1) = (1 + b / a) x_i - b / a x_(i-1) + noise, for gaps a before and b after x_i."""
    r = b / a
    f, q = np.zeros((len(a), 2, 2)), np.zeros((len(a), 2, 2))
    f[:, 0, 0], f[:, 0, 1], f[:, 1, 0] = 1 + r, -r, 1
    q[:, 0, 0] = (b * (a + b) / 2) ** 2 / weight
    return f, q


def _col(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _forward(b: pa.RecordBatch, dims: int, weight: float) -> Element:
    """``_a`` and ``_b`` are the gaps before the row before and before the row; NaN where there is none."""
    ga, gb, w, pw = (_col(b, c) for c in ("_a", "_b", "_w", "_pw"))
    z, pz = (np.stack([_col(b, f"{c}{i}") for i in range(dims)], 1) for c in ("_z", "_pz"))
    n = len(w)
    start, second = np.isnan(gb), ~np.isnan(gb) & np.isnan(ga)
    inner = ~start & ~second
    f, q = _motion(np.where(inner, ga, 1.0), np.where(inner, gb, 1.0), weight)
    s = q[:, 0, 0] + 1 / w
    k = q[:, :, 0] / s[:, None]
    keep = np.tile(np.eye(2), (n, 1, 1))
    keep[:, :, 0] -= k
    seen = f[:, 0, :] / s[:, None]
    x = [keep @ f, k[:, :, None] * z[:, None, :], keep @ q, seen[:, :, None] * z[:, None, :], seen[:, :, None] * f[:, 0, None, :]]
    for v in (x[0], x[3], x[4]):
        v[~inner] = 0
    x[1][~inner, 0], x[2][~inner] = z[~inner], 0
    x[1][start, 1], x[1][second, 1] = z[start], pz[second]
    x[2][~inner, 0, 0] = 1 / w[~inner]
    x[2][start, 1, 1], x[2][second, 1, 1] = 1 / w[start], 1 / pw[second]
    return tuple(x)


def _backward(b: pa.RecordBatch, dims: int, weight: float) -> Element:
    """``_b`` is the gap before the row, ``_c`` the one behind it."""
    gb, gc = _col(b, "_b"), _col(b, "_c")
    mean = np.stack([np.stack([_col(b, f"_m{k}{i}") for i in range(dims)], 1) for k in (0, 1)], 1)
    cov = _lists(b.column(b.schema.get_field_index("_cov")), 4)[1].reshape(-1, 2, 2)
    end, start = np.isnan(gc), np.isnan(gb)
    f, q = _motion(np.where(start | end, 1.0, gb), np.where(start | end, 1.0, gc), weight)
    e = cov @ _turned(f) @ _inverse(f @ cov @ _turned(f) + q)
    g = mean - e @ (f @ mean)
    e[start] = [[0, 1], [0, 1]]  # the second row's state holds the first one
    g[start] = 0
    e[end], g[end] = 0, mean[end]
    return e, g


def _neighbours(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with ``_p1``, ``_p2`` (the rows before: structs of _t and values) and ``_n1`` (the next time), over slices' edges too."""
    part = [*keys, "_slice"]
    w = Window.partitionBy(*part).orderBy("_t", "key")
    row = F.struct("_t", *values)
    rows = rows.withColumn("_row", row)
    near = rows.withColumn("_i", F.row_number().over(w)).withColumn("_back", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("_t"), F.desc("key"))))
    # two last rows and the first time of each slice; only keys of several slices need them
    several = rows.groupBy(*keys).agg(F.max("_slice").alias("_top")).where("_top > 0")
    several = several.select(*[F.col(k).alias(f"{k}_s") for k in keys])
    tails = near.where("_back <= 2 OR _i = 1").join(F.broadcast(several), same_keys(keys, "_s"), "left_semi")
    edge = tails.groupBy(*part).agg(F.sort_array(F.collect_list(F.when(F.col("_back") <= 2, F.struct(F.col("_back"), F.col("_row").alias("r")))), False).alias("_tail"), F.min("_t").alias("_head"))
    edge = edge.withColumn("_tail", F.transform("_tail", lambda x: x["r"]))
    order = Window.partitionBy(*keys).orderBy("_slice")
    edge = edge.withColumn("_all", F.flatten(F.collect_list("_tail").over(order.rowsBetween(Window.unboundedPreceding, -1)))).withColumn("_next", F.lead("_head").over(order))
    edge = edge.select(*[F.col(c).alias(f"{c}_e") for c in part], F.when(F.size("_all") >= 1, F.element_at("_all", -1)).alias("_e1"), F.when(F.size("_all") >= 2, F.element_at("_all", -2)).alias("_e2"), "_next")
    out = near.join(F.broadcast(edge), same_keys(part, "_e"), "left")
    out = out.withColumn("_p1", F.coalesce(F.lag("_row", 1).over(w), "_e1")).withColumn("_p2", F.coalesce(F.lag("_row", 2).over(w), F.when(F.col("_i") == 2, F.col("_e1")).when(F.col("_i") == 1, F.col("_e2")))).withColumn("_n1", F.coalesce(F.lead("_t").over(w), "_next"))
    return out.drop("_row", "_i", "_back", "_e1", "_e2", "_next", *[f"{c}_e" for c in part])


def smoothed(df: DataFrame, axes: list[str], weight: float, keys: list[str] = ["sequence_id"], huber: float | None = None, rounds: int = 5, slices: int = SLICES, least: int = LEAST) -> DataFrame:
    """(keys, time_s, key, axes) -> the same rows with smoothed axes.

    Times of a key should differ; equal ones count as ``CLOSE`` apart.  Rows with a null or NaN time or position are dropped.
    With ``huber`` a row's weight is huber over its residual, at most 1, over ``rounds`` solutions.
    """
    dims = len(axes)
    t = F.col("time_s").cast("double")
    fine = t.isNotNull() & ~F.isnan(t)
    for x in axes:
        fine = fine & F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    z = [f"_z{i}" for i in range(dims)]
    rows = df.where(fine).select(*keys, "time_s", "key", t.alias("_t"), *[F.col(x).cast("double").alias(c) for x, c in zip(axes, z)])
    rows = _neighbours(sliced(rows, keys, "_t", slices, least), keys, z)
    gap = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a - b, F.lit(CLOSE))).otherwise(float("nan"))
    rows = rows.withColumns({"_a": gap(F.col("_p1._t"), F.col("_p2._t")), "_b": gap(F.col("_t"), F.col("_p1._t")), "_c": gap(F.col("_n1"), F.col("_t")), **{f"_pz{i}": F.coalesce(F.col(f"_p1._z{i}"), F.lit(0.0)) for i in range(dims)}})
    rows = rows.drop("_p1", "_p2", "_n1").withColumn("_w", F.lit(1.0)).withColumn("_pw", F.lit(1.0))
    names = [c for c in rows.columns]
    part = [*keys, "_slice"]
    sql = lambda d, cols: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*cols).schema)
    edges = lambda d: d.groupBy(*part).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    means, finals = [f"_m{k}{i}" for k in (0, 1) for i in range(dims)], [f"_x{k}{i}" for k in (0, 1) for i in range(dims)]

    def passed(kind: str, made: list[str], cov: bool, make, schema: pa.Schema):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = _Scan(kind, dims, make, part)
            for b in batches:
                if b.num_rows:
                    _, x, _, _ = s.step(b)
                    numbers = [np.ascontiguousarray(x[1][:, k, i]) for k in (0, 1) for i in range(dims)]
                    yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), *map(pa.array, numbers), *([_flat((x[2],))] if cov else [])], schema=schema)

        return go

    def forth(b: pa.RecordBatch, _: np.ndarray) -> Element:
        return _forward(b, dims, weight)

    def back(b: pa.RecordBatch, _: np.ndarray) -> Element:
        return _backward(b, dims, weight)

    out = rows
    for _ in range(rounds if huber is not None else 1):
        start = saved(out.select(*names))
        fields = [pa.field(n, pa.float64()) for n in means]
        ready = _scanned(start, keys, "filter", dims, forth, ["_t", "key"], edges(start), False)
        down = saved(ready.mapInArrow(passed("filter", means, True, forth, _arrow(start, names, [*fields, pa.field("_cov", LIST)])), sql(start, names) + "".join(f", {n} double" for n in means) + ", _cov array<double>"))
        fields = [pa.field(n, pa.float64()) for n in finals]
        ready = _scanned(down, keys, "smoother", dims, back, [F.col("_t").desc(), F.col("key").desc()], edges(down), True)
        out = ready.mapInArrow(passed("smoother", finals, False, back, _arrow(start, names, fields)), sql(start, names) + "".join(f", {n} double" for n in finals))
        if huber is not None:
            off = lambda k, c: F.sqrt(sum(((F.col(f"_x{k}{i}") - F.col(f"{c}{i}")) * (F.col(f"_x{k}{i}") - F.col(f"{c}{i}")) for i in range(dims)), F.lit(0.0)))
            share = lambda r: F.least(F.lit(1.0), F.lit(float(huber)) / F.greatest(r, F.lit(1e-12)))
            out = out.withColumn("_w", share(off(0, "_z"))).withColumn("_pw", share(off(1, "_pz")))
    return out.select(*keys, "time_s", "key", *[F.col(f"_x0{i}").alias(x) for i, x in enumerate(axes)])
