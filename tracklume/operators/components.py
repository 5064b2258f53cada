"""Connected components as joins, and the clusters that rest on them: voxels, and candidates of several sensors.

Frames and stretches of time with few rows are worked out in one task each, many at once, behind one shuffle of
the rows.  Those with more than ``FEW`` rows are not held by one task: their links are found by equi-joins on grid
cells and a component may span any number of tasks.  Both ways are exact and give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import band_join, radius_pairs
from .sequence import _numbers, streamed
from .slices import same_keys
from .stored import saved

#: Most rows of a frame (voxels) or of a block of ``BLOCK`` windows (sensors) that one task holds.
FEW = 5_000
#: Windows of a block of time.
BLOCK = 16
#: Links that a task holds before it replaces them by a forest.
LINKS = 1 << 22


def _to_least(links: DataFrame, upward: bool) -> DataFrame:
    """links (hi > lo).  Every node that a node sees (upward: greater ones only; else lesser ones) is tied to the least one seen."""
    if upward:
        sees = links.select(F.col("hi").alias("at"), F.col("lo").alias("other")).unionAll(links.select(F.col("lo").alias("at"), F.col("hi").alias("other")))
        least = sees.groupBy("at").agg(F.min("other").alias("low")).select("at", F.least("at", "low").alias("low"))
        tied = sees.where(F.col("other") > F.col("at")).join(least, "at").select(F.col("other").alias("hi"), F.col("low").alias("lo"))
    else:
        least = links.groupBy("hi").agg(F.min("lo").alias("low"))
        tied = links.join(least, "hi").select(F.col("lo").alias("hi"), F.col("low").alias("lo")).unionAll(least.select("hi", F.col("low").alias("lo")))
    return tied.where(F.col("hi") > F.col("lo")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Links between orderable ids -> (node, root): each linked node with the least one it can reach.

    Rounds of ties to the least neighbour, upwards and downwards, until every component is a star (the star
    algorithm of Kiveris et al., 2014).  Each round is a checkpoint.  Null ends and loops are no links.
    """
    now = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = saved(now.distinct())
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    before = print_of(now)
    for _ in range(most_rounds):
        now = saved(_to_least(_to_least(now, True), False))
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: no end")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _cells(df: DataFrame, axes: list[str], size: float) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(float(size))).cast("long").alias(f"_c{i}") for i, a in enumerate(axes)]


def _half(dims: int) -> list[tuple[int, ...]]:
    """Steps to half of the neighbour cells: each pair of neighbours is met once."""
    return [s for s in product((-1, 0, 1), repeat=dims) if s > (0,) * dims]


def _finite(axes: list[str]) -> Column:
    out = F.lit(True)
    for a in axes:
        x = F.col(a).cast("double")
        out = out & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return out


def _neighbours(group: np.ndarray, x: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by (group, x): each pair of one group whose x differ by ``reach`` or less, once; one step of the order after the other."""
    at, k = np.arange(len(x)), 0
    while len(at):
        k += 1
        at = at[at + k < len(x)]
        at = at[(group[at + k] == group[at]) & (x[at + k] - x[at] <= reach)]
        yield at, at + k


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by the links a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def _split(df: DataFrame, keys: list[str], counted: DataFrame, count_keys: list[str], few: int) -> tuple[DataFrame, DataFrame | None]:
    """df's rows whose keys have no group of more than ``few`` rows, and the others (None: there are none)."""
    many = saved(counted.groupBy(*count_keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > few).select(*[F.col(k).alias(f"{k}_h") for k in keys]).distinct())
    n = many.count()
    if not n:
        return df, None
    many = F.broadcast(many) if n <= 100_000 else many
    return df.join(many, same_keys(keys, "_h"), "left_anti"), df.join(many, same_keys(keys, "_h"), "left_semi")


def voxel_clusters(df: DataFrame, keys: list[str], size: float, least: int, axes: tuple = ("x_m", "y_m", "z_m"), key: str = "key", few: int = FEW) -> DataFrame:
    """(keys, key, axes) -> the same with ``cluster`` (the least key of its component) and ``cluster_points``.

    Components are occupied voxels that touch, corners too; those of fewer than ``least`` points, and points
    that are not finite, have null.  Whole rows are shuffled: give only the columns that are needed.
    """
    small, large = _split(df, keys, df, keys, few)
    out = _voxels_in_tasks(small, keys, size, least, list(axes), key)
    return out if large is None else out.unionByName(_voxels_by_joins(large, keys, size, least, list(axes), key).select(out.columns))


def _voxels_in_tasks(df: DataFrame, keys: list[str], size: float, least: int, axes: list[str], key: str) -> DataFrame:
    """Every frame in one task."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        x, n = _numbers(p, *axes).reshape(p.num_rows, len(axes)), p.num_rows
        fine = np.flatnonzero(np.isfinite(x).all(1))
        frame = (np.searchsorted(starts, np.arange(n), "right") - 1)[fine]
        cells = np.clip(np.floor(x[fine] / size), -(2.0**62), 2.0**62).astype(np.int64)
        order = np.lexsort((*cells.T[::-1], frame))
        frame, cells, fine = frame[order], cells[order], fine[order]
        new = np.ones(len(fine), bool)
        new[1:] = (frame[1:] != frame[:-1]) | (cells[1:] != cells[:-1]).any(1)
        voxel = np.cumsum(new) - 1
        frames, at = frame[new], cells[new]
        pairs = [(a[t], b[t]) for a, b in _neighbours(frames, at[:, 0], 1) for t in [(np.abs(at[b, 1:] - at[a, 1:]) <= 1).all(1)]]
        a, b = (np.concatenate([q[i] for q in pairs] or [np.zeros(0, int)]) for i in range(2))
        root = _least_labels(len(frames), a, b)[voxel]
        row, rank = pc.sort_indices(p.column(key)).to_numpy(), np.empty(n, np.int64)
        rank[row] = np.arange(n)
        points, first = np.bincount(root, minlength=1), np.full(len(frames) + 1, n)
        np.minimum.at(first, root, rank[fine])
        named = points[root] >= least
        cluster, count = np.full(n, -1), np.full(n, -1)
        cluster[fine[named]], count[fine[named]] = row[first[root[named]]], points[root[named]]
        out = p.append_column("cluster", p.column(key).take(pa.array(cluster, mask=cluster < 0)))
        return out.append_column("cluster_points", pa.array(count, mask=count < 0))

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return streamed(df, keys, [], ", ".join([*columns, f"cluster {df.schema[key].dataType.simpleString()}", "cluster_points long"]), kernel)


def _voxels_by_joins(df: DataFrame, keys: list[str], size: float, least: int, axes: list[str], key: str) -> DataFrame:
    """Frames over any number of tasks.  Points are counted per voxel first: a voxel is one row however many it holds."""
    names = [f"_c{i}" for i in range(len(axes))]
    points = df.where(_finite(axes)).select(*keys, key, *_cells(df, axes, size))
    voxels = saved(points.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_least")))
    node = F.struct(*keys, *names)
    steps = F.explode(F.array(*[F.struct(*[F.lit(k).cast("long").alias(f"s{i}") for i, k in enumerate(s)]) for s in _half(len(axes))])).alias("_s")
    near = voxels.select(*keys, node.alias("a"), *names, steps)
    near = near.select(*[F.col(k).alias(f"{k}_a") for k in keys], "a", *[(F.col(n) + F.col(f"_s.s{i}")).alias(f"{n}_a") for i, n in enumerate(names)])
    meets = F.lit(True)
    for k in keys:
        meets = meets & F.col(k).eqNullSafe(F.col(f"{k}_a"))
    for n in names:
        meets = meets & (F.col(n) == F.col(f"{n}_a"))
    links = near.join(voxels.select(*keys, *names, node.alias("b")), meets).select("a", "b")
    classes = components(links)
    named = voxels.withColumn("node", node).join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = named.groupBy("root").agg(F.sum("_n").alias("cluster_points"), F.min("_least").alias("cluster")).where(F.col("cluster_points") >= least)
    labels = named.join(sizes, "root").select(F.col("node").alias("_node"), "cluster", "cluster_points")
    rows = df.withColumn("_node", F.when(_finite(axes), F.struct(*keys, *_cells(df, axes, size))))
    return rows.join(labels, "_node", "left").drop("_node")


def cross_sensor_clusters(df: DataFrame, window_s: float, gate_m: float, axes: tuple = ("x_m", "y_m", "z_m"), score: str = "score", few: int = FEW) -> DataFrame:
    """(sequence_id, time_s, source, key, axes, score) -> a row for each cluster of two sources or more.

    Around each time of a sequence the rows within ``window_s`` are linked where they lie within ``gate_m``;
    a component of several sources is merged: score-weighted mean position and time, extents, spread.  A component that several times
    give is there once, at the first of them (``anchor_s``).  Weights are at least 1e-6 (null: 1).  Keys of a sequence are unique.
    """
    axes = list(axes)
    rows = df.select("sequence_id", F.col("time_s").cast("double").alias("time_s"), "source", "key", *axes, F.greatest(F.coalesce(F.col(score).cast("double"), F.lit(1.0)), F.lit(1e-6)).alias("_w")).where(_finite([*axes, "time_s"]) & F.col("sequence_id").isNotNull())
    length = BLOCK * max(window_s, 1e-9)
    counted = rows.select("sequence_id", F.floor(F.col("time_s") / F.lit(length)).alias("_block"))
    small, large = _split(rows, ["sequence_id"], counted, ["sequence_id", "_block"], few)
    out = _sensors_in_tasks(small, window_s, gate_m, axes, length)
    if large is not None:
        out = out.unionByName(_sensors_by_joins(large, window_s, gate_m, axes).select(out.columns))
    level, up = [F.col(f"extent_{x}") for x in axes[:2]], F.col(f"extent_{axes[-1]}")
    out = out.withColumn("std_xy_m", F.greatest(F.sqrt(sum((x * x for x in level), F.lit(0.0))), F.lit(0.5))).withColumn("std_z_m", F.greatest(up, F.lit(0.5)))
    return out.select("sequence_id", "anchor_s", "time_s", *axes, "std_xy_m", "std_z_m", "confidence", "n", *[f"extent_{x}" for x in axes])


def _sensors_in_tasks(rows: DataFrame, window_s: float, gate_m: float, axes: list[str], length: float) -> DataFrame:
    """Every block of time in one task.  It also gets the rows from three windows before it to one behind it, so that
    the anchors up to two windows before it are whole: an earlier one cannot give a component again that the block has."""
    reach = max(window_s, 1e-9) * 1.001
    block = lambda by: F.floor((F.col("time_s") + F.lit(by)) / F.lit(length))
    dealt = rows.select("sequence_id", F.explode(F.sequence(block(-reach), block(3 * reach))).alias("_block"), "time_s", "source", *axes, "_w")

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        n = p.num_rows
        group = np.searchsorted(starts, np.arange(n), "right") - 1
        t, x, w = _numbers(p, "time_s"), _numbers(p, *axes).reshape(n, len(axes)), _numbers(p, "_w")
        names = p.column("source").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        # anchors: the times of each block, and the first and last anchor that each sees
        by_time = np.lexsort((t, group))
        new = np.ones(n, bool)
        new[1:] = (group[by_time][1:] != group[by_time][:-1]) | (t[by_time][1:] != t[by_time][:-1])
        anchor, of_row = by_time[new], np.empty(n, np.int64)
        of_row[by_time] = np.cumsum(new) - 1
        low, high = np.arange(len(anchor)), np.arange(len(anchor))
        for a, b in _neighbours(group[anchor], t[anchor], window_s):
            low[b], high[a] = a, b
        low, high = low[of_row], high[of_row]
        # a node is a row at an anchor
        edges, held = [], 0

        def forest() -> tuple[np.ndarray, np.ndarray]:
            a, b = (np.concatenate([e[i] for e in edges] or [np.zeros(0, np.int64)]) for i in range(2))
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            return nodes, _least_labels(len(nodes), at[: len(a)], at[len(a) :])

        by_x = np.lexsort((x[:, 0], group))
        for a, b in _neighbours(group[by_x], x[by_x, 0], gate_m):
            i, j = by_x[a], by_x[b]
            first, times = np.maximum(low[i], low[j]), np.minimum(high[i], high[j]) - np.maximum(low[i], low[j]) + 1
            ok = (times > 0) & (np.sqrt(((x[i] - x[j]) ** 2).sum(1)) <= gate_m)
            i, j, first, times = i[ok], j[ok], first[ok], times[ok]
            if not len(i):
                continue
            for c in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(times) // LINKS)) + 1):
                step = np.arange(times[c].sum()) - np.repeat(np.cumsum(times[c]) - times[c], times[c])
                at = (np.repeat(first[c], times[c]) + step) * n
                edges.append((at + np.repeat(i[c], times[c]), at + np.repeat(j[c], times[c])))
                held += len(at)
                if held > LINKS:
                    nodes, root = forest()
                    edges, held = [(nodes, nodes[root])], 0
        nodes, root = forest()
        at, row = nodes // n, nodes % n
        top, comp = np.unique(root, return_inverse=True)
        m = len(top)
        total = np.bincount(comp, w[row], m)
        mean = lambda v: np.bincount(comp, v[row] * w[row], m) / total
        over = lambda f, v, start: (out := np.full(m, start), f.at(out, comp, v[row]))[0]
        kinds = (over(np.minimum, np.where(np.isnan(names), np.inf, names), np.inf), over(np.maximum, np.where(np.isnan(names), -1, names), -1.0)) if names.dtype.kind == "f" else (over(np.minimum, names, n), over(np.maximum, names, -1))
        marks = np.random.default_rng(7).integers(0, 2**63, (2, n), np.uint64)  # a set of rows is known by two sums of random numbers
        sums = [over(np.add, k, np.uint64(0)) for k in marks]
        size, anchors = np.bincount(comp, minlength=m), at[top]
        order = np.lexsort((anchors, size, *sums))
        again = np.zeros(m, bool)
        again[order[1:]] = np.logical_and.reduce([v[order[1:]] == v[order[:-1]] for v in (*sums, size)])
        home = np.floor(t[anchor] / length) == p.column("_block").to_numpy()[anchor]
        keep = ~again & (kinds[1] > kinds[0]) & home[anchors]
        out = p.select(["sequence_id"]).take(pa.array(anchor[anchors[keep]]))
        cols = {"anchor_s": t[anchor][anchors], "n": size, "time_s": mean(t), **{a: mean(x[:, k]) for k, a in enumerate(axes)}, "confidence": total}
        cols |= {f"extent_{a}": over(np.maximum, x[:, k], -np.inf) - over(np.minimum, x[:, k], np.inf) for k, a in enumerate(axes)}
        for name, v in cols.items():
            out = out.append_column(name, pa.array(v[keep]))
        return out

    schema = ", ".join(["sequence_id " + rows.schema["sequence_id"].dataType.simpleString(), "anchor_s double", "n long", *[f"{c} double" for c in ("time_s", *axes, "confidence", *[f"extent_{a}" for a in axes])]])
    return streamed(dealt, ["sequence_id", "_block"], [], schema, kernel)


def _sensors_by_joins(rows: DataFrame, window_s: float, gate_m: float, axes: list[str]) -> DataFrame:
    """Sequences over any number of tasks."""
    times = rows.select("sequence_id", "time_s").distinct()
    around = band_join(times, rows, ["sequence_id"], window_s).select("sequence_id", F.col("time_s").alias("anchor_s"), F.col("time_s_r").alias("time_s"), *[F.col(f"{c}_r").alias(c) for c in ("source", "key", *axes, "_w")])
    around = saved(around)
    anchor = ["sequence_id", "anchor_s"]
    links = radius_pairs(around, anchor, "key", gate_m, tuple(axes), tuple(axes)).select(F.struct(*anchor, "key").alias("a"), F.struct(*anchor, F.col("key_r").alias("key")).alias("b"))
    classes = components(links)
    members = around.withColumn("node", F.struct(*anchor, "key")).join(classes, "node")
    mean = lambda c: (F.sum(F.col(c) * F.col("_w")) / F.sum("_w"))
    extent = lambda c: (F.max(c) - F.min(c))
    wide = lambda k: F.sum(F.xxhash64(F.lit(k), "key").cast("decimal(38,0)"))
    out = members.groupBy("root").agg(
        F.first("sequence_id").alias("sequence_id"),
        F.first("anchor_s").alias("anchor_s"),
        F.count(F.lit(1)).alias("n"),
        F.min("source").alias("_s0"),
        F.max("source").alias("_s1"),
        wide(1).alias("_h1"),
        wide(2).alias("_h2"),
        mean("time_s").alias("time_s"),
        *[mean(x).alias(x) for x in axes],
        *[extent(x).alias(f"extent_{x}") for x in axes],
        F.sum("_w").alias("confidence"),
    )
    out = out.where("_s0 <> _s1")
    own = ["sequence_id", "n", "_h1", "_h2"]  # one component has one set of rows
    first = out.groupBy(*own).agg(F.min("anchor_s").alias("anchor_s"))
    return out.join(first, [*own, "anchor_s"], "left_semi").drop("_s0", "_s1", "_h1", "_h2", "root")
