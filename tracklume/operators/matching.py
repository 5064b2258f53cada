"""One-to-one matching of times: optimal and order-preserving, or in the order of arrival.

Times further apart than the tolerance cannot matter to one another, so a sequence falls into chains at its
gaps; chains are dealt, sorted and solved one by one.  Memory is linear in a chain's candidate pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequence import _each, streamed


def ordered_assignment(wanted: np.ndarray, found: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Pairs of two sorted arrays within the tolerance: most pairs, then least total distance.

    On a line some best matching crosses nowhere, so a table over prefixes decides; of each row only the
    found times within the tolerance can change, and only those are kept.
    """
    low = np.searchsorted(found, wanted - tolerance, "left")
    high = np.searchsorted(found, wanted + tolerance, "right")
    while True:  # sums round: a difference within the tolerance counts
        grow_l = (low > 0) & (np.abs(found[np.maximum(low - 1, 0)] - wanted) <= tolerance) if len(found) else np.zeros(len(wanted), bool)
        grow_h = (high < len(found)) & (np.abs(found[np.minimum(high, len(found) - 1)] - wanted) <= tolerance) if len(found) else grow_l
        if not grow_l.any() and not grow_h.any():
            break
        low, high = low - grow_l, high + grow_h
    best: list[tuple[int, float]] = [(0, 0.0)]  # by number of found times before: (pairs, minus distance)
    choice = []
    for i, t in enumerate(wanted):
        a, b = int(low[i]), int(high[i])
        best.extend([best[-1]] * (b + 1 - len(best)))
        row, left = [], best[a]
        old = best[a : b + 1]
        for j in range(a, b):
            gap = abs(float(found[j] - t))
            up, take = old[j - a + 1], (old[j - a][0] + 1, old[j - a][1] - gap) if gap <= tolerance else (-1, 0.0)
            top = max(up, left, take)
            row.append(1 if top == left else 0 if top == up else 2)  # of equal choices the later rows are left out
            best[j + 1] = left = top
        choice.append(row)
    out, i, j = [], len(wanted) - 1, len(best) - 1
    while i >= 0:
        a = int(low[i])
        j = min(j, int(high[i]))
        if j <= a:
            i -= 1
            continue
        c = choice[i][j - 1 - a]
        if c == 2:
            out.append((i, j - 1))
            i, j = i - 1, j - 1
        elif c == 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def first_come(wanted: np.ndarray, order: np.ndarray, found: np.ndarray, tolerance: float) -> list[tuple[int, bool]]:
    """For each wanted time in the given order the place of the nearest found time that is still free within the tolerance, or -1;
    and whether its nearest of all is within it.  ``found`` is sorted; ties go to the earlier time, equal times to the first.
    Free neighbours are found by links that skip what is taken."""
    n = len(found)
    right, prev = list(range(n + 1)), list(range(n + 1))  # next free place from i; place i of the second stands for i - 1, 0 for none

    def end(links: list[int], i: int) -> int:
        at = i
        while links[at] != at:
            at = links[at]
        while links[i] != at:
            links[i], i = at, links[i]
        return at

    out: list[tuple[int, bool]] = [(-1, False)] * len(wanted)
    for k in order.tolist():
        t = wanted[k]
        at = int(np.searchsorted(found, t, "left"))
        near = min((abs(float(found[i] - t)) for i in (at - 1, at) if 0 <= i < n), default=np.inf)
        after, before = end(right, at), end(prev, at) - 1
        if before >= 0:  # of equal times the first free one
            head = end(right, int(np.searchsorted(found, found[before], "left")))
            before = head if found[head] == found[before] else before
        gaps = [(abs(float(found[i] - t)), i) for i in (before, after) if 0 <= i < n]
        gap, i = min(gaps, default=(np.inf, -1))
        if gap <= tolerance:
            right[i], prev[i + 1] = i + 1, i
            out[k] = (i, True)
        else:
            out[k] = (-1, near <= tolerance)
    return out


def chained(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float, time: str = "time_s") -> DataFrame:
    """Rows (keys, time, key) of both tables with ``_side`` (0: a) and ``_chain``: it changes where a gap exceeds the tolerance."""
    cols = [*keys, F.col(time).cast("double").alias("time_s"), "key"]
    both = a.select(*cols, F.lit(0).alias("_side")).unionByName(b.select(*cols, F.lit(1).alias("_side"))).where("time_s IS NOT NULL AND NOT isnan(time_s)")
    w = Window.partitionBy(*keys).orderBy("time_s", "_side", "key")
    return both.withColumn("_chain", F.sum((F.col("time_s") - F.lag("time_s").over(w) > tolerance).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_chain", F.coalesce("_chain", F.lit(0)))


def optimal_times(wanted: DataFrame, found: DataFrame, keys: list[str], tolerance: float, time: str = "time_s") -> DataFrame:
    """(keys, key, match_key, time_s, match_s): each wanted and each found row at most once; most pairs, then least total time difference."""

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        side, t = p.column("_side").to_numpy(), p.column("time_s").to_numpy()
        rows, other = [], []
        for s in _each(starts, len(t)):
            x, y = s.start + np.flatnonzero(side[s] == 0), s.start + np.flatnonzero(side[s] == 1)
            for i, j in ordered_assignment(t[x], t[y], tolerance):
                rows.append(int(x[i]))
                other.append(int(y[j]))
        rows, other = pa.array(rows, pa.int64()), pa.array(other, pa.int64())
        out = p.select([*keys, "key", "time_s"]).take(rows)
        return out.append_column("match_key", p.column("key").take(other)).append_column("match_s", p.column("time_s").take(other))

    both = chained(wanted, found, keys, tolerance, time)
    kind = lambda c: f"{c} {both.schema[c].dataType.simpleString()}"
    schema = ", ".join([*map(kind, keys), kind("key"), "time_s double", f"match_key {both.schema['key'].dataType.simpleString()}", "match_s double"])
    return streamed(both, [*keys, "_chain"], ["time_s", "_side", "key"], schema, kernel)


def _text(c: str) -> Column:
    """A track name, or null where it names nothing."""
    t = F.trim(F.col(c).cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none", "null", "<na>", "nat"), t)


def match_submission(submission: DataFrame, truth: DataFrame, max_time_delta_s: float = 0.5, axes: tuple = ("x_m", "y_m", "z_m")) -> DataFrame:
    """(sequence_id, time_s, track_id, key, axes) of both -> a row for each submitted one: matched, reason, truth_key, time_delta_s, error_2d_m, error_3d_m.

    Rows are served in the order of ``key``, each by the nearest truth row that is still free.  Where truth has track names that a
    submission of the sequence shares, or more than one, only truth of the same track counts.  Reasons: missing_sequence_truth,
    track_id_mismatch, duplicate_truth_match (the nearest row is taken), time_gate.
    """
    sub = submission.select("sequence_id", F.col("time_s").cast("double").alias("time_s"), "key", _text("track_id").alias("track"), *axes)
    tru = truth.select("sequence_id", F.col("time_s").cast("double").alias("time_s"), "key", _text("track_id").alias("track"), *axes)
    named = tru.where("track IS NOT NULL").select("sequence_id", "track").distinct()
    shared = sub.where("track IS NOT NULL").select("sequence_id", "track").distinct().join(named, ["sequence_id", "track"]).select("sequence_id").distinct().withColumn("_shared", F.lit(True))
    rule = tru.select("sequence_id").distinct().join(named.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("_tracks")), "sequence_id", "left").join(shared, "sequence_id", "left")
    rule = rule.select("sequence_id", F.lit(True).alias("_known"), (F.coalesce("_shared", F.lit(False)) | (F.coalesce("_tracks", F.lit(0)) > 1)).alias("_strict"))
    marked = sub.join(rule, "sequence_id", "left").join(named.withColumn("_named", F.lit(True)), ["sequence_id", "track"], "left")
    reason = F.when(F.col("_known").isNull(), "missing_sequence_truth").when(F.col("_strict") & F.col("_named").isNull(), "track_id_mismatch")
    marked = marked.withColumn("_reason", reason).withColumn("_group", F.when(F.col("_strict"), F.col("track")).otherwise(""))
    open_ = marked.where("_reason IS NULL")
    free = tru.join(rule, "sequence_id").withColumn("_group", F.when(F.col("_strict"), F.col("track")).otherwise("")).where("_group IS NOT NULL")
    keys = ["sequence_id", "_group"]
    both = chained(open_, free, keys, max_time_delta_s)

    def kernel(p: pa.Table, starts: np.ndarray) -> pa.Table:
        side, t, key = p.column("_side").to_numpy(), p.column("time_s").to_numpy(), p.column("key")
        order = p.column("_order").to_numpy()
        rows, other, reasons = [], [], []
        for s in _each(starts, len(t)):
            x, y = s.start + np.flatnonzero(side[s] == 0), s.start + np.flatnonzero(side[s] == 1)
            for i, (at, near) in enumerate(first_come(t[x], np.argsort(order[x], kind="stable"), t[y], max_time_delta_s)):
                rows.append(int(x[i]))
                other.append(int(y[at]) if at >= 0 else None)
                reasons.append(None if at >= 0 else "duplicate_truth_match" if near else "time_gate")
        out = p.select(["sequence_id", "key"]).take(pa.array(rows, pa.int64()))
        other = pa.array(other, pa.int64())
        return out.append_column("truth_key", key.take(other)).append_column("reason", pa.array(reasons, pa.string()))

    # the order of keys within a chain, as a number
    both = both.withColumn("_order", F.row_number().over(Window.partitionBy(*keys, "_chain").orderBy("key")))
    kind = both.schema["key"].dataType.simpleString()
    served = streamed(both, [*keys, "_chain"], ["time_s", "_side", "key"], f"sequence_id {both.schema['sequence_id'].dataType.simpleString()}, key {kind}, truth_key {kind}, reason string", kernel)
    at = tru.select("sequence_id", F.col("key").alias("truth_key"), F.col("time_s").alias("truth_s"), *[F.col(a).alias(f"{a}_t") for a in axes])
    out = marked.select("sequence_id", "key", "time_s", *axes, "_reason").join(served, ["sequence_id", "key"], "left").join(at, ["sequence_id", "truth_key"], "left")
    d = [F.col(a) - F.col(f"{a}_t") for a in axes]
    norm = lambda parts: F.sqrt(sum((x * x for x in parts), F.lit(0.0)))
    matched = F.col("truth_key").isNotNull()
    untimed = F.when(~matched, F.coalesce("_reason", "reason", F.lit("time_gate")))
    return out.select("sequence_id", "key", "time_s", matched.alias("matched"), untimed.alias("reason"), "truth_key", F.abs(F.col("time_s") - F.col("truth_s")).alias("time_delta_s"), F.when(matched, norm(d[:2])).alias("error_2d_m"), F.when(matched, norm(d)).alias("error_3d_m"))
