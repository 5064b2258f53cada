"""Embedding whitening: upper-triangle column aggregates, decomposed with LAPACK.

Entries become whole numbers, x = floor(scale * c) + offset.

1. One aggregation gives the number of vectors and the sum of each dimension.
2. One aggregation of generated Spark SQL expressions sums the centred products of every
   pair of dimensions (the upper triangle) and the centred sums.  The centre is the mean
   rounded to a whole number: differences and their products are then whole numbers that a
   double holds exactly while a sum stays below 2**53, whatever the order of the rows.  The
   rest of the mean, less than one half, is taken off afterwards in exact arithmetic.  Rows
   are summed in ``SHARDS`` groups first, so no task takes a row from every other task.
3. The driver has ``SHARDS`` times dims * (dims + 1) / 2 numbers.  It assembles the covariance and
   calls LAPACK's symmetric solver.
4. Tasks project their vectors by matrix products.  The same aggregation over the
   whitened values measures how far their covariance is from the identity.

Vectors are read three times and never shuffled or stored.

Defined results: vectors that are null, or hold null or non-finite entries (or such whose x
no 64-bit number holds), are dropped.  So are vectors of another length than the commonest one
(of several the longest), and empty ones: one matrix cannot hold them.  An
eigenvalue of at most ``FLAT`` of the largest is no direction of the data: its rows have a null
``whitened`` and it is left out of ``identity_error``.  ``deviation`` is null where 64 bits do not
hold it; ``deviation_wide`` (a decimal as a string) is always exact.  Null ids and repeated rows are rows like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import anchors as A

SCALE, OFFSET = 64, 1_000_000
#: Groups of partial sums that the driver adds up.
SHARDS = 32
#: Share of the largest eigenvalue below which a direction is empty.
FLAT = 1e-12
#: Dimensions whose pairs one aggregation takes.
MOST_DIMS = 128
#: Beyond this a scaled entry has no 64-bit number.
WIDEST = 2.0**62


def whole_vectors(vectors: DataFrame, name: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that are finite throughout and not empty."""
    v = F.col(f"`{name}`").cast("array<double>")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < WIDEST / scale)) & (F.size("v") > 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    return rows.select("vec_id", F.transform("v", lambda e: F.floor(e * scale) + offset).alias("x"))


def _by_shard(rows: DataFrame, sums: list[Column]) -> list[tuple]:
    """A row of sums for each shard; at most SHARDS of them."""
    found = rows.withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(SHARDS))).groupBy("shard").agg(*sums)
    return [tuple(r)[1:] for r in found.collect()]


def sums_of(rows: DataFrame) -> tuple[int, int, list[int]]:
    """(dims, n, S) of the commonest length."""
    sizes = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return 0, 0, []
    dims = sizes[0]
    # a sum of halves: each fits 64 bits for 2**31 rows, whatever the entries
    high = [F.sum(F.shiftright(F.col("x")[i], 32)).alias(f"h{i}") for i in range(dims)]
    low = [F.sum(F.col("x")[i].bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"l{i}") for i in range(dims)]
    parts = _by_shard(rows.where(F.size("x") == dims), [*high, *low])
    return dims, sizes[1], [sum((p[i] << 32) + p[dims + i] for p in parts) for i in range(dims)]


def pair_sums(rows: DataFrame, k: int) -> tuple[list[Fraction], list[list[Fraction]]]:
    """Sums of the first k entries of the arrays ``y`` and of the products of every pair of them, in one aggregation.

    A row stands once for each first dimension i, and the generated expression of a distance d sums y[i] * y[i + d]:
    k expressions are compiled, k * (k + 1) / 2 of them at once are too many and would be interpreted.
    """
    firsts = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")
    rows = rows.select(F.slice("y", 1, k).alias("y"), firsts, F.pmod(F.spark_partition_id(), F.lit(SHARDS)).alias("shard"))
    sums = [F.expr("sum(get(y, i)) AS s"), *[F.expr(f"sum(get(y, i) * get(y, i + {d})) AS p{d}") for d in range(k)]]
    singles, upper = [Fraction(0)] * k, [[Fraction(0)] * k for _ in range(k)]
    for _, i, s, *products in rows.groupBy("shard", "i").agg(*sums).collect():  # at most SHARDS * k rows
        singles[i] += Fraction(s)
        for d, p in enumerate(products[: k - i]):
            upper[i][i + d] += Fraction(p)
    for i in range(k):
        for j in range(i):
            upper[i][j] = upper[j][i]
    return singles, upper


def covariance_of(n: int, singles: list[Fraction], pairs: list[list[Fraction]]) -> np.ndarray:
    """Divisor n; exact up to the last rounding."""
    k = len(singles)
    return np.array([[float((n * pairs[i][j] - singles[i] * singles[j]) / (n * n)) for j in range(k)] for i in range(k)]).reshape(k, k)


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue, by LAPACK; the largest entry of a vector is positive."""
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    at = np.abs(u).argmax(axis=0)
    return e, u * np.where(u[at, np.arange(u.shape[1])] < 0, -1.0, 1.0)


_PROJECTED = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("deviation_wide", pa.string()), ("w", pa.list_(pa.float64()))])
_PROJECTED_SQL = "vec_id long, deviation long, deviation_wide string, w array<double>"


def _projected(n: int, sums: list[int], turn: np.ndarray):
    """mapInArrow: (vec_id, x) -> exact deviations and whitened values.

    With the centre c = round(S / n): n * x - S = n * (x - c) - (S - n * c).
    """
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], object)
    share = np.array([float(Fraction(int(r), n)) for r in rest])
    dims = len(sums)

    def go(arrow):
        for b in arrow:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)
            y = x - centre
            w = (y.astype(np.float64) - share) @ turn
            d = y.astype(object) * n - rest if _over(y, n, rest) else y * np.int64(n) - rest.astype(np.int64)
            exact = [int(t) for t in (d * d).sum(axis=1)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * w.shape[1], w.shape[1]) if w.shape[1] else np.zeros(b.num_rows + 1), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t if t < 1 << 63 else None for t in exact], pa.int64()), pa.array(map(str, exact)), lists], schema=_PROJECTED)

    return go


def _over(y: np.ndarray, n: int, rest: np.ndarray) -> bool:
    """Whether 64 bits might not hold the sum of squares."""
    if not y.size:
        return False
    most = max(abs(int(y.max())), abs(int(y.min()))) * n + max(abs(int(r)) for r in rest)
    return y.shape[1] * most * most >= 1 << 63


def whiten(vectors: DataFrame, name: str = "embedding", most: int = 32, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, embedding) -> a row for each vector and component up to ``most``: vec_id, component, n, deviation, whitened,
    explained, identity_error, deviation_wide."""
    rows = whole_vectors(vectors, name, scale, offset)
    dims, n, sums = sums_of(rows)
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} dimensions are more pairs than one aggregation takes ({MOST_DIMS} dimensions)")
    if not n:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide string")
    rows = rows.where(F.size("x") == dims)
    # the centre may have any size, so it is taken off before numbers become doubles
    centre = F.array(*[F.lit(round(Fraction(s, n))).cast("long") for s in sums])
    singles, pairs = pair_sums(rows.select(F.zip_with("x", centre, lambda e, c: (e - c).cast("double")).alias("y")), dims)
    covariance = covariance_of(n, singles, pairs)
    values, turn = components_of(covariance, most)
    trace = float(np.trace(covariance))
    some = values > max(values[0], 0) * FLAT if len(values) else np.zeros(0, bool)
    turn = np.where(some, turn / np.sqrt(np.where(some, values, 1)), 0)
    k = int(some.sum())  # they come first
    out = rows.mapInArrow(A.in_pieces(_projected(n, sums, turn), rows=2000), _PROJECTED_SQL)
    error = None
    if k:
        # whitened values are centred by what they are; what rounding leaves of their mean is taken off too
        spread = covariance_of(n, *pair_sums(out.select(F.col("w").alias("y")), k))
        error = float(np.abs(spread - np.eye(k)).max())
    explained = [float(e) / trace if trace > 0 else None for e in values]
    at = F.col("component") - 1
    out = out.select("vec_id", "deviation", "deviation_wide", F.posexplode("w").alias("p", "value")).withColumn("component", F.col("p") + 1)
    return out.select(
        "vec_id",
        F.col("component").cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("component") <= k, F.col("value")).alias("whitened"),
        F.element_at(F.array(*[F.lit(e).cast("double") for e in explained]), at + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        "deviation_wide",
    )
