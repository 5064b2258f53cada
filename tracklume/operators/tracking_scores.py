"""Multi-object scores from mergeable counts: HOTA and identity scores per sequence and pooled.

Everything but two small assignments is joins and sums.  Overlaps are found per frame, alignment sums and hit
counts per pair of identities and threshold add up over frames in any order, so a sequence may lie in many
tasks.  The assignments are those of one frame's boxes, and of one sequence's identities, from their counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .sequence import _each, streamed

#: Overlaps from which a pair counts: 0.05, 0.10, ... 0.95.
ALPHAS = [k / 20 for k in range(1, 20)]
#: An overlap this little below a threshold still counts.
SLACK = 1e-9
#: Weights of pairs differ by at least this where they tie, so that ties fall alike everywhere.
TIE = 1e-9


def _overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes (x, y, w, h)."""
    span = lambda x, w: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{x}") + F.col(f"{a}.{w}"), F.col(f"{b}.{x}") + F.col(f"{b}.{w}")) - F.greatest(f"{a}.{x}", f"{b}.{x}"))
    both = span("x", "w") * span("y", "h")
    area = lambda s: F.col(f"{s}.w") * F.col(f"{s}.h")
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def _preference(t: str, p: str) -> Column:
    """A fixed small number for each pair of identities."""
    a, b = F.pmod(F.col(t), F.lit(1009)), F.pmod(F.col(p), F.lit(1009))
    return F.pmod(a * 31 + b * 17 + a * b * 7, F.lit(97)) * F.lit(TIE / 97)


def assigned(pairs: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, t, p, weight) -> the pairs (keys, t, p) of the one-to-one assignment of greatest weight within each group of keys."""

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t, p = (table.column(c).to_numpy() for c in ("t", "p"))
        w, rows = table.column(weight).to_numpy(), []
        for s in _each(starts, len(t)):
            if s.stop - s.start == 1:
                rows.append(s.start)
                continue
            left, i = np.unique(t[s], return_inverse=True)
            right, j = np.unique(p[s], return_inverse=True)
            cost, at = np.full((len(left), len(right)), 0.0), np.full((len(left), len(right)), -1)
            cost[i, j], at[i, j] = -w[s], np.arange(s.start, s.stop)
            rows += [int(at[a, b]) for a, b in K.assignment(cost) if at[a, b] >= 0]
        return table.take(pa.array(sorted(rows), pa.int64())).select([*keys, "t", "p"])

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return streamed(pairs, keys, ["t", "p"], f"{schema}, t long, p long", kernel)


def identity_counts(truth: DataFrame, guess: DataFrame, clear: float = 0.5) -> dict[str, DataFrame]:
    """The mergeable counts behind the scores: boxes per identity, pairs of each frame, alignment and hits per pair."""
    box = lambda d, n: d.select("sequence_id", "frame", F.col("id").cast("long").alias(n), F.struct(*[F.col(c).cast("double").alias(c) for c in "xywh"]).alias(f"b{n}"))
    pairs = box(truth, "t").join(box(guess, "p"), ["sequence_id", "frame"]).withColumn("s", _overlap("bt", "bp")).where("s > 0").select("sequence_id", "frame", "t", "p", "s")
    side = lambda n: pairs.groupBy("sequence_id", "frame", n).agg(F.sum("s").alias(f"s_{n}"))
    shared = pairs.join(side("t"), ["sequence_id", "frame", "t"]).join(side("p"), ["sequence_id", "frame", "p"])
    aligned = shared.groupBy("sequence_id", "t", "p").agg(F.sum(F.col("s") / (F.col("s_t") + F.col("s_p") - F.col("s"))).alias("aligned"), F.count(F.when(F.col("s") >= clear - SLACK, 1)).alias("overlaps"))
    number = lambda d, n: d.groupBy("sequence_id", F.col("id").cast("long").alias(n)).agg(F.count(F.lit(1)).alias(f"n_{n}"))
    aligned = aligned.join(number(truth, "t"), ["sequence_id", "t"]).join(number(guess, "p"), ["sequence_id", "p"])
    aligned = aligned.withColumn("jaccard", F.col("aligned") / (F.col("n_t") + F.col("n_p") - F.col("aligned")))
    weighed = pairs.join(aligned.select("sequence_id", "t", "p", "jaccard"), ["sequence_id", "t", "p"]).withColumn("w", F.col("jaccard") * F.col("s") + _preference("t", "p"))
    chosen = assigned(weighed.select("sequence_id", "frame", "t", "p", "w"), ["sequence_id", "frame"], "w").join(pairs, ["sequence_id", "frame", "t", "p"])
    reached = F.explode(F.filter(F.array(*[F.lit(a) for a in ALPHAS]), lambda a: a - SLACK <= F.col("s"))).alias("alpha")
    hits = chosen.select("sequence_id", "t", "p", "s", reached).groupBy("sequence_id", "alpha", "t", "p").agg(F.count(F.lit(1)).alias("hits"), F.sum("s").alias("overlap"))
    return {"aligned": aligned, "hits": hits}


def lts_scores(truth: DataFrame, guess: DataFrame, clear: float = 0.5) -> DataFrame:
    """Boxes (sequence_id, frame, id, x, y, w, h; an id once a frame) -> a row for each sequence and one over all (null sequence_id):
    hota, hota_low (at the first threshold), det_a, ass_a, loc_a, idf1, id_tp, and the detections of both sides.

    Pooled detection counts are sums; pooled association and localisation are means weighted by true positives.
    A sequence without boxes on either side has no row; with boxes on one side it scores 0.
    """
    counts = identity_counts(truth, guess, clear)
    boxes = lambda d, n: d.groupBy("sequence_id").agg(F.count(F.lit(1)).alias(n))
    totals = boxes(truth, "n_truth").join(boxes(guess, "n_guess"), "sequence_id", "full").na.fill(0, ["n_truth", "n_guess"])
    size = counts["aligned"].select("sequence_id", "t", "p", "n_t", "n_p")
    per_pair = counts["hits"].join(size, ["sequence_id", "t", "p"])
    share = F.col("hits") * F.col("hits") / F.greatest(F.lit(1), F.col("n_t") + F.col("n_p") - F.col("hits"))
    per_alpha = per_pair.groupBy("sequence_id", "alpha").agg(F.sum("hits").alias("tp"), F.sum(share).alias("ass"), F.sum("overlap").alias("loc"))
    # every threshold of every sequence, whether anything reached it or not
    grid = totals.select("*", F.explode(F.array(*[F.lit(a) for a in ALPHAS])).alias("alpha"))
    per_alpha = grid.join(per_alpha, ["sequence_id", "alpha"], "left").na.fill(0, ["tp", "ass", "loc"])
    # sums over sequences are all that the pooled row needs
    both = per_alpha.groupingSets([[F.col("sequence_id"), F.col("alpha")], [F.col("alpha")]], F.col("sequence_id"), F.col("alpha")).agg(*[F.sum(c).alias(c) for c in ("tp", "ass", "loc", "n_truth", "n_guess")], F.grouping("sequence_id").alias("pooled"))
    det = F.col("tp") / F.greatest(F.lit(1), F.col("n_truth") + F.col("n_guess") - F.col("tp"))
    ass, loc = F.col("ass") / F.greatest(F.lit(1), F.col("tp")), F.when(F.col("tp") > 0, F.col("loc") / F.col("tp")).otherwise(1.0)
    rows = both.withColumn("det", det).withColumn("assoc", ass).withColumn("where", loc).withColumn("h", F.sqrt(F.col("det") * F.col("assoc")))
    out = rows.groupBy("sequence_id", "pooled").agg(F.avg("h").alias("hota"), F.min_by("h", "alpha").alias("hota_low"), F.avg("det").alias("det_a"), F.avg("assoc").alias("ass_a"), F.avg("where").alias("loc_a"), F.first("n_truth").alias("n_truth"), F.first("n_guess").alias("n_guess"))
    some = counts["aligned"].where("overlaps > 0").withColumn("w", F.col("overlaps") + _preference("t", "p"))
    kept = assigned(some.select("sequence_id", "t", "p", "w"), ["sequence_id"], "w").join(some, ["sequence_id", "t", "p"])
    id_tp = kept.groupingSets([[F.col("sequence_id")], []], F.col("sequence_id")).agg(F.sum("overlaps").alias("id_tp"), F.grouping("sequence_id").alias("pooled"))
    out = out.join(id_tp.select(F.col("sequence_id").alias("_s"), F.col("pooled").alias("_p"), "id_tp"), F.col("sequence_id").eqNullSafe(F.col("_s")) & (F.col("pooled") == F.col("_p")), "left").drop("_s", "_p", "pooled").na.fill(0, ["id_tp"])
    return out.withColumn("idf1", F.try_divide(2 * F.col("id_tp"), F.col("n_truth") + F.col("n_guess")))


def organiser_means(scores: DataFrame) -> DataFrame:
    """One row: the mean over sequences and the pooled row, each counting once, of hota_low and idf1."""
    return scores.agg(F.count(F.lit(1)).alias("rows"), F.avg("hota_low").alias("hota_low"), F.avg("idf1").alias("idf1"))
