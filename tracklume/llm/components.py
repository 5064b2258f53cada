"""Connected components of a link table, on executors only.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each round
replaces links by links to the least neighbour until stars remain.  Minima are
partially aggregated before the shuffle, so a hub with a third of all links
costs a row per task; the joins on the hub are equi-joins that adaptive
execution may split.  Each round ends in a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Links (a > b).  Large star joins greater neighbours to the least one, small star the lesser ones."""
    if both:
        around = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) pairs of one orderable type -> (node, root): every node that has a link to
    another one, with the least node it can reach.  Null ends and loops are ignored; links may repeat.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("ok"))
    now = saved(now.where("ok and a > b").select("a", "b").distinct())
    before = None
    while True:
        now = saved(_star(_star(now, True), False))
        # stars: no node is both a leaf and a centre; then nothing changes any more
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = tuple(seen)
