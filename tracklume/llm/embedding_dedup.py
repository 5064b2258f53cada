"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

1. Equal vectors of a label become one row with a count.
2. Spherical k-means is fitted on a bounded sample (``sample`` vectors, those of
   least hash); every vector has the cell of its nearest centre as home.
3. A vector also visits every cell that can hold a vector within the angle of
   the threshold: y at home in cell d satisfies y.(c_d - c_h) >= 0, so x can only
   be near it if x.(c_h - c_d) / |c_h - c_d| <= sin(angle).  That is exact, not a
   probe of a few cells.  Of two cells the lower one's vectors visit the higher one's.
4. A cell's home vectors and visitors meet in blocks of bounded size, however
   many there are; a block gives both sides' numbers of links and a spanning
   forest of them, never the pairs.
5. Components join the forests; the least id of each is kept.

Defined results: a vector that is null, empty, zero or has null or non-finite
components, or whose label is null, links with nothing (0 links, its own
component); vectors of different lengths do not link.  A row without an id
takes part; it is kept only if no id is in its component and ``kept`` is then
false, its component_id null unless a linked row has an id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .components import components
from .simhash import _stored

#: Home vectors, and visitors, of one block.
BLOCK = 2048
#: A row in a cell: a vector of a lower cell, one that lives there, and its second appearance as its own cell's visitor.
GUEST, HOME, SELF = 0, 1, 2
SLACK = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centres; starts from evenly spaced rows; an empty cell keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        some = size > 1e-12
        centres = np.where(some[:, None], sums / np.where(some, size, 1)[:, None], centres)
    return centres


def _cells(centres: dict[int, np.ndarray], cosine: float):
    """mapInArrow: (id, label, n, v) -> one row for each cell that a vector is at home in or visits."""
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("kind", pa.int32()), ("id", pa.binary()), ("n", pa.int64()), ("v", pa.binary())])
    reach = math.sin(math.acos(cosine)) + SLACK

    def go(arrow):
        for b in arrow:
            ids, labels, ns, vs = (c.to_pylist() for c in b.columns)
            by: dict[int, list[int]] = {}
            for i, v in enumerate(vs):
                by.setdefault(len(v), []).append(i)
            for dim, at in by.items():
                x = _unit(np.array([vs[i] for i in at], np.float64))
                c = centres.get(dim)
                if c is None:
                    c = np.eye(1, dim)
                sims = x @ c.T
                home = sims.argmax(axis=1)
                apart = np.sqrt(np.maximum(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2), 0))
                gap = sims[np.arange(len(x)), home][:, None] - sims
                far = apart[home]
                visits = ((gap <= reach * far) | (far < 1e-12)) & (np.arange(len(c)) >= home[:, None])
                r, cell = np.nonzero(visits)
                out = []
                for i, d in zip(r.tolist(), cell.tolist()):
                    k = at[i]
                    if d == home[i]:
                        out.append((labels[k], dim, d, HOME, ids[k], ns[k], x[i].tobytes()))
                    out.append((labels[k], dim, d, SELF if d == home[i] else GUEST, ids[k], ns[k], x[i].tobytes()))
                for i in range(0, len(out), 5000):
                    yield A.pack_batch(out[i : i + 5000], schema)

    return go


def _block_links(cosine: float):
    """applyInArrow: one block of home vectors and visitors -> (id, links, root)."""
    schema = pa.schema([("id", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def go(table: pa.Table) -> pa.Table:
        rows = table.select(["kind", "id", "n", "v"]).to_pydict()
        home = [i for i, k in enumerate(rows["kind"]) if k == HOME]
        guests = [i for i, k in enumerate(rows["kind"]) if k != HOME]
        if not home or not guests:
            return schema.empty_table()
        x = np.frombuffer(b"".join(rows["v"][i] for i in guests)).reshape(len(guests), -1)
        y = np.frombuffer(b"".join(rows["v"][i] for i in home)).reshape(len(home), -1)
        near = (x @ y.T) >= cosine
        place = {rows["id"][i]: k for k, i in enumerate(home)}
        for k, i in enumerate(guests):
            if (own := place.get(rows["id"][i])) is not None:
                near[k, own] = False
        n = np.array([rows["n"][i] for i in home], np.int64)
        m = np.array([rows["n"][i] if rows["kind"][i] == GUEST else 0 for i in guests], np.int64)  # a cell's own pairs are met from both sides
        links, links_h = near @ n, m @ near
        # least label over links, to and fro, until nothing changes
        gl, hl = np.arange(len(guests)), np.arange(len(home)) + len(guests)
        a, b = np.nonzero(near)
        while True:
            g2, h2 = gl.copy(), hl.copy()
            np.minimum.at(g2, a, hl[b])
            np.minimum.at(h2, b, g2[a])
            if np.array_equal(g2, gl) and np.array_equal(h2, hl):
                break
            gl, hl = g2, h2
        name = [rows["id"][i] for i in guests] + [rows["id"][i] for i in home]
        some_g, some_h = near.any(axis=1), near.any(axis=0)
        ids = [name[i] for i in np.flatnonzero(some_g)] + [name[len(guests) + i] for i in np.flatnonzero(some_h)]
        count = np.concatenate([links[some_g], links_h[some_h]])
        roots = [name[i] for i in np.concatenate([gl[some_g], hl[some_h]])]
        return pa.table([pa.array(ids, pa.binary()), pa.array(count), pa.array(roots, pa.binary())], schema=schema)

    return go


def embedding_dedup(vectors: DataFrame, cosine: float = 0.93, sample: int = 8192, cell_size: int = 1000, most_cells: int = 256) -> DataFrame:
    """(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    label = F.col("label").cast("string")
    finite = F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    # an id of 128 bits for each label and vector
    half = lambda k: F.lpad(F.hex(F.xxhash64(F.lit(k), label, v)), 16, "0")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"), (finite & label.isNotNull()).alias("ok"), F.unhex(F.concat(half(1), half(2))).alias("id"))
    rows = rows.withColumn("v", F.when(F.col("ok"), F.col("v")))
    one = rows.where("ok").groupBy("id").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.min("vec_id").alias("first"))
    one = _stored(one, "vectors")
    taken = one.select("v").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column(0).to_pylist()
    n = one.count()
    centres: dict[int, np.ndarray] = {}
    for dim in {len(x) for x in taken}:
        x = _unit(np.array([t for t in taken if len(t) == dim]))
        centres[dim] = spherical_kmeans(x, max(1, min(most_cells, len(x), n // cell_size)))
    cells = _stored(one.select("id", "label", "n", "v").mapInArrow(A.in_pieces(_cells(centres, cosine), rows=5000), "label string, dim int, cell int, kind int, id binary, n long, v binary"), "cells")
    key = ["label", "dim", "cell"]
    lives = F.col("kind") == HOME
    sizes = cells.groupBy(key).agg(F.count(F.when(lives, 1)).alias("hs"), F.count(F.when(~lives, 1)).alias("gs")).select(*key, F.ceil(F.col("hs") / BLOCK).cast("int").alias("hb"), F.ceil(F.col("gs") / BLOCK).cast("int").alias("gb"))
    dealt = cells.join(sizes.where("hb > 0 and gb > 0"), key)
    own = F.pmod(F.xxhash64("id"), F.when(lives, F.col("hb")).otherwise(F.col("gb"))).cast("int")
    others = F.sequence(F.lit(0), F.when(lives, F.col("gb")).otherwise(F.col("hb")) - 1)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select(*key, F.when(lives, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(lives, F.col("other")).otherwise(F.col("own")).alias("j"), "kind", "id", "n", "v")
    found = _stored(dealt.groupBy(*key, "i", "j").applyInArrow(_block_links(cosine), "id binary, links long, root binary"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = one.select("id", "n", "first").join(classes.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "first", F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    known = named.join(least, "root").join(links, "id", "left").select("id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "least")
    out = rows.select("vec_id", "id", "ok").join(known, "id", "left")
    component = F.when(F.col("ok"), F.col("least")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("ok"), F.col("links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: DuckDB: all pairs within a label, then reachability by rounds of the least id.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS MATERIALIZED (
  SELECT vec_id, label, e FROM (
    SELECT vec_id, label, CASE WHEN label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0 THEN e END AS e FROM v)
  WHERE e IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
), least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, component_id,
       v.vec_id = component_id AS kept
FROM v JOIN least ON v.vec_id = least.node
"""
