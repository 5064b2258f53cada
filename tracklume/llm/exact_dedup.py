"""Exact duplicates: Patricia-trie owners.

Texts are equal when they are identical without white space.  Of equal texts the row
with the most code points in its original text stays, then the one of smallest id.

1. Map side: a task inserts its normalised texts, whole byte strings, into a compressed
   radix trie.  A terminal node holds the owner so far and the number of copies, so a
   text that a third of all documents share leaves a task as one row.  A trie over
   ``LIMIT`` bytes spills its heaviest subtree: those terminals leave as partial rows.
2. Those rows are dealt by length and content hash (SHA-256) and sorted by them.  A
   task inserts them into a trie again.  Once a (length, hash) has passed, its terminals
   are final; so a trie over the limit spills whole subtrees of final owners and goes on.
   A task holds the limit and one text at the most, whatever the partition's size.
3. Owners (no texts) go back to the documents by length and hash.  Classes of more than
   1/1000 of all rows, at most 1,000 of them, are broadcast; the other ones are joined.

The full bytes decide what is equal: two different texts of one length and one SHA-256
would stop the job with an error.  Texts are moved once, after step 1.

Defined results: a null text is empty, and all empty texts are equal; a null id counts
as greater than any other; of rows that tie in code points and id (repeated rows) one is
kept; an empty table gives an empty result; other columns, whatever their names, are
ignored by :func:`exact_dedup` and pass through :func:`keep_owners` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors as A
from ._common import docs_of, fresh
from .simhash import _stored

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of strings and nodes that a trie holds before it spills.
LIMIT = 32 << 20
#: What a node counts for beside its label.
NODE = 300
#: A class of more than this share of all rows is broadcast; there are fewer of them than 1 / SHARE.
SHARE = 0.001

OWNER = pa.schema([("n_bytes", pa.int64()), ("hash", pa.binary()), ("body", pa.large_binary()), ("points", pa.int64()), ("doc_id", pa.int64()), ("ties", pa.int64()), ("n", pa.int64())])
OWNER_SQL = "n_bytes long, hash binary, body binary, points long, doc_id long, ties long, n long"
FINAL = pa.schema([("n_bytes", pa.int64()), ("hash", pa.binary()), ("points", pa.int64()), ("keep_id", pa.int64()), ("ties", pa.int64()), ("group_size", pa.int64())])
FINAL_SQL = "n_bytes long, hash binary, points long, keep_id long, ties long, group_size long"


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common start of label and key[at:], by bisection."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    __slots__ = ("edges", "owner")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, _Node]] = {}
        self.owner: tuple | None = None


def merged(a: tuple | None, b: tuple) -> tuple:
    """Owners are (points, id, ties, n): most code points, then the smallest id, null last."""
    if a is None:
        return b
    x, y = (-a[0], a[1] is None, a[1] or 0), (-b[0], b[1] is None, b[1] or 0)
    best = a if x <= y else b
    return best[0], best[1], a[2] + b[2] if x == y else best[2], a[3] + b[3]


class Trie:
    """A radix trie whose edges are byte strings, with an owner at each terminal."""

    def __init__(self):
        self.root = _Node()
        self.held = 0
        self.weight: dict[int, int] = {}  # of the root's subtrees, by first byte

    def insert(self, key: bytes, owner: tuple) -> None:
        node, at, more = self.root, 0, 0
        while at < len(key):
            edge = node.edges.get(key[at])
            if edge is None:
                leaf = _Node()
                node.edges[key[at]] = (key[at:], leaf)
                more += len(key) - at + NODE
                node = leaf
                break
            label, below = edge
            if key.startswith(label, at):
                node, at = below, at + len(label)
                continue
            m = _shared(label, key, at)
            fork = _Node()
            fork.edges[label[m]] = (label[m:], below)
            node.edges[key[at]] = (label[:m], fork)
            more += NODE
            node, at = fork, at + m
        node.owner = merged(node.owner, owner)
        if more:
            self.held += more
            self.weight[key[0]] = self.weight.get(key[0], 0) + more

    def spill(self) -> Iterator[tuple[bytes, tuple]]:
        """Cuts the heaviest subtree below the root off and gives its terminals."""
        first = max(self.weight, key=self.weight.__getitem__)
        self.held -= self.weight.pop(first)
        yield from _terminals(*self.root.edges.pop(first))

    def drain(self) -> Iterator[tuple[bytes, tuple]]:
        if self.root.owner is not None:
            yield b"", self.root.owner
        while self.weight:
            yield from self.spill()
        self.root = _Node()


def _terminals(start: bytes, node: _Node) -> Iterator[tuple[bytes, tuple]]:
    todo = [(start, node)]
    while todo:
        key, node = todo.pop()
        if node.owner is not None:
            yield key, node.owner
        todo.extend((key + label, below) for label, below in node.edges.values())


def _batches(rows: Iterable[tuple], schema: pa.Schema, body: int | None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 100 + (len(r[body]) if body is not None else 0)
        if size >= A.BATCH_BYTES:
            yield A.pack_batch(held, schema)
            held, size = [], 0
    if held:
        yield A.pack_batch(held, schema)


def _code_points(text: bytes) -> int:
    return len(text.decode("utf-8", "replace"))


def _local(limit: int):
    """mapInArrow: (doc_id, text) -> partial owners with their texts."""

    def rows(arrow):
        trie = Trie()
        for b in arrow:
            for doc_id, text in zip(b.column(0).to_pylist(), docs_of(b, "text")):
                trie.insert(text.translate(None, SPACE), (_code_points(text), doc_id, 1, 1))
                while trie.held > limit:
                    yield from trie.spill()
        yield from trie.drain()

    def go(arrow):
        return _batches(((len(k), sha256(k).digest(), k, *o) for k, o in rows(arrow)), OWNER, 2)

    return go


def _final(limit: int):
    """mapInArrow: partial owners sorted by length and hash -> owners."""

    def rows(arrow):
        trie, last, body = Trie(), None, b""
        for b in arrow:
            for n_bytes, key, text, *owner in zip(*(c.to_pylist() for c in b.columns)):
                if (n_bytes, key) != last:
                    while trie.held > limit:
                        yield from trie.spill()
                    last, body = (n_bytes, key), text
                elif text != body:
                    raise ValueError("two texts have one length and one SHA-256")
                trie.insert(text, tuple(owner))
        yield from trie.drain()

    def go(arrow):
        return _batches(((len(k), sha256(k).digest(), *o) for k, o in rows(arrow)), FINAL, None)

    return go


def owners(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(n_bytes, hash, points, keep_id, ties, group_size): one row for each distinct text, stored."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    part = rows.mapInArrow(A.in_pieces(_local(limit)), OWNER_SQL)
    dealt = part.repartition("n_bytes", "hash").sortWithinPartitions("n_bytes", "hash")
    return _stored(dealt.mapInArrow(A.in_pieces(_final(limit)), FINAL_SQL), "owners")


def _keyed(text: str, keep_text: bool):
    """mapInArrow: rows with their code points, length and hash at the end."""

    def go(arrow):
        for b in arrow:
            raw = docs_of(b, text)
            bare = [x.translate(None, SPACE) for x in raw]
            more = (pa.array(map(_code_points, raw), pa.int64()), pa.array(map(len, bare), pa.int64()), pa.array([sha256(x).digest() for x in bare], pa.binary()))
            kept = [i for i, f in enumerate(b.schema) if keep_text or f.name != text]
            fields = [b.schema.field(i) for i in kept] + [pa.field(f"_{k}", a.type) for k, a in enumerate(more)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *more], schema=pa.schema(fields))

    return go


def _marked(docs: DataFrame, text: str, doc_id: str, keep_text: bool, limit: int) -> tuple[DataFrame, list[str]]:
    """Rows of docs with fresh columns (code points, length, hash, keep_id, group_size, kept)."""
    names = fresh(docs, "points", "n_bytes", "hash", "keep_id", "group_size", "kept", "ties", "row", "first", "o_points", "o_n", "o_key", "o_at")
    points, n_bytes, key, keep_id, group_size, kept, ties, row, first, o_points, o_n, o_key, o_at = names
    own = owners(docs, text, doc_id, limit)
    own = own.select(F.col("n_bytes").alias(n_bytes), F.col("hash").alias(key), F.col("points").alias(o_points), F.col("keep_id").alias(keep_id), F.col("ties").alias(ties), F.col("group_size").alias(group_size))
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, T.StructField(points, T.LongType()), T.StructField(n_bytes, T.LongType()), T.StructField(key, T.BinaryType())])
    rows = docs.mapInArrow(A.in_pieces(_keyed(text, keep_text)), schema)
    repeated = own.where(F.col(ties) > 1).limit(1).count() > 0
    if repeated:  # rows that tie in all that counts: the one of least number is kept, and numbers must not change
        rows = _stored(rows.withColumn(row, F.monotonically_increasing_id()), "keyed")
    most = own.agg(F.coalesce(F.sum(group_size), F.lit(0))).first()[0] * SHARE
    hot = own.where(F.col(group_size) > most)
    # one pass: a row that has met a broadcast class takes a key of its own, which meets nothing and is dealt evenly
    met = [f"{c}_b" for c in (o_points, keep_id, ties, group_size)]
    hot = hot.select(n_bytes, key, *[F.col(c).alias(m) for c, m in zip((o_points, keep_id, ties, group_size), met)])
    rest = own.where(F.col(group_size) <= most).select(F.col(n_bytes).alias(o_n), F.col(key).alias(o_key), o_points, keep_id, ties, group_size)
    found = rows.join(F.broadcast(hot), [n_bytes, key], "left")
    at = F.when(F.col(met[3]).isNotNull(), F.concat(key, F.encode(F.monotonically_increasing_id().cast("string"), "UTF-8"))).otherwise(F.col(key))
    found = found.withColumn(o_at, at).join(rest, (F.col(o_n) == F.col(n_bytes)) & (F.col(o_key) == F.col(o_at)), "left")
    whole = [F.when(F.col(met[3]).isNotNull(), F.col(m)).otherwise(F.col(c)).alias(c) for c, m in zip((o_points, keep_id, ties, group_size), met)]
    out = found.select(*[F.col(f"`{c}`") for c in rows.columns], *whole)
    best = (F.col(points) == F.col(o_points)) & F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(keep_id))
    if repeated:
        firsts = out.where(best & (F.col(ties) > 1)).groupBy(n_bytes, key).agg(F.min(row).alias(first)).select(F.col(first).alias(row), F.lit(True).alias(first))
        out = out.join(firsts, row, "left")
        best = best & ((F.col(ties) == 1) | F.col(first).isNotNull())
    return out.withColumn(kept, F.coalesce(best, F.lit(False))), names


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """Documents -> (doc_id, keep_id, group_size, kept, text_sha256), dropped rows too."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out, (_, _, key, keep_id, group_size, kept, *_) = _marked(rows, "text", "doc_id", False, limit)
    return out.select("doc_id", F.col(keep_id).alias("keep_id"), F.col(group_size).alias("group_size"), F.col(kept).alias("kept"), F.lower(F.hex(key)).alias("text_sha256"))


def keep_owners(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    out, (_, _, _, _, _, kept, *_) = _marked(docs, text, doc_id, True, limit)
    return out.where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB: windows over the normalised text.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), o AS (
  SELECT doc_id, sha256(bare) AS text_sha256, count(*) OVER (PARTITION BY bare) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM o
"""
