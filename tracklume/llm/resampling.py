"""Target-distribution importance resampling over hashed n-gram features.

A document's features are its runs of 1 to ``most`` consecutive words.  A feature's
bucket is the CRC-32 of its bytes modulo ``buckets``; a bucket's gain says how much
likelier it is in the target than in the documents.  A document's weight is the sum
of its features' gains; with Gumbel noise drawn from its id the highest scores are a
sample without replacement in proportion to the weights.

1. Each task counts in a trie of words.  A node is a run of words: it holds how often
   the run occurred and the CRC state of its bytes, so a longer run goes on from its
   parent's state and no feature is ever joined or hashed as a whole.  A trie of over
   ``NODES`` nodes adds its counts to the task's bucket totals and starts anew.
2. Tasks hand out bucket totals (``buckets`` rows at the most); Spark adds them up.
   The gains, ``buckets`` numbers, are all that the driver sees.
3. Documents walk a trie again whose nodes hold gains instead of counts.
4. Scores are dealt by range and sorted; a partition's offset is the number of rows in
   the partitions before it, so ranks need no task that sees all scores.

Defined results: a null text has no words (weight 0); a null id draws its noise from
``seed:`` alone and comes after every other id in ties; rows that tie in score and id are ranked
in any order; an empty table of documents gives an empty result, an empty target
counts as no features; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from ._common import docs_of
from .simhash import _stored

#: Nodes of a trie before it is emptied.
NODES = 1 << 18
#: A-Z to a-z; what is no digit, letter or byte of a longer character becomes a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])
_SCORED_SQL = "doc_id long, n_words long, n_features long, weight long, score long"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def n_runs(n: int, most: int) -> int:
    return sum(max(0, n - k) for k in range(most))


class _Node:
    __slots__ = ("state", "value", "next")

    def __init__(self, state: int, value: int):
        self.state, self.value, self.next = state, value, {}


class WordTrie:
    """Runs of words as paths; a node's value is a count, or the gain of its bucket."""

    def __init__(self, most: int, buckets: int, gains: list[int] | None = None):
        self.most, self.buckets, self.gains = most, buckets, gains
        self.clear()

    def clear(self) -> None:
        self.root, self.size = _Node(0, 0), 0

    def _step(self, node: _Node, word: bytes) -> _Node:
        state = crc32(word, crc32(b" ", node.state) if node is not self.root else 0)
        found = node.next[word] = _Node(state, 0 if self.gains is None else self.gains[state % self.buckets])
        self.size += 1
        return found

    def paths(self, words: list[bytes]) -> Iterable[tuple[tuple[bytes, ...], int]]:
        """The distinct longest runs from each place, with how often they occur."""
        if self.most == 1:
            return (((w,), n) for w, n in Counter(words).items())
        return Counter(tuple(words[i : i + self.most]) for i in range(len(words))).items()

    def count(self, words: list[bytes]) -> None:
        for path, n in self.paths(words):
            node = self.root
            for w in path:
                node = node.next.get(w) or self._step(node, w)
                node.value += n

    def weigh(self, words: list[bytes]) -> int:
        total = 0
        for path, n in self.paths(words):
            node = self.root
            for w in path:
                node = node.next.get(w) or self._step(node, w)
                total += n * node.value
        return total

    def empty_into(self, totals: np.ndarray) -> None:
        todo = [self.root]
        while todo:
            for node in todo.pop().next.values():
                totals[node.state % self.buckets] += node.value
                if node.next:
                    todo.append(node)
        self.clear()


def _tally(most: int, buckets: int, nodes: int):
    """mapInArrow: texts -> the task's bucket totals."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def go(arrow):
        trie, totals = WordTrie(most, buckets), np.zeros(buckets, np.int64)
        for b in arrow:
            for text in docs_of(b, "text"):
                trie.count(words_of(text))
                if trie.size > nodes:
                    trie.empty_into(totals)
        trie.empty_into(totals)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(totals[some])], schema=schema)

    return go


def bucket_totals(texts: DataFrame, most: int, buckets: int, nodes: int = NODES) -> list[int]:
    """Features in each bucket, over all rows of (text)."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(A.in_pieces(_tally(most, buckets, nodes)), "bucket int, n long")
    out = [0] * buckets
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains_of(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the logarithm of (share in the target / share in the source), smoothed by one, rounded down."""
    all_s, all_t = float(sum(source) + len(source)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(source, target)]


def _noise(seed: int, doc_id: int | None) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gains: list[int], most: int, nodes: int, seed: int):
    """mapInArrow: (doc_id, text) -> words, features, weight and score."""

    def go(arrow):
        trie = WordTrie(most, len(gains), gains)
        for b in arrow:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), docs_of(b, "text")):
                words = words_of(text)
                weight = trie.weigh(words)
                if trie.size > nodes:
                    trie.clear()
                out.append((doc_id, len(words), n_runs(len(words), most), weight, weight + _noise(seed, doc_id)))
            yield A.pack_batch(out, _SCORED)

    return go


def _placed(arrow):
    """mapInArrow: the running number of each row in its partition, as the last column."""
    at = 0
    for b in arrow:
        places = pa.array(np.arange(at + 1, at + 1 + b.num_rows))
        at += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, places], schema=b.schema.append(pa.field("place", pa.int64())))


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with ``rank`` 1, 2, 3... in the given order, by ranges.  The columns part, place and rank must be free."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes)
    dealt = _stored(dealt.mapInArrow(_placed, f"{schema}, place long"), "ranges")
    before, starts = 0, []
    for part, n in sorted(map(tuple, dealt.groupBy("part").agg(F.max("place")).collect())):  # a row for each partition
        starts.append((part, before))
        before += n
    at = dealt.sparkSession.createDataFrame(starts, "part int, before long")
    return dealt.join(F.broadcast(at), "part").withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, most: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, nodes: int = NODES) -> DataFrame:
    """Documents (doc_id, text) and target texts (text) -> (doc_id, n_features, weight, score, rank).

    ``percent`` of the documents with at least ``least_words`` words are drawn; the other rows have no rank.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gains = gains_of(bucket_totals(texts, most, buckets, nodes), bucket_totals(target, most, buckets, nodes))
    rows = texts.mapInArrow(A.in_pieces(_scored(gains, most, nodes, seed)), _SCORED_SQL)
    rows = _stored(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = rows.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    places = ranked(fit, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc())
    places = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return places.select(*names).unionByName(rest.select(*names))


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn, with all their columns; ids must be unique."""
    ids = resample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("tl_drawn"))
    return docs.join(ids, F.col("doc_id").cast("long") == F.col("tl_drawn"), "left_semi")


#: DuckDB: CRC-32 of each distinct word by a table of 256 remainders, then the same sums.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), dw AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
bw AS MATERIALIZED (
  SELECT w, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark)
  GROUP BY w
), hexes AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % 10000 AS bucket
  FROM hexes, tab
), s AS (SELECT bucket, sum(n) AS n FROM dw JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN crc USING (w) GROUP BY bucket),
gains AS MATERIALIZED (
  SELECT b AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE
           / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) b(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b
), weights AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN crc USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS MATERIALIZED (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)
), places AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place,
         count(*) FILTER (n_features >= 20) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (10 * n) // 100 THEN place END AS rank FROM places
"""
