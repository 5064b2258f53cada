"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt into shards of bounded size by a hash.  A shard is packed by
best-fit decreasing: each piece goes into the open bin with the least room that
holds it.  If none does, each permitted size is filled on trial with the lengths
that still wait and that no earlier bin counts on, and a bin of the size with the
least cost for each token placed is opened; the cost of a size is ``size * (1 + size / attention)``.  In the end each bin
is downsized to the smallest permitted size that holds its contents.

Defined results: a document longer than the largest size is cut into pieces of
that size and a rest, nothing is dropped; a null or wordless text has length 0 and
gives one empty piece in a bin of its shard; a null id is dealt by its text; equal
rows are packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from ._common import WORD_SQL, text_or_empty

SIZES = (256, 512, 1024, 2048, 4096)
ATTENTION = 16384
#: Documents of a shard, about.
SHARD = 8192


def best_fit(lengths: list[int], sizes: tuple = SIZES, attention: int = ATTENTION):
    """(bin, offset) of each piece and the bins' sizes.  No length may exceed the largest size."""
    places, used, _ = _filled(lengths, tuple(sorted(sizes)), attention)
    return places, [next(s for s in sorted(sizes) if s >= u) for u in used]


def _filled(lengths: list[int], sizes: tuple, attention: int):
    """(bin, offset) of each piece, and of each bin what it holds and the size it was opened with."""
    cost = {s: s * (1 + s / attention) for s in sizes}
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    waiting = [0] * (sizes[-1] + 1)  # pieces of each length that are not placed and that no open bin counts on
    promised = [0] * (sizes[-1] + 1)  # those that one counts on
    lens = 0  # bit n is set if a piece of length n waits
    for n in lengths:
        waiting[n] += 1
        lens |= (n > 0) << n
    places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    used: list[int] = []
    opened: list[int] = []
    room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if an open bin has room r

    def trial(n: int, size: int) -> tuple[float, int, list[tuple[int, int]]]:
        """Cost of a token in a bin that takes a piece of n, then always the longest waiting pieces that fit; its size; these pieces."""
        r, least, taken = size - n, size, []
        while r and (fit := lens & ((1 << min(r + 1, least)) - 1)):
            least = fit.bit_length() - 1
            taken.append((least, min(waiting[least], r // least)))
            r -= least * taken[-1][1]
        return cost[size] / max(1, size - r), size, taken

    def promise(n: int, count: int) -> None:
        nonlocal lens
        waiting[n] -= count
        promised[n] += count
        if not waiting[n]:
            lens &= ~(1 << n)

    for i in order:
        n = lengths[i]
        fit = rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                rooms &= ~(1 << r)
            if not promised[n]:
                promise(n, 1)
        else:
            if waiting[n]:
                promise(n, 1)
            _, r, taken = min(trial(n, s) for s in sizes if s >= n)
            for other, count in taken:
                promise(other, count)
            k = len(used)
            used.append(0)
            opened.append(r)
        promised[n] -= 1
        places[i] = (k, used[k])
        used[k] += n
        r -= n
        room.setdefault(r, []).append(k)
        rooms |= 1 << r
    return places, used, opened


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("piece_start", pa.int64()), ("n_tokens", pa.int64()), ("shard", pa.int64()), ("bin", pa.int64()), ("bin_offset", pa.int64()), ("bin_size", pa.int64())])
_SQL = "doc_id long, piece long, piece_start long, n_tokens long, shard long, bin long, bin_offset long, bin_size long"


def _packed(sizes: tuple, attention: int):
    def go(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard, largest = key[0].as_py(), max(sizes)
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("h").to_pylist(), table.column("n").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        pieces = [(d, k, a, min(largest, n - a)) for d, _, n in rows for k, a in enumerate(range(0, max(n, 1), largest))]
        places, bins = best_fit([p[3] for p in pieces], sizes, attention)
        out = [(*p, shard, b, at, bins[b]) for p, (b, at) in zip(pieces, places)]
        return pa.Table.from_batches([A.pack_batch(out, _SCHEMA)])

    return go


def word_length() -> Column:
    """Words of the text: the default length."""
    return F.regexp_count(text_or_empty(), F.lit(WORD_SQL)).cast("long")


def pack(docs: DataFrame, length: Column | None = None, sizes: tuple = SIZES, attention: int = ATTENTION) -> DataFrame:
    """Documents (doc_id, text) -> a row per piece: doc_id, piece, piece_start, n_tokens, shard, bin, bin_offset, bin_size.

    ``length`` gives each document's length (null: 0); its words by default.  (shard, bin) names a sequence.
    """
    n = F.coalesce((word_length() if length is None else length).cast("long"), F.lit(0))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text_or_empty()).alias("h"), n.alias("n"))
    shards = max(1, -(-docs.select(F.lit(1)).count() // SHARD))
    dealt = rows.withColumn("shard", F.pmod("h", F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_packed(tuple(sizes), attention), _SQL)
