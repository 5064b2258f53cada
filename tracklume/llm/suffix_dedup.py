"""Exact removal of repeated byte strings by a Burrows-Wheeler index.

Candidates come from :mod:`anchors` (windows of ``window`` bytes dealt by their
least 32-byte gram, so equal windows meet in one task).  A task then builds the
Burrows-Wheeler transform of its distinct super-windows, each ended by a
terminator of its own, and derives common prefixes by increasing value: the
borders of level l are extended backward by every character that precedes
them, which gives the borders of level l + 1 (Beller et al., 2013), breadth
first and only where an interval's left border is new.  It stops at the
minimum length; what is then still undivided is an interval of suffixes that
share at least so many bytes.  In each, the earliest place stays.

Defined results: a null text is empty; a null id sorts before all others; rows
equal in id and text count as one document (each gets that document's result);
rows of one id with different texts are ordered by a hash of the text.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from ._common import NULL_ID, n_parts, text_or_empty

#: Bytes of text in one index; a larger group of super-windows is cut finer first.
BLOCK = 1 << 20


def _sorted_suffixes(codes: np.ndarray, ends: np.ndarray):
    """Suffix array by prefix doubling, terminators (0) ordered by place: the full order, whatever length is asked for later."""
    n = len(codes)
    width = 7  # symbols of 9 bits in a key
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([codes.astype(np.uint64), np.zeros(width, np.uint64)])
    left = ends - np.arange(n)  # symbols before the terminator
    for j in range(width):
        key = (key << np.uint64(9)) | np.where(left > j, padded[j : j + n], np.uint64(0))
    sa = np.argsort(key)
    short = left < width  # these end inside the key: ordered by place, each one alone
    k = key[sa]
    sub = np.flatnonzero(short[sa])
    if len(sub):
        fix = sa[sub]
        sa[sub] = fix[np.lexsort((fix, key[fix]))]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    alone = short[sa]
    new |= alone
    new[1:] |= alone[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.cumsum(new)
    h = width
    while True:
        # only members of undivided groups move, and only inside their group
        single = new & np.concatenate([new[1:], [True]])
        at = np.flatnonzero(~single)
        if not len(at):
            break
        members = sa[at]
        pair = (rank[members].astype(np.uint64) << np.uint64(32)) | rank[members + h].astype(np.uint64)  # they share h symbols, none a terminator
        order = np.argsort(pair)
        sa[at] = members[order]
        p = pair[order]
        new[at] |= np.concatenate([[True], p[1:] != p[:-1]])
        rank[sa] = np.cumsum(new)
        h *= 2
    return sa


def shared_prefix_intervals(texts: list[bytes], length: int):
    """(suffix array, borders, first place of each text): intervals between borders hold
    the suffixes that share at least ``length`` bytes.
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    n = int(firsts[-1])
    codes = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    codes[firsts[1:] - 1] = 0
    ends = np.repeat(firsts[1:] - 1, sizes)
    sa = _sorted_suffixes(codes, ends)
    bwt = codes[sa - 1]
    bwt[np.isin(sa, firsts[:-1])] = 0  # nothing precedes a text
    # LF and the previous row with the same character
    order = np.argsort(bwt, kind="stable")
    s = bwt[order]
    back = np.full(n, -1, np.int64)
    same = s[1:] == s[:-1]
    back[order[1:][same]] = order[:-1][same]
    first_symbol = codes[sa]
    begin = np.searchsorted(first_symbol, np.arange(258))
    within = np.arange(n) - np.searchsorted(s, np.arange(258))[s]
    lf = np.empty(n, np.int64)
    lf[order] = begin[s] + within
    live = bwt > 0
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    border[1:n] = first_symbol[1:] != first_symbol[:-1]
    border[: begin[1]] = True
    fresh = np.flatnonzero(border[:n])
    for _ in range(1, length):  # borders of common prefix 0 .. length - 1
        if not len(fresh):
            break
        edges = np.flatnonzero(border)
        wide = edges[np.searchsorted(edges, fresh) + 1] - fresh
        total = int(wide.sum())
        rows = np.repeat(fresh - (np.cumsum(wide) - wide), wide) + np.arange(total)
        rows = rows[(back[rows] < np.repeat(fresh, wide)) & live[rows]]
        to = lf[rows]
        to = to[~border[to]]
        border[to] = True
        fresh = np.sort(to)  # LF is one to one, so no place comes twice
    return sa, np.flatnonzero(border), firsts


def later_windows(texts: list[bytes], length: int):
    """(text, offset) of every window that occurs earlier in the list's order, in order of place."""
    sa, border, firsts = shared_prefix_intervals(texts, length)
    sizes = np.diff(border)
    least = np.minimum.reduceat(sa, border[:-1])
    later = sa[(np.repeat(sizes, sizes) > 1) & (sa != np.repeat(least, sizes))]
    later.sort()
    which = np.searchsorted(firsts, later, "right") - 1
    return which, later - firsts[which]


def _blocks(reps: list[tuple], window: int, level: int = 0):
    """Lists of super-windows in which equal windows are together, of about BLOCK bytes."""
    by: dict = {}
    for r in reps:
        by.setdefault(r[0], []).append(r)
    held, size = [], 0
    for rows in by.values():
        n = sum(len(r[6]) for r in rows)
        if n > 2 * BLOCK and level < 3 and len(rows) > 1:
            # deal this anchor's windows anew by another anchor, over longer grams
            finer, kind = [], A.Bytes(window, 64)
            salt = (0x5BD1E995 * (level + 1)) & 0xFF
            for i in range(0, len(rows), 2000):
                part = rows[i : i + 2000]
                mask = bytes(x ^ salt for x in range(256))
                doc, start, m, v, _ = A.runs(kind, [r[6].translate(mask) for r in part])
                for d, a, k, x in zip(doc.tolist(), start.tolist(), m.tolist(), v.tolist()):
                    _, k1, dk, at, _, rep, text = part[d]
                    finer.append((x, k1, dk, at + a, k, rep, text[a : a + k + window - 1]))
            yield from _blocks(finer, window, level + 1)
            continue
        held += rows
        size += n
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def first_kept(rows: list[tuple]):
    """Fold for equal super-windows: the earliest is sent, the later ones are repeats as a whole."""
    rows = sorted(rows, key=lambda r: r[1:4])
    place = rows[0][1:4]
    return rows[0], [r for r in rows[1:] if r[1:4] != place]


def judge(window: int):
    def go(rows: list[tuple]):
        same: dict[bytes, list] = {}
        for r in rows:
            same.setdefault(r[6], []).append(r)
        reps, count = [], {}
        for copies in same.values():
            rep, gone = first_kept(copies)
            reps.append(rep)
            count[rep[0]] = count.get(rep[0], 0) + 1
            for r in gone:
                yield r[1], r[2], r[3], r[3] + r[4] + window - 1
        del same
        reps = [r for r in reps if count[r[0]] > 1]  # the windows of one super-window have their anchor at different offsets
        for block in _blocks(reps, window):
            block.sort(key=lambda r: r[1:4])
            which, at = later_windows([r[6] for r in block], window)
            if not len(which):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1), [True]]))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                r = block[which[i]]
                yield r[1], r[2], r[3] + int(at[i]), r[3] + int(at[j - 1]) + window

    return go


def _kept(arrow):
    for b in arrow:
        for i in range(0, b.num_rows, 500):
            held = [b.slice(i, 500)]
            docs, k1s = [x or b"" for x in A.column(held, "text")], A.numbers(held, "k1").tolist()
            out = []
            for doc_id, k1, doc, spans in zip(A.column(held, "doc_id"), k1s, docs, A.column(held, "spans")):
                gone = A.covered(spans, k1, len(doc), 0)
                if gone is None:
                    out.append((doc_id, len(doc), 0, 0, doc))
                    continue
                starts = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
                out.append((doc_id, len(doc), int(gone.sum()), starts, np.frombuffer(doc, np.uint8)[~gone].tobytes()))
            yield A.pack_batch(out, _KEPT)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _digests(arrow):
    for b in _kept(arrow):
        sha = [hashlib.sha256(x).hexdigest() for x in b.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sha, pa.string())], names=[*b.schema.names[:4], "kept_sha256"])


def spans_of(base: DataFrame, kind, fold, judged, feedback: DataFrame) -> DataFrame:
    """Documents (k1, dk, text) and back packs of their recurring anchors -> (dk, spans)."""
    n = n_parts(base.sparkSession)
    back = feedback.repartition(n, "part").mapInArrow(A.gathered(1), A.BACK_SQL).withColumnRenamed("body", "back")
    packs = base.join(back, "dk").select("k1", "dk", "text", "back").mapInArrow(A.segment_packs(kind, 4 * n, fold), A.PACK_SQL)
    found = packs.repartition(n, "part").mapInArrow(A.judged_segments(judged, 4 * n), A.PACK_SQL)
    return found.repartition(n, "part").mapInArrow(A.gathered(3), A.BACK_SQL).withColumnRenamed("body", "spans")


def _base(docs: DataFrame) -> DataFrame:
    """(k1, dk, text); both joins read the same shuffle of it."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(NULL_ID)).alias("k1"), F.xxhash64(doc_id, text_or_empty()).alias("dk"), text_or_empty().alias("text"))


def with_id(rows: DataFrame) -> DataFrame:
    return rows.select(F.when(F.col("k1") != NULL_ID, F.col("k1")).alias("doc_id"), "k1", "text", "spans")


def _removed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    spark = docs.sparkSession
    n, kind = n_parts(spark), A.Bytes(window, gram)
    base = _base(docs)
    packs = base.select("dk", "text").mapInArrow(A.anchor_packs(kind, 4 * n), A.PACK_SQL)
    feedback = packs.repartition(n, "part").mapInArrow(A.recurring_anchors(4 * n), A.PACK_SQL)
    spans = spans_of(base, kind, first_kept, judge(window), feedback)
    return with_id(base.join(spans, "dk", "left"))


def suffix_dedup(docs: DataFrame, window: int = 100, gram: int = 32) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept binary).

    Each byte covered by a ``window``-byte string that also starts earlier (smaller id, or
    same document and earlier start) goes.  ``gram`` is a power of two below ``window``.
    """
    return _removed(docs, window, gram).mapInArrow(A.in_pieces(_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_dedup_digest(docs: DataFrame, window: int = 100, gram: int = 32) -> DataFrame:
    """As :func:`suffix_dedup`, with the SHA-256 of what is kept in place of the bytes."""
    return _removed(docs, window, gram).mapInArrow(A.in_pieces(_digests), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
