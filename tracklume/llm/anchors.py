"""Candidate search for repeated passages: anchors, super-windows, spans.

Both passage operators ask which windows of L symbols (bytes or words) occur
more than once.  Every window has an anchor: the leftmost least hash of the
k-grams it contains.  Equal windows have equal anchors at equal offsets, so

1. each document gives its anchors (``anchor_packs``); an anchor that occurs
   once cannot belong to a repeated window;
2. the anchors that recur go back to their documents (back packs);
3. documents cut the runs of windows that share a recurring anchor
   (super-windows) and deal them by anchor (``segment_packs``), so equal windows
   meet in one task and nothing else has to;
4. the operator judges the windows there and sends spans back.

Rows in the shuffles are packs: arrays of one bucket from one batch of
documents.  Anchors or super-windows that repeat inside a batch are folded
before they leave the task, so an anchor that a third of all documents share
costs at most one record per batch, not one per document.
Nothing is capped or sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

from ._common import WORD, mixed

#: Bytes of text that a task gathers before it hands out packs.
BATCH_BYTES = 3 << 20
#: Low bits of an anchor's sort key: its place among the batch's symbols.
PLACE = np.uint64((1 << 28) - 1)

PACK = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("dk", pa.int64()), ("body", pa.binary())])
FEEDBACK = pa.schema([("dk", pa.int64()), ("body", pa.binary())])
PACK_SQL = "part long, kind int, dk long, body binary"
BACK_SQL = "dk long, body binary"

BODY, BACK = 0, 1


class Bytes:
    """Documents as bytes."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def symbols(self, doc: bytes):
        return np.frombuffer(doc, np.uint8).astype(np.uint64), None

    def cut(self, doc: bytes, places, start: int, end: int) -> bytes:
        return doc[start:end]


class Words:
    """Documents as words; a symbol is a word's XXH64, a cut is words joined by one space."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def symbols(self, doc: bytes):
        words = WORD.findall(doc)
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), words

    def cut(self, doc: bytes, places, start: int, end: int) -> bytes:
        return b" ".join(places[start:end])


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each place (k a power of two), by doubling; shorter at the end."""
    h = mixed(symbols + np.uint64(0x9E3779B97F4A7C15))
    m, odd = 1, np.uint64(0xD6E8FEB86659FD93)
    while m < k:
        n = len(h) - m
        h = h[:n] * odd + h[m:]
        h ^= h >> np.uint64(29)
        odd = np.uint64((int(odd) * int(odd) + 2 * m) & 0xFFFFFFFFFFFFFFFF | 1)
        m *= 2
    return mixed(h)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of h[i : i + w], for every i that has so many."""
    m = 1
    while 2 * m <= w:
        h = np.minimum(h[: len(h) - m], h[m:])
        m *= 2
    return np.minimum(h[: len(h) - (w - m)], h[w - m :]) if w > m else h


def runs(kind, docs: list[bytes], want: set | None = None):
    """Runs of consecutive windows of one document with the same anchor at the same place.

    Returns (doc, start, windows, anchor) arrays and each document's places.
    """
    parts, places, owner, firsts = [], [], [], []
    need = kind.window
    at = 0
    for i, d in enumerate(docs):
        if len(d) < need:  # a word has at least a byte, so this holds for both kinds
            places.append(None)
            continue
        s, p = kind.symbols(d)
        places.append(p)
        if len(s) < need:
            continue
        parts.append(s)
        owner.append(i)
        firsts.append(at)
        at += len(s)
    none = np.zeros(0, np.int64)
    if not parts:
        return none, none, none, np.zeros(0, np.uint64), places
    symbols = np.concatenate(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    owner, firsts = np.array(owner), np.array(firsts)
    del parts
    h = gram_hashes(symbols, kind.gram)
    # the leftmost least gram: high bits of the hash, then the place; windows over a document's end are masked below
    if len(h) > int(PLACE):
        raise ValueError(f"one batch holds {len(h)} symbols; places have {int(PLACE).bit_length()} bits")
    low = sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), need - kind.gram + 1)
    ok = np.zeros(len(low) + 1, bool)
    edge = np.zeros(len(low) + 1, bool)
    edge[1 : len(low)] = low[1:] != low[:-1]
    edge[firsts[firsts <= len(low)]] = True
    steps = np.zeros(len(low) + 1, np.int32)
    np.add.at(steps, firsts, 1)
    np.add.at(steps, firsts + sizes - need + 1, -1)
    ok = np.cumsum(steps) > 0
    edge |= np.concatenate([[True], ok[1:] != ok[:-1]])
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(low))
    keep = ok[starts] & (starts < len(low))
    starts, ends = starts[keep], ends[keep]
    which = np.searchsorted(firsts, starts, "right") - 1
    return owner[which], starts - firsts[which], ends - starts, h[(low[starts] & PLACE).astype(np.int64)], places


def pieces(arrow, size: int = BATCH_BYTES, rows: int = 1000):
    """Arrow batches cut to about so many bytes and rows at most, whatever the session's batch size is."""
    for b in arrow:
        step = max(1, min(rows, b.num_rows * size // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def in_pieces(go, size: int = BATCH_BYTES, rows: int = 1000):
    """A mapInArrow function over such pieces."""
    return lambda arrow: go(pieces(arrow, size, rows))


def batches(arrow, size: int = BATCH_BYTES):
    """Lists of Arrow batches with about so many bytes."""
    held, n = [], 0
    for b in pieces(arrow, size):
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def column(held: list[pa.RecordBatch], name: str) -> list:
    out = []
    for b in held:
        c = b.column(b.schema.get_field_index(name))
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            c = c.cast(pa.large_binary())
        out.extend(c.to_pylist())
    return out


def numbers(held: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for b in held])


def joined(*arrays: np.ndarray) -> bytes:
    """Arrays in one body: their lengths, then their bytes."""
    return np.array([a.nbytes for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def taken(body: bytes, kinds: tuple) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(body, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(body, kind, int(n) // np.dtype(kind).itemsize, at))
        at += int(n)
    return out


def groups_of(keys: np.ndarray):
    """Order that sorts keys, and the first place of each key in it (with the end)."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else np.zeros(1, np.int64)
    return order, first


def back_packs(keys: np.ndarray, values: np.ndarray, parts: int) -> list[tuple]:
    """Packs that carry values (rows of 64-bit numbers) to their documents, dealt by document key."""
    bucket = keys.view(np.uint64) % np.uint64(parts)
    order = np.lexsort((keys, bucket))
    keys, values, bucket = keys[order], values[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    out = []
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
        body = joined(keys[x:y], np.ascontiguousarray(values[x:y]).reshape(-1).view(np.int64))
        out.append((int(bucket[x]), BACK, 0, zstandard.compress(body, 1)))
    return out


def gathered(width: int):
    """mapInArrow behind a shuffle by bucket: back packs -> one row (dk, body) per document; a value has ``width`` numbers."""

    def go(arrow):
        keys, values = [], []
        for b in arrow:
            for body in b.column(3).to_pylist():
                k, v = taken(zstandard.decompress(body), (np.int64, np.int64))
                keys.append(k)
                values.append(v.reshape(-1, width))
        if not keys:
            return
        key, value = np.concatenate(keys), np.concatenate(values)
        order, first = groups_of(key)
        key, value = key[order], value[order]
        for i in range(0, len(first) - 1, 10_000):
            cut = first[i : i + 10_001].tolist()
            yield pack_batch([(int(key[x]), value[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:])], FEEDBACK)

    return go


def pack_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def anchor_packs(kind, parts: int):
    """mapInArrow function: documents (dk, text) -> packs of anchors.

    A body holds the anchors that occur once in the batch with their documents, and the
    anchors that recur inside the batch alone; those go back to their documents at once.
    """

    def go(arrow):
        for held in batches(arrow):
            dks = numbers(held, "dk").astype(np.int64)
            doc, _, _, values, _ = runs(kind, [x or b"" for x in column(held, "text")])
            order, first = groups_of(values)
            sizes = np.diff(first)
            single = order[first[:-1][sizes == 1]]
            many = np.repeat(sizes > 1, sizes)
            twice = order[many]
            known = values[order[first[:-1][sizes > 1]]]
            out = []
            if len(twice):
                out += back_packs(dks[doc[twice]], values[twice], parts)
            bucket_1, bucket_2 = values[single] % np.uint64(parts), known % np.uint64(parts)
            o1, o2 = np.argsort(bucket_1, kind="stable"), np.argsort(bucket_2, kind="stable")
            cut1 = np.searchsorted(bucket_1[o1], np.arange(parts + 1, dtype=np.uint64))
            cut2 = np.searchsorted(bucket_2[o2], np.arange(parts + 1, dtype=np.uint64))
            v1, d1, v2 = values[single][o1], dks[doc[single]][o1], known[o2]
            for p in range(parts):
                a, b, c, d = cut1[p], cut1[p + 1], cut2[p], cut2[p + 1]
                if b > a or d > c:
                    out.append((p, BODY, 0, joined(v1[a:b], d1[a:b], v2[c:d])))
            yield pack_batch(out, PACK)

    return go


ANCHORS = (np.uint64, np.int64, np.uint64)


def recurring(bodies: list[bytes]):
    """Of anchor bodies of one bucket: (anchors, document keys) of all listed postings whose anchor recurs."""
    got = [taken(b, ANCHORS) for b in bodies]
    values, dks = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    known = np.concatenate([g[2] for g in got])
    order, first = groups_of(values)
    many = np.repeat(np.diff(first) > 1, np.diff(first))
    s = values[order]
    if len(known):
        many |= np.isin(s, known)
    return s[many], dks[order][many]


def recurring_anchors(parts: int):
    """mapInArrow function behind the shuffle by bucket: packs -> back packs."""

    def go(arrow):
        bodies: dict[int, list[bytes]] = {}
        for b in arrow:
            out = []
            for part, kind, dk, body in zip(*(c.to_pylist() for c in b.columns)):
                if kind == BACK:
                    out.append((part, BACK, dk, body))
                else:
                    bodies.setdefault(part, []).append(body)
            if out:
                yield pack_batch(out, PACK)
        values, dks = [], []
        for part in list(bodies):
            v, d = recurring(bodies.pop(part))
            values.append(v)
            dks.append(d)
        if values:
            yield pack_batch(back_packs(np.concatenate(dks), np.concatenate(values), parts), PACK)

    return go


class Segments:
    """Super-windows in columns: anchor, place (k1, dk, start), windows, whether it recurs, text."""

    KINDS = (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint8, np.int64, np.uint8)

    @staticmethod
    def body(rows: list[tuple]) -> bytes:
        v, k1, dk, start, n, rep, text = zip(*rows)
        packed = zstandard.compress(b"".join(text), 1)
        return joined(np.array(v, np.uint64), *(np.array(x, np.int64) for x in (k1, dk, start, n)), np.array(rep, np.uint8), np.fromiter(map(len, text), np.int64, len(text)), np.frombuffer(packed, np.uint8))

    @classmethod
    def read(cls, body: bytes) -> list[tuple]:
        *cols, sizes, packed = taken(body, cls.KINDS)
        text = zstandard.decompress(packed.tobytes(), max_output_size=max(1, int(sizes.sum())))
        ends = np.cumsum(sizes)
        return list(zip(*(c.tolist() for c in cols), [text[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]))


def segment_packs(kind, parts: int, fold):
    """mapInArrow function: documents with feedback (k1, dk, text, back) -> packs of super-windows.

    ``fold(rows)`` takes super-windows of one text and returns (the one to send, those
    judged removed at once).
    """

    def go(arrow):
        for held in batches(arrow):
            docs = [x or b"" for x in column(held, "text")]
            k1s, dks = numbers(held, "k1").astype(np.int64).tolist(), numbers(held, "dk").astype(np.int64).tolist()
            want = np.unique(np.frombuffer(b"".join(column(held, "back")), np.uint64))
            doc, start, n, values, places = runs(kind, docs)
            keep = np.isin(values, want)
            same: dict[bytes, list] = {}
            w = kind.window - 1
            for i, a, m, v in zip(doc[keep].tolist(), start[keep].tolist(), n[keep].tolist(), values[keep].tolist()):
                text = kind.cut(docs[i], places[i], a, a + m + w)
                same.setdefault(text, []).append((v, k1s[i], dks[i], a, m, 0))
            spans, deal = [], {}
            for text, rows in same.items():
                sent, gone = fold(rows)
                deal.setdefault(sent[0] % parts, []).append((*sent, text))
                spans += [(r[1], r[2], r[3], r[3] + r[4] + w) for r in gone]
            out = span_packs(spans, parts)
            out += [(p, BODY, 0, Segments.body(rows)) for p, rows in deal.items()]
            yield pack_batch(out, PACK)

    return go


def span_packs(spans: list[tuple], parts: int) -> list[tuple]:
    """Spans (k1, dk, start, end) as back packs."""
    if not spans:
        return []
    rows = np.array(spans, np.int64)
    return back_packs(rows[:, 1].copy(), rows[:, [0, 2, 3]], parts)


def judged_segments(judge, parts: int):
    """mapInArrow function behind the shuffle: packs of super-windows -> back packs of spans.

    ``judge(rows)`` gets all super-windows of the task's buckets and yields (k1, dk, start, end).
    """

    def go(arrow):
        rows = []
        for b in arrow:
            out = []
            for part, kind, dk, body in zip(*(c.to_pylist() for c in b.columns)):
                if kind == BACK:
                    out.append((part, BACK, dk, body))
                else:
                    rows.extend(Segments.read(body))
            if out:
                yield pack_batch(out, PACK)
        yield pack_batch(span_packs(list(judge(rows)), parts), PACK)

    return go


def covered(body: bytes | None, k1: int, n: int, window: int) -> np.ndarray | None:
    """Which of the document's n symbols the spans cover; None if none.  A span that ends beyond the document means all of it, if it has a window."""
    if not body:
        return None
    spans = np.frombuffer(body, np.int64).reshape(-1, 3)
    spans = spans[spans[:, 0] == k1]
    if (spans[:, 2] > n).any():
        if n >= window:
            return np.ones(n, bool)
        spans = spans[spans[:, 2] <= n]
    if not len(spans):
        return None
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, spans[:, 1], 1)
    np.add.at(steps, spans[:, 2], -1)
    return np.cumsum(steps[:n]) > 0
