"""SimHash near-duplicates found by deletion-variant signatures.

A fingerprint of B bits is cut into S segments.  If two fingerprints differ in at
most 2 S - 1 bits, one segment differs by at most one bit; then both have a
variant of that segment in common in which one bit is a wildcard.  Every
distinct fingerprint is indexed under all one-wildcard variants of its
segments, an equality join brings the candidates together, and each candidate
pair is verified on the whole fingerprint.  With B = 64, S = 2 and at most 3
bits no link is lost.

:func:`keep_representatives` takes wider fingerprints for candidates only: within each
component of candidates it compares the shingle sets themselves, and a link is a
Jaccard similarity of at least the threshold.  A large component is cut in blocks, and
each pair of blocks is a group of its own.

Groups of candidates are never expanded into links of all pairs: a task gives a
spanning forest of the links it has verified, and :mod:`components` joins the
forests.  A large group is first divided again by variants of the bits that its
key leaves open.

Defined results: a null or wordless text has fingerprint zero, which links like
any other; rows with equal texts have one fingerprint; a component's id is its
least document id, null only if all its ids are null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from ._common import WORD, fresh, mixed, n_parts, shared_path, text_or_empty
from .components import components

#: Shingles of one document that are counted at once.
CHUNK = 1 << 15
#: Members of a group that are compared pair by pair; beyond, the group is divided first.
GROUP = 4096
#: Rows of one block of comparisons.
BLOCK = 1024
#: Members of one block of a candidate component whose shingle sets are compared.
SETS = 512


def shingles(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each of the text's shingles; a text of fewer words is one shingle, without words none."""
    found = WORD.findall(text.lower())
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    whole = b" ".join(found)
    size = min(words, n)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    m = n - size + 1
    intdigest = xxhash.xxh64_intdigest
    return np.fromiter([intdigest(whole[a:b], seed) for a, b in zip(starts[:m].tolist(), ends[size - 1 :].tolist())], np.uint64, m)


def fingerprint(text: bytes, words: int, seed: int, width: int, as_set: bool = False) -> bytes:
    """The text's SimHash in ``width`` 64-bit words, big-endian; the first word is by XXH64 alone.

    With ``as_set`` a shingle counts once, and a hash of the set follows as a last word.
    """
    h = shingles(text, words, seed)
    if not len(h):
        return bytes(8 * (width + as_set))
    if as_set:
        h = np.unique(h)
    m = len(h)
    out = []
    for k in range(width):
        g = h if k == 0 else mixed(h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF))
        count = np.zeros(64, np.int64)
        for i in range(0, m, CHUNK):
            bits = np.unpackbits(g[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            count += bits.sum(axis=0, dtype=np.uint32)
        out.append(np.packbits(2 * count > m).tobytes())
    if as_set:
        out.append(xxhash.xxh64_digest(h.tobytes(), seed))
    return b"".join(out)


def _fingerprints(name: str, at: str, words: int, seed: int, width: int, as_set: bool = False):
    def go(arrow):
        for b in arrow:
            texts = A.column([b], name)
            rest = [(n, c) for n, c in zip(b.schema.names, b.columns) if n != name]
            fps = [fingerprint(x or b"", words, seed, width, as_set) for x in texts]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(fps, pa.binary())], names=[*(n for n, _ in rest), at])

    return go


def _words_of(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1)


def _variants(fp: np.ndarray, segments: int, bits: int):
    """(key, row) of all one-wildcard variants; segments are taken from the left, ``bits`` bits each."""
    rows = np.arange(len(fp))
    for s in range(segments):
        part = _segment(fp, s, bits)
        for j in range(bits):
            yield _variant(part, s, j, bits), rows


def _segment(fp: np.ndarray, s: int, bits: int) -> np.ndarray:
    word, shift = divmod(s * bits, 64)
    assert shift + bits <= 64, "a segment may not cross two 64-bit words"
    return (fp[:, word] >> np.uint64(64 - shift - bits)) & np.uint64((1 << bits) - 1)


def _variant(part: np.ndarray, s: int, j: int, bits: int) -> np.ndarray:
    return mixed((part & ~np.uint64(1 << j)) | (np.uint64(s * bits + j + 1) << np.uint64(bits)))


def _index_packs(parts: int, segments: int, bits: int):
    """mapInArrow: distinct fingerprints -> packs (bucket, fingerprints, keys, row of each key)."""

    def go(arrow):
        for held in A.batches(arrow, 1 << 18):
            fp = _words_of(A.column(held, "fp"))
            keys, rows = map(np.concatenate, zip(*_variants(fp, segments, bits)))
            bucket = keys % np.uint64(parts)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(parts + 1, dtype=np.uint64))
            out = []
            for p in range(parts):
                o = order[cut[p] : cut[p + 1]]
                if len(o):
                    used, at = np.unique(rows[o], return_inverse=True)
                    out.append((p, A.BODY, 0, A.joined(fp[used].reshape(-1), keys[o], at.astype(np.uint32))))
            yield A.pack_batch(out, A.PACK)

    return go


def _half_packs(parts: int, segments: int, bits: int):
    """The same, dealt by the half of a segment that the wildcard leaves whole: packs (bucket, fingerprints, halves, row of each).

    The receiver derives the keys, so a fingerprint goes to two buckets a segment instead of one a variant.
    """
    half = bits // 2

    def go(arrow):
        for held in A.batches(arrow, 1 << 18):
            fp = _words_of(A.column(held, "fp"))
            halves, bucket = [], []
            for s in range(segments):
                part = _segment(fp, s, bits)
                for low, whole in enumerate((part >> np.uint64(half), part & np.uint64((1 << half) - 1))):
                    halves.append(np.full(len(fp), 2 * s + low, np.uint16))
                    bucket.append(mixed(whole | (np.uint64(2 * s + low + 1) << np.uint64(bits))) % np.uint64(parts))
            rows, halves, bucket = np.tile(np.arange(len(fp)), 2 * segments), np.concatenate(halves), np.concatenate(bucket)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(parts + 1, dtype=np.uint64))
            out = []
            for p in range(parts):
                o = order[cut[p] : cut[p + 1]]
                if len(o):
                    used, at = np.unique(rows[o], return_inverse=True)
                    out.append((p, A.BODY, 0, A.joined(fp[used].reshape(-1), halves[o], at.astype(np.uint32))))
            yield A.pack_batch(out, A.PACK)

    return go


def _half_keys(fp: np.ndarray, halves: np.ndarray, rows: np.ndarray, bits: int):
    """The variants (key, row) whose wildcard is outside of the half that was dealt."""
    keys, at = [], []
    for c in np.unique(halves).tolist():
        s, low = divmod(c, 2)
        some = rows[halves == c]
        part = _segment(fp[some], s, bits)
        for j in range(bits // 2, bits) if low else range(bits // 2):
            keys.append(_variant(part, s, j, bits))
            at.append(some)
    return np.concatenate(keys), np.concatenate(at)


def _roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i]; a label is its class's least row."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _link_group(fp: np.ndarray, members: np.ndarray, most: int, depth: int = 0) -> np.ndarray:
    """For each member the least index of a member that links connect it with."""
    n = len(members)
    labels = np.arange(n)
    if n > GROUP and depth == 0 and fp.shape[1] == 1 and most <= 3:
        # both 32-bit halves: at most 3 bits differ in each, so one of its 16-bit quarters differs by at most one
        v = fp[members, 0]
        same_left = len(np.unique(v >> np.uint64(32))) <= len(np.unique(v & np.uint64(0xFFFFFFFF)))
        open_ = (v & np.uint64(0xFFFFFFFF)) if same_left else (v >> np.uint64(32))
        for quarter in (open_ >> np.uint64(16), open_ & np.uint64(0xFFFF)):
            for j in range(16):
                order, first = A.groups_of(quarter & ~np.uint64(1 << j))
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    if b - a > 1:
                        some = order[a:b]
                        _roots(labels, some, some[_link_group(fp, members[some], most, 1)])
        return labels
    for i in range(0, n, BLOCK):
        left = members[i : i + BLOCK]
        for k in range(i, n, BLOCK):
            right = members[k : k + BLOCK]
            x, y = np.nonzero(_apart(fp[left][:, None, :], fp[right][None, :, :]) <= most)
            _roots(labels, x + i, y + k)
    return labels


def _links(most: int, width: int, half_bits: int = 0):
    """mapInArrow behind the shuffle: packs -> spanning forest of verified links (a, b).

    With ``half_bits`` the packs are of halves of segments of so many bits, and a word of no distance follows the fingerprint.
    """
    words = width + bool(half_bits)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def go(arrow):
        fps, keys, rows, n = [], [], [], 0
        for batch in arrow:
            for body in batch.column(3).to_pylist():
                f, k, r = A.taken(body, (np.uint64, np.uint16 if half_bits else np.uint64, np.uint32))
                fps.append(f.reshape(-1, words))
                keys.append(k)
                rows.append(r.astype(np.int64) + n)
                n += len(fps[-1])
        if not fps:
            return
        fp, keys, rows = np.concatenate(fps), np.concatenate(keys), np.concatenate(rows)
        # copies of a fingerprint from several packs become one row
        fp, to = np.unique(fp, axis=0, return_inverse=True) if words > 1 else _unique_1(fp)
        rows = to.reshape(-1)[rows]
        if half_bits:
            keys, rows = _half_keys(fp, keys, rows, half_bits)
        raw, fp = fp.astype(">u8"), fp[:, :width]
        labels = np.arange(len(fp))
        order = np.lexsort((rows, keys))
        keys, rows = keys[order], rows[order]
        again = np.concatenate([[False], (keys[1:] == keys[:-1]) & (rows[1:] == rows[:-1])])
        keys, rows = keys[~again], rows[~again]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        size = np.diff(first)
        large = size > 64
        for a, m in zip(first[:-1][large].tolist(), size[large].tolist()):
            some = rows[a : a + m]
            if not half_bits or (labels[some] != labels[some[0]]).any():
                _roots(labels, some, some[_link_group(fp, some, most)])
        # small groups: the k-th next member of the same key, for all groups at once
        small = np.repeat(~large, size)
        keys, rows = keys[small], rows[small]
        for k in range(1, int(size[~large].max(initial=1))):
            at = np.flatnonzero(keys[k:] == keys[:-k])
            for i in range(0, len(at), 1 << 18):
                a, b = rows[at[i : i + (1 << 18)]], rows[at[i : i + (1 << 18)] + k]
                near = _apart(fp[a], fp[b]) <= most
                _roots(labels, a[near], b[near])
        moved = np.flatnonzero(labels != np.arange(len(fp)))
        for i in range(0, len(moved), 20_000):
            m = moved[i : i + 20_000]
            yield A.pack_batch([(raw[x].tobytes(), raw[y].tobytes()) for x, y in zip(m, labels[m])], schema)

    return go


def _unique_1(fp: np.ndarray):
    u, to = np.unique(fp[:, 0], return_inverse=True)
    return u[:, None], to


def linked(fps: DataFrame, most: int, width: int, segments: int, bits: int, as_set: bool = False) -> DataFrame:
    """Distinct fingerprints (fp binary) -> (node, root) for those that link with another one."""
    parts = n_parts(fps.sparkSession)
    if as_set:
        packs = fps.select("fp").mapInArrow(_half_packs(2 * parts, segments, bits), A.PACK_SQL)
        return components(packs.repartition(parts, "part").mapInArrow(_links(most, width, bits), "a binary, b binary"))
    packs = fps.select("fp").mapInArrow(_index_packs(2 * parts, segments, bits), A.PACK_SQL)
    return components(packs.repartition(parts, "part").mapInArrow(_links(most, width), "a binary, b binary"))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, width: int = 1) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, fp binary)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(A.in_pieces(_fingerprints("text", "fp", words, seed, width)), "doc_id long, fp binary")


def _stored(df: DataFrame, name: str) -> DataFrame:
    at = shared_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def simhash_components(docs: DataFrame, words: int = 3, most: int = 3, seed: int = 42) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, fingerprint, component_id): exact for 64 bits and ``most`` up to 3."""
    if most > 3:
        raise ValueError("two 32-bit segments find links of up to 3 bits")
    rows = _stored(fingerprints(docs, words, seed), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = linked(first, most, 1, 2, 32)
    named = classes.join(first, classes.node == first.fp).select("node", "root", "first")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    least = named.join(least, "root").select(F.col("node").alias("fp"), "least")
    ids = first.join(least, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(ids, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _similar(fp: np.ndarray, sets: list[set], most: int, similarity: float):
    """Spanning forest (x, y) of the pairs whose fingerprints are near and whose sets are similar enough."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(0, len(sets), BLOCK // 4):
        left = np.arange(i, min(i + BLOCK // 4, len(sets)))
        d = _apart(fp[left][:, None, :], fp[None, :, :])
        less, more = np.minimum(sizes[left][:, None], sizes), np.maximum(sizes[left][:, None], sizes)
        x, y = np.nonzero((d <= most) & (np.arange(len(sets)) > left[:, None]) & (less / more >= similarity))
        nearest = np.argsort(d[x, y], kind="stable")
        for a, b in zip((x[nearest] + i).tolist(), y[nearest].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                both = len(sets[a] & sets[b])
                if both / (len(sets[a]) + len(sets[b]) - both) >= similarity:
                    parent[max(ra, rb)] = min(ra, rb)
                    yield a, b


def _compared(words: int, seed: int, width: int, most: int, similarity: float):
    """mapInArrow of rows (root, i, j, fp, text) in order of their groups -> verified links (a, b)."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def go(arrow):
        now, fps, sets = None, [], []

        def links():
            if len(fps) > 1:
                fp = _words_of(fps)[:, :width]
                return [(fps[x], fps[y]) for x, y in _similar(fp, sets, most, similarity)]
            return []

        for batch in arrow:
            out = []
            root, i, j, fp = (batch.column(k).to_pylist() for k in range(4))
            for group, f, text in zip(zip(root, i, j), fp, A.column([batch], "text")):
                if group != now:
                    out += links()
                    now, fps, sets = group, [], []
                fps.append(f)
                sets.append(set(shingles(text or b"", words, seed).tolist()))
            yield A.pack_batch(out, schema)
        yield A.pack_batch(links(), schema)

    return go


def verified(texts: DataFrame, candidates: DataFrame, words: int, seed: int, width: int, most: int, similarity: float) -> DataFrame:
    """Candidates (node, root, o) and texts (fp, o, text) -> (node, root) by the Jaccard similarity of shingle sets.

    (node, o) names the row whose text stands for the node.  The groups' keys go to the texts, so
    only texts that are compared are moved, once.
    """
    blocks = candidates.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / SETS).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = candidates.join(blocks, "root").select("node", "o", "root", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("node").alias("fp"), "o")
    rows = dealt.join(texts, ["fp", "o"]).dropDuplicates(["fp", "o", "root", "i", "j"]).select("root", "i", "j", "fp", "text")
    grouped = rows.repartition(n_parts(texts.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return components(grouped.mapInArrow(A.in_pieces(_compared(words, seed, width, most, similarity)), "a binary, b binary"))


def bits_for(similarity: float, width: int) -> int:
    """Differing bits, of 64 * width, that shingle sets of this Jaccard similarity have at most, with three standard deviations to spare.

    The sets' cosine is 2 s / (1 + s), the chance of a differing bit its angle over pi.
    """
    n = 64 * width
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(n * p + 3 * math.sqrt(n * p * (1 - p)))


def keep_representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42, width: int = 4, segments: int = 16, bits: int = 16) -> DataFrame:
    """The same documents and columns; of each near-duplicate group the row of least id stays.

    Groups are components of links: two texts link if the Jaccard similarity of their sets of
    ``words``-word shingles, which are compared themselves, is at least ``similarity``.
    Fingerprints of ``64 * width`` bits only find the candidates.  With so wide a fingerprint
    one segment of ``bits`` bits differs by at most a bit, and the whole by no more than the
    radius, with a probability that the defaults put at 0.99 for a pair of similarity 0.8
    and above 0.999 from 0.9.  Texts without words are not duplicates of one another and all stay; of
    rows of one group with equal least id, the first by a hash of the text stays, and of equal rows one.
    """
    fp, order, at = fresh(docs, "fp", "order", "text")
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select("*", text_or_empty().alias(at)).mapInArrow(
        A.in_pieces(_fingerprints(at, fp, words, seed, width, True)), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"{fp} binary"])
    )
    rows = _stored(rows, "fingerprinted")
    empty = F.hex(fp).rlike("^0+$")
    some = rows.where(~empty).select(F.col(fp).alias("fp"), F.struct(doc_id.isNull().alias("n"), doc_id.alias("i"), F.xxhash64(text_or_empty()).alias("h")).alias("o"))
    first = some.groupBy("fp").agg(F.min("o").alias("o"))
    most = bits_for(similarity, width)
    candidates = linked(first, most, width, segments, bits, True)
    wanted = first.join(candidates, first.fp == candidates.node).select("node", "root", "o")
    texts = rows.where(~empty).select(F.col(fp).alias("fp"), F.struct(doc_id.isNull().alias("n"), doc_id.alias("i"), F.xxhash64(text_or_empty()).alias("h")).alias("o"), text_or_empty().alias("text"))
    classes = verified(texts, wanted, words, seed, width, most, similarity)
    named = first.join(classes, first.fp == classes.node, "left").select("fp", "o", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min(F.struct("o", "fp")).alias("b")).select(F.col("b.fp").alias("fp"), F.col("b.o").alias("o"))
    # joined by the row's own key beside the fingerprint, so copies of one text do not meet in one task
    named_rows = rows.where(~empty).withColumn(order, F.struct(doc_id.isNull().alias("n"), doc_id.alias("i"), F.xxhash64(text_or_empty()).alias("h")))
    kept = named_rows.join(best.select(F.col("fp").alias(fp), F.col("o").alias(order)), [fp, order]).dropDuplicates([fp, order])
    return kept.select(docs.columns).unionByName(rows.where(empty).select(docs.columns))
