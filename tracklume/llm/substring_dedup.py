"""Incremental removal of repeated word passages with a log-structured fingerprint index.

The index is a set of immutable runs.  A run is a table bucketed by a fingerprint's bucket
that holds, for each bucket, one sorted array of the window fingerprints of one batch of
documents with the documents that have them.  Every window of ``window`` words has one: the
least hash of its 8-word grams (see :mod:`anchors`), so equal windows have equal fingerprints.
A new batch is written as a run and merge-joined with the older runs, bucket by bucket: they have the
same bucketing, so the history is read in place and never shuffled or sorted again.
Fingerprints that meet are candidates, in the new documents and in the old ones; candidates
are verified on the words themselves.  When there are too many runs they are merged into one, again bucket by bucket.

A manifest beside the runs names them, so an index can be opened again and later batches
deduplicated against it; it then keeps its documents too, for their words are what is verified.

Defined results: a null text has no words; each row counts, so of equal rows every
window recurs; a null id is a document id like any other; an empty table gives
an empty result.  Columns other than doc_id and text pass through
:func:`remove_repeats` unchanged.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors as A
from ._common import NULL_ID, WORD, fresh, n_parts, shared_path, text_or_empty
from .suffix_dedup import _base, spans_of, with_id

#: The key of documents is 64 bits of a hash; places also hold the id, so documents of equal keys are told apart by it.
DOCS_SQL = "k1 long, dk long, text string"


def _sorted_run(parts: int):
    """mapInArrow behind the shuffle by bucket: packs of one batch -> one sorted body per bucket; packs that go back pass through."""

    def go(arrow):
        bodies: dict[int, list[bytes]] = {}
        for b in arrow:
            back = []
            for part, kind, dk, body in zip(*(c.to_pylist() for c in b.columns)):
                if kind == A.BODY:
                    bodies.setdefault(part, []).append(body)
                else:
                    back.append((part, kind, dk, body))
            if back:
                yield A.pack_batch(back, A.PACK)
        for part in sorted(bodies):
            yield A.pack_batch([(part, A.BODY, 0, _merged(bodies.pop(part)))], A.PACK)

    return go


def _merged(bodies: list[bytes]) -> bytes:
    """Sorted bodies (or packs) of a bucket as one sorted body; nothing is dropped."""
    got = [A.taken(b, A.ANCHORS) for b in bodies]
    values, dks = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    order = np.lexsort((dks, values))
    return A.joined(values[order], dks[order], np.unique(np.concatenate([g[2] for g in got])))


def _inside(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_, values)
    return sorted_[np.minimum(at, len(sorted_) - 1)] == values


def meeting(new: bytes, old: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of a bucket: (fingerprints, documents) of the new run that recur in it or in an old one, and those of the old runs that the new one has."""
    values, dks, known = A.taken(new, A.ANCHORS)
    hit = _inside(known, values)
    twin = values[1:] == values[:-1]
    hit[1:] |= twin
    hit[:-1] |= twin
    out = []
    for body in old:
        v, d, k = A.taken(body, A.ANCHORS)
        hit |= _inside(v, values) | _inside(k, values)
        back = _inside(values, v) | _inside(known, v)
        out.append((v[back], d[back]))
    out.append((values[hit], dks[hit]))
    return np.concatenate([v for v, _ in out]), np.concatenate([d for _, d in out])


def _joined(parts: int):
    """mapInArrow: (new body, old bodies) of each bucket -> back packs."""

    def go(arrow):
        for b in arrow:
            for new, *old in zip(*(c.to_pylist() for c in b.columns)):
                values, dks = meeting(new, [x for x in old if x is not None])
                yield A.pack_batch(A.back_packs(dks, values, parts), A.PACK)

    return go


def _compacted(arrow):
    """mapInArrow: (part, bodies) -> one body of each bucket."""
    for b in arrow:
        for part, *bodies in zip(*(c.to_pylist() for c in b.columns)):
            yield A.pack_batch([(part, A.BODY, 0, _merged([x for x in bodies if x is not None]))], A.PACK)


class FingerprintIndex:
    """Runs in a folder that all executors share; one writer at a time.  A folder that holds an index is opened, with its own parameters."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 35, gram: int = 8, most_runs: int = 2, buckets: int | None = None, keep_texts: bool | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "fingerprints")
        found = self._read()
        self.window, self.gram = found.get("window", window), found.get("gram", gram)
        self.buckets, self.most_runs = found.get("buckets", buckets or n_parts(spark)), found.get("most_runs", most_runs)
        self.keep_texts = found.get("keep_texts", path is not None if keep_texts is None else keep_texts)
        self.runs: list[str] = found.get("runs", [])
        self.texts: list[str] = found.get("texts", [])
        self.kind = A.Words(self.window, self.gram)
        self.compactions = found.get("compactions", 0)
        self.commits = found.get("commits", 0)

    def _read(self) -> dict:
        """The newest manifest; a manifest is one file and is never changed."""
        fs, at = self._fs(f"{self.path}/manifest")
        names = [str(s.getPath().getName()) for s in fs.listStatus(at)] if fs.exists(at) else []
        newest = max((n for n in names if n.isdigit()), default=None, key=int)
        return {} if newest is None else json.loads(self.spark.read.text(f"{self.path}/manifest/{newest}", wholetext=True).first()[0])

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _commit(self) -> None:
        """Writes the state as the next manifest: a file under another name, then one rename.

        A writer that dies before the rename leaves the manifest before it in force; a number that exists
        already is another writer's, and an error.
        """
        self.commits += 1
        state = {k: getattr(self, k) for k in ("window", "gram", "buckets", "most_runs", "keep_texts", "runs", "texts", "compactions", "commits")}
        fs, final = self._fs(f"{self.path}/manifest/{self.commits:012d}")
        _, part = self._fs(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(part, final):
            raise RuntimeError(f"{self.path}: another writer has committed {self.commits}")

    def _write(self, rows: DataFrame, name: str) -> str:
        """rows hold a bucket's records together, so each task writes one file of its bucket."""
        at = f"{self.path}/{name}_{uuid.uuid4().hex}"
        table = f"fingerprints_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "part").sortBy("part").option("path", at).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # an external table: its files stay
        return at

    def _run(self, at: str) -> DataFrame:
        """A run as a bucketed table.  Its name leaves the catalog at once; the plan keeps files and buckets."""
        table = f"fingerprints_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} ({A.PACK_SQL.replace('part long', 'part BIGINT').replace('dk long', 'dk BIGINT')}) USING parquet CLUSTERED BY (part) SORTED BY (part) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        found = self.spark.table(table)
        found.schema  # resolved
        self.spark.sql(f"DROP TABLE {table}")
        return found

    def _bodies(self, at: str, name: str) -> DataFrame:
        return self._run(at).where(F.col("kind") == A.BODY).select("part", F.col("body").alias(name))

    def packs(self, docs: DataFrame) -> DataFrame:
        return docs.select("dk", "text").mapInArrow(A.anchor_packs(self.kind, self.buckets), A.PACK_SQL)

    def add(self, docs: DataFrame) -> DataFrame:
        """Write the batch (k1, dk, text) as a run; gives the back packs of its documents and of old ones whose fingerprints meet."""
        run = self._write(self.packs(docs).repartition(self.buckets, "part").mapInArrow(_sorted_run(self.buckets), A.PACK_SQL), "run")
        if self.keep_texts:
            at = f"{self.path}/texts_{uuid.uuid4().hex}"
            docs.select("k1", "dk", "text").write.parquet(at)
            self.texts.append(at)
        new = self._bodies(run, "new").hint("merge")
        both = reduce(lambda d, k: d.join(self._bodies(self.runs[k], f"old{k}").hint("merge"), "part", "left"), range(len(self.runs)), new)
        found = both.drop("part").mapInArrow(_joined(self.buckets), A.PACK_SQL)
        back = self._run(run).where(F.col("kind") == A.BACK).unionByName(found)
        self.runs.append(run)
        if len(self.runs) > self.most_runs:
            back = back.checkpoint() if self.spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else back
            self.compact()
        self._commit()
        return back

    def compact(self) -> None:
        """All runs as one, merged bucket by bucket where they lie; the old runs stay until the folder is cleared."""
        if len(self.runs) < 2:
            return
        every = self._bodies(self.runs[0], "b0").hint("merge")
        for k, at in enumerate(self.runs[1:], 1):
            every = every.join(self._bodies(at, f"b{k}").hint("merge"), "part", "full_outer")
        self.runs = [self._write(every.mapInArrow(_compacted, A.PACK_SQL), "run")]
        self.compactions += 1

    def documents(self) -> DataFrame:
        """All documents that were added (k1, dk, text)."""
        if not self.texts:
            return self.spark.createDataFrame([], DOCS_SQL)
        return self.spark.read.schema(DOCS_SQL).parquet(*self.texts)


def _all_removed(rows: list[tuple]):
    """Fold for equal super-windows: if there are two places, every one of their windows recurs."""
    places = {r[1:4] for r in rows}
    rep = any(r[5] for r in rows)
    v, k1, dk, a, n, _ = rows[0][:6]
    if len(places) < 2 and not rep:
        return (v, k1, dk, a, n, 0), []
    return (v, k1, dk, a, n, 1), [r for r in rows if not r[5]] if rep else rows


def _judge(window: int):
    def go(rows: list[tuple]):
        same: dict[bytes, list] = {}
        for r in rows:
            same.setdefault(r[6], []).append(r)
        by: dict[int, list] = {}
        for text, copies in same.items():
            places = {r[1:4] for r in copies}
            recurs = len(places) > 1 or any(r[5] for r in copies)
            if recurs:
                for _, k1, dk, a, n, _, _ in copies:
                    yield k1, dk, a, a + n + window - 1
            by.setdefault(copies[0][0], []).append((*copies[0][:5], recurs, text))
        for group in by.values():
            if len(group) > 1:
                yield from _merge_verified(group, window)

    return go


def _merge_verified(group: list[tuple], window: int):
    """Windows of super-windows with one fingerprint: sorted by window hash, equal neighbours verified word by word."""
    hashes, owner, offset, words = [], [], [], []
    for i, r in enumerate(group):
        w = r[6].split(b" ")
        words.append(w)
        seen: dict[bytes, int] = {}
        ids = np.fromiter((hash_of(x, seen) for x in w), np.uint64, len(w))
        # polynomial window hash by prefix sums (mod 2^64); equality is verified below
        power = np.cumprod(np.full(len(w), 0x9E3779B97F4A7C15, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * power)])
        n = r[4]
        hashes.append((sums[window : window + n] - sums[:n]) * _inverse_powers(n))
        owner.append(np.full(n, i))
        offset.append(np.arange(n))
    h, owner, offset = np.concatenate(hashes), np.concatenate(owner), np.concatenate(offset)
    order = np.argsort(h, kind="stable")
    s = h[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    hit: dict[int, list[int]] = {}
    classes: dict[tuple, list] = {}
    for j in order[twin].tolist():
        i, a = int(owner[j]), int(offset[j])
        classes.setdefault(tuple(words[i][a : a + window]), []).append((i, a))
    for places in classes.values():
        if len({(*group[i][1:3], group[i][3] + a) for i, a in places}) > 1:
            for i, a in places:
                if not group[i][5]:
                    hit.setdefault(i, []).append(a)
    for i, found in hit.items():
        r = group[i]
        for a in found:
            yield r[1], r[2], r[3] + a, r[3] + a + window


_POWERS: dict[int, np.ndarray] = {}


def _inverse_powers(n: int) -> np.ndarray:
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        inverse = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        _POWERS[size] = np.cumprod(np.full(size, inverse, np.uint64))
    return _POWERS[size][:n]


def hash_of(word: bytes, seen: dict) -> int:
    got = seen.get(word)
    if got is None:
        got = seen[word] = A.xxhash.xxh64_intdigest(word)
    return got


def _kept_words(names: list[str], digest: bool, window: int):
    """Apply spans: documents with spans -> counts and kept text."""

    def go(arrow):
        for b in arrow:
            for at in range(0, b.num_rows, 500):
                held = [b.slice(at, 500)]
                docs, k1s = A.column(held, names[0]), A.numbers(held, names[1]).tolist()
                n_words, n_removed, kept = [], [], []
                for k1, doc, spans in zip(k1s, docs, A.column(held, names[2])):
                    words = WORD.findall(doc or b"")
                    gone = A.covered(spans, k1, len(words), window)
                    n_words.append(len(words))
                    n_removed.append(0 if gone is None else int(gone.sum()))
                    if gone is not None:
                        words = [w for w, x in zip(words, gone.tolist()) if not x]
                    if digest:
                        kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    else:
                        kept.append(doc if gone is None else b" ".join(words))
                rest = [(n, c) for n, c in zip(held[0].schema.names, held[0].columns) if n not in names]
                kept = pa.array(kept, pa.string()) if digest else pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(c for _, c in rest), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept],
                    names=[*(n for n, _ in rest), *names[3:]],
                )

    return go


def _batch_filters(n: int) -> list:
    return [None] if n < 2 else [F.pmod(F.col("dk"), F.lit(n)) == k for k in range(n)]


#: A span that covers a whole document.
WHOLE = 1 << 62


def _spans(base: DataFrame, index: FingerprintIndex, batches: int) -> DataFrame:
    """(dk, spans) of the documents (k1, dk, text), which enter the index batch by batch."""
    known = index.documents() if index.keep_texts and index.texts else None
    found = reduce(DataFrame.unionByName, [index.add(base if where is None else base.where(where)) for where in _batch_filters(batches)])
    every = base if known is None else base.unionByName(known)
    spans = spans_of(every, index.kind, _all_removed, _judge(index.window), found)
    # rows equal in id and text: each stands elsewhere too
    twice = every.groupBy("k1", "dk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("dk", "k1")
    whole = twice.groupBy("dk").agg(F.array_join(F.transform(F.collect_set("k1"), lambda k: F.concat(*[F.hex(_little_endian(x)) for x in (k, F.lit(0), F.lit(WHOLE))])), "").alias("whole"))
    both = spans.join(whole, "dk", "full_outer")
    return both.select("dk", F.concat(F.coalesce("spans", F.lit(b"")), F.coalesce(F.unhex("whole"), F.lit(b""))).alias("spans"))


def _little_endian(x):
    """A long as its eight bytes, the lowest first."""
    return F.unhex(F.array_join(F.transform(F.array(*[F.shiftrightunsigned(x.cast("long"), 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]), lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def substring_dedup(docs: DataFrame, window: int = 35, gram: int = 8, batches: int = 4, index: FingerprintIndex | None = None) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256).

    Each word goes that a window of ``window`` words covers whose word sequence starts
    anywhere else.  The table enters the index in ``batches`` batches (by a hash of the
    row), each joined with the runs before it.  An ``index`` that holds earlier documents
    counts these too; it gives the window.
    """
    base = _base(docs)
    index = index or FingerprintIndex(docs.sparkSession, window=window, gram=gram)
    names = ["text", "k1", "spans", "n_words", "n_removed", "kept_sha256"]
    rows = with_id(base.join(_spans(base, index, batches), "dk", "left"))
    return rows.mapInArrow(A.in_pieces(_kept_words(names, True, index.window)), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 8, batches: int = 4, index: FingerprintIndex | None = None) -> DataFrame:
    """The same documents with all their columns; texts lose their repeated passages.

    A text that loses nothing is unchanged; else its kept words are joined by one space.
    A null text stays null.
    """
    k1, dk, spans_, n, gone, kept = fresh(docs, "k1", "dk", "spans", "n", "gone", "kept")
    doc_id = F.col("doc_id").cast("long")
    base = docs.select("*", F.coalesce(doc_id, F.lit(NULL_ID)).alias(k1), F.xxhash64(doc_id, text_or_empty()).alias(dk))
    index = index or FingerprintIndex(docs.sparkSession, window=window, gram=gram)
    spans = _spans(base.select(F.col(k1).alias("k1"), F.col(dk).alias("dk"), text_or_empty().alias("text")), index, batches)
    rows = base.join(spans.select(F.col("dk").alias(dk), F.col("spans").alias(spans_)), dk, "left").drop(dk)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"{n} long, {gone} long, {kept} string"])
    out = rows.mapInArrow(A.in_pieces(_kept_words(["text", k1, spans_, n, gone, kept], False, index.window)), schema)
    return out.select(*[F.col(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
