"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

The lengths (in tokens) of the corpus's frequent pre-tokens, a set of bounded
size, are computed once and broadcast as a compact hash table.  A task sums the
lengths of its texts' pre-tokens; what the table misses is encoded by the
library itself through a cache of the worker, which is emptied when it is full.

The frequent pre-tokens come from all texts: each task keeps counts and hands on those that
make up a stated share of what it has read (a bounded summary); whatever has that share of
the corpus has it in some task.  Only these summaries are exchanged.

Defined results: a null text is empty (0 tokens); special strings inside a text
are single tokens, as the library takes them by default; equal rows get equal results.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from ._common import text_or_empty

#: Entries of a worker's cache.
CACHE = 1 << 19
#: A summary holds the pre-tokens that make up one of so many.
SHARE = 1 << 21

_state: dict = {}


def _library(sent):
    name, spec = sent.value
    if _state.get("tokenizer_of") != name:
        from tokenizers import Tokenizer

        _state.update(tokenizer_of=name, tokenizer=Tokenizer.from_str(spec), cache={})
    return _state["tokenizer"], _state["cache"]


def _lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _encoded(sent):
    """mapInArrow: segments -> (word, tokens)."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int32())])

    def go(arrow):
        tokenizer, _ = _library(sent)
        for b in arrow:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_lengths(tokenizer, b.column(0).to_pylist()), pa.int32())], schema=schema)

    return go


def _table(sent) -> dict[str, int]:
    name, words, sizes = sent.value
    if _state.get("table_of") != name:
        _state.update(table_of=name, table=dict(zip(words.split("\n\0"), np.frombuffer(sizes, np.uint8).tolist())) if sizes else {})
    return _state["table"]


def _summarised(made: tuple, apart: str | None, share: int):
    """mapInArrow: texts -> (word, n), a bounded summary of each task."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def go(arrow):
        found: Counter = Counter()
        total = 0

        def summary():
            kept = [(w, n) for w, n in found.items() if n * share >= total and len(w) <= W.MOST_BYTES]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], schema=schema)

        for b in arrow:
            for first, last in W.blocks_of(b.column(0)):
                texts, _ = _apart(b.column(0)[first:last], apart)
                got = W.Segments(texts, made)
                words, sizes = got.words()
                for word, n in zip(words, np.repeat(got.counts(), sizes).tolist()):
                    found[word] += n
                total += len(got.codes)
                if len(found) >= W.FLUSH:
                    yield summary()
                    found.clear()
                    total = 0
        if found:
            yield summary()

    return go


def _apart(texts: pa.Array, pattern: str | None) -> tuple[pa.Array, np.ndarray]:
    """Texts without special strings, cut where these stand, and how many parts each text has."""
    if pattern is None or not pc.any(pc.match_substring_regex(texts, pattern)).as_py():
        return texts, np.ones(len(texts), np.int64)
    lists = pc.split_pattern_regex(texts, pattern)
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


def _counted(made: tuple, apart: str | None, sent, library):
    """mapInArrow: (doc_id, text) -> (doc_id, n_bytes, n_tokens)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def go(arrow):
        table = _table(sent)
        tokenizer, cache = _library(library)
        for b in arrow:
            for first, last in W.blocks_of(b.column(1)):
                texts = b.column(1)[first:last]
                parts, per_text = _apart(texts, apart)
                got = W.Segments(parts, made)
                words, sizes = got.words()
                lengths = list(map(table.get, words))
                used = np.repeat(got.counts() > 0, sizes)
                missed = [k for k in np.flatnonzero(used).tolist() if lengths[k] is None]
                new = list(dict.fromkeys(words[k] for k in missed if words[k] not in cache))
                if len(cache) + len(new) > CACHE:
                    cache.clear()
                    new = list(dict.fromkeys(words[k] for k in missed))
                cache.update(zip(new, _lengths(tokenizer, new)))
                for k in missed:
                    lengths[k] = cache[words[k]]
                for w in new:
                    if len(w) > W.MOST_BYTES:  # long ones are not kept
                        del cache[w]
                of_keys = W.totals(np.array([n or 0 for n in lengths], np.int64), sizes)
                tokens = W.totals(W.totals(of_keys[got.codes], got.sizes), per_text) + per_text - 1  # a special string between two parts is one token
                yield pa.RecordBatch.from_arrays([b.column(0)[first:last], pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64())], schema=schema)

    return go


def token_counts(docs: DataFrame, tokenizer_json: str, pattern: str, limit: int = 1024, most: int = W.MOST_WORDS, share: int = SHARE) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, n_bytes, n_tokens, over_limit).

    ``tokenizer_json`` is the text of a byte-level BPE tokenizer whose pre-tokens
    ``pattern`` matches; its added tokens are cut out of a text before.
    """
    spec = json.loads(tokenizer_json)
    added = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)
    apart = "|".join(map(re.escape, added)) or None
    made = W.splitter(pattern)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    library = spark.sparkContext.broadcast((uuid.uuid4().hex, tokenizer_json))
    counts = rows.select("text").mapInArrow(_summarised(made, apart, share), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = W.frequent(counts, most).mapInArrow(_encoded(library), "word string, n int").toArrow()
    sizes = got.column(1).to_numpy().astype(np.uint8).tobytes()  # a word of 32 bytes has 32 tokens at most
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, "\n\0".join(got.column(0).to_pylist()), sizes))
    out = rows.mapInArrow(_counted(made, apart, sent, library), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
