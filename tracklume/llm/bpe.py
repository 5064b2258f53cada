"""Byte-level BPE as Spark expressions: ranked merges folded over byte arrays.

Encoding.  The distinct pre-tokens of a corpus are counted; the frequent ones (a
bounded set) are encoded once and broadcast.  A task looks its texts' pre-tokens up
there; those it misses, distinct per block of texts, are encoded on the way.
Both are encoded by the same Spark expression: a word becomes the array of its
bytes, and a higher-order fold merges the adjacent pair of least rank until no
pair has one.  Ranks come from a literal of the plan: a hash table, so a lookup reads two slots at most.

Decoding concatenates the ids' binary pieces, as a Spark expression too.

Defined results: a null text is empty and has no ids; special tokens are ordinary
text; equal rows get equal results.  A pre-token of n bytes costs n merges of
arrays of n pieces at most.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from ._common import text_or_empty


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Lines of base64 piece and rank; read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: the finish of a fold over nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


#: An id or rank has so many bits; all ones stand for no rank.
BITS = 18
NONE = (1 << BITS) - 1
#: Bits of a piece that lie below its rank: its id, and above it its first byte's place.
LOW = 45


class RankMap:
    """The rank map as literals of the plan.

    ``table`` holds the pairs of adjacent ids whose concatenation has a rank, each with that rank
    at one of two places (cuckoo hashing); ``single`` the ids of bytes, ``two`` the ranks of pairs
    of bytes.  Pieces that merging never builds, if there are any, are known as whole words.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= NONE:
            raise ValueError(f"ids have {BITS} bits at most")
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("every byte needs a rank")
        pairs = {a << BITS | b: r for p, r in ranks.items() for i in range(1, len(p)) if (a := ranks.get(p[:i])) is not None and (b := ranks.get(p[i:])) is not None}
        single = [ranks[bytes([i])] for i in range(256)]
        self.exceptions = [(p, r) for p, r in ranks.items() if len(p) > 1 and merged_alone([single[b] for b in p], pairs) != [r]]
        self.mask, table = cuckoo(pairs)
        two = [pairs.get(a << BITS | b, NONE) for a in single for b in single]
        self.literal = F.from_json(F.lit(json.dumps({"table": table, "single": single, "two": two})), "table array<long>, single array<long>, two array<long>")

    def bound(self, body) -> Column:
        """body(literals) with the literals as one value: they stand in the plan once."""
        return _let(self.literal, body)

    def of_pair(self, known: Column, left: Column, right: Column) -> Column:
        """Rank of the concatenation of two ids, or NONE."""

        def found(key: Column, h: Column) -> Column:
            def read(bits: Column, other: Column) -> Column:
                hit = lambda slot: F.when(F.shiftright(slot, BITS) == key, slot.bitwiseAND(F.lit(NONE))).otherwise(other)
                return _let(F.get(known["table"], bits.bitwiseAND(F.lit(self.mask)).cast("int")), hit)

            return read(h, read(F.shiftright(h, 24), F.lit(NONE).cast("long")))

        return _let(F.shiftleft(left, BITS) + right, lambda key: _let(F.xxhash64(key), lambda h: found(key, h)))


def merged_alone(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of a word by merging alone: the same as the expression, for the few pieces that need it."""
    while len(ids) > 1:
        rank, i = min((pairs.get(a << BITS | b, NONE), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
        if rank == NONE:
            break
        ids = ids[:i] + [rank] + ids[i + 2 :]
    return ids


def cuckoo(pairs: dict[int, int]) -> tuple[int, list[int]]:
    """(mask, table): slots are key and value in one number, each at one of two places by bits of the key's XXH64 (seed 42)."""
    mask = (1 << max(4, int(len(pairs) / 0.45).bit_length())) - 1
    places, held = {}, [-1] * (mask + 1)
    for key in pairs:
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42)
        places[key] = h & mask, h >> 24 & mask
    for key in pairs:
        at, kicks = places[key][0], 0
        while key != -1:
            key, held[at] = held[at], key
            if key != -1:
                one, two = places[key]
                at = two if at == one else one
            if (kicks := kicks + 1) > 2000:
                raise ValueError("the table is too dense")
    return mask, [-1 if key == -1 else key << BITS | pairs[key] for key in held]


def encoder(ranks: RankMap):
    """(literals, word as binary) -> array of ids, as an expression.

    The state of the fold is an array of numbers, one for each piece: the rank of the pair that it
    makes with the next piece, the place of its first byte, its id.  Its least number is the first
    pair of least rank; a step merges that pair and looks up the two pairs that this makes.
    """
    end = NONE << LOW
    identity, place = lambda x: x.bitwiseAND(F.lit(NONE)), lambda x: x.bitwiseAND(F.lit((1 << LOW) - 1 ^ NONE))

    def encode(known: Column, word: Column) -> Column:
        def start(codes: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                rank = F.when(i + 1 < F.size(codes), F.shiftleft(F.get(known["two"], x * 256 + F.get(codes, i + 1)), LOW)).otherwise(F.lit(end))
                return rank + F.shiftleft(i.cast("long"), BITS) + F.get(known["single"], x)

            return F.transform(codes, piece)

        def merged(state: Column, least: Column) -> Column:
            def at(k: Column) -> Column:  # k: place of the least number, from 1; the merged piece's id is its rank
                def put(new: Column) -> Column:
                    rank = F.when(k + 1 < F.size(state), F.shiftleft(ranks.of_pair(known, new, identity(F.get(state, k + 1))), LOW)).otherwise(F.lit(end))
                    made, rest = rank + place(least) + new, F.slice(state, k + 2, F.size(state))
                    before = F.get(state, k - 2)
                    left = F.shiftleft(ranks.of_pair(known, identity(before), new), LOW) + before.bitwiseAND(F.lit((1 << LOW) - 1))
                    return F.when(k > 1, F.concat(F.slice(state, F.lit(1), k - 2), F.array(left, made), rest)).otherwise(F.concat(F.array(made), rest))

                return _let(F.shiftright(least, LOW), put)

            return _let(F.size(F.filter(state, lambda x: place(x) <= place(least))), at)

        def step(state: Column, _) -> Column:
            return _let(F.array_min(state), lambda least: F.when(least < F.lit(end), merged(state, least)).otherwise(state))

        chars = F.decode(word, "ISO-8859-1")  # a character for each byte
        codes = _let(chars, lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.ascii(F.substring(c, i, F.lit(1)))))
        pieces = _let(codes, lambda c: _let(start(c), lambda s: F.aggregate(F.slice(s, F.lit(1), F.size(s) - 1), s, step)))
        ids = F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(F.transform(pieces, lambda x: identity(x).cast("int")))
        for whole, rank in ranks.exceptions:
            ids = F.when(word == F.lit(whole), F.array(F.lit(rank))).otherwise(ids)
        return ids

    return encode


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """The pieces by id, in hexadecimal."""
    table: list[str] = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece.hex()
    return F.from_json(F.lit(json.dumps(table)), "array<string>")


def decoded(ids: Column, pieces: Column) -> Column:
    """ids (array of int) -> bytes; ``pieces`` is a :func:`piece_literal` column."""
    return _let(pieces, lambda table: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")))


_tiers: dict[str, dict[str, int]] = {}


def _tier(sent) -> dict[str, int]:
    """The broadcast words as a dict of this worker: word -> its place."""
    name, words = sent.value
    if name not in _tiers:
        _tiers.clear()
        _tiers[name] = {w: i for i, w in enumerate(words.split("\n\0"))} if words is not None else {}
    return _tiers[name]


BLOCK_SQL = "doc_ids array<long>, sizes binary, segments binary, key_sizes binary, words binary, known binary, missed array<binary>"
BLOCK = pa.schema([("doc_ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("sizes", "segments", "key_sizes", "words", "known")], ("missed", pa.list_(pa.binary()))])


def _looked_up(made: tuple, sent):
    """mapInArrow: (doc_id, text) -> blocks of texts: their segments, the segments' words, and each word's place in the tier or among the missed."""

    def go(arrow: Iterator[pa.RecordBatch]):
        tier = _tier(sent)
        for b in arrow:
            for first, last in W.blocks_of(b.column(1)):
                found = W.Segments(b.column(1)[first:last], made)
                words, key_sizes = found.words()
                index: dict[str, int] = {}
                places = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
                used = np.zeros(len(index), bool)
                used[places[np.repeat(found.counts() > 0, key_sizes)]] = True
                held = np.fromiter((tier.get(w, -1) for w in index), np.int64, len(index))
                known, missing = np.flatnonzero(used & (held >= 0)), np.flatnonzero(used & (held < 0))
                moved = np.zeros(len(index), np.int64)
                moved[known], moved[missing] = np.arange(len(known)), len(known) + np.arange(len(missing))
                names = list(index)
                row = [found.sizes, found.codes, key_sizes, moved[places], held[known]]
                missed = [names[k].encode() for k in missing.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[first:last].to_pylist()], pa.list_(pa.int64())), *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in row], pa.array([missed], pa.list_(pa.binary()))],
                    schema=BLOCK,
                )

    return go


IDS_SQL = "doc_id long, ids array<int>, ids_sha256 string"
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string())])


def _assembled(sent):
    """mapInArrow: blocks with the ids of their missed words -> (doc_id, ids, ids_sha256)."""

    def go(arrow: Iterator[pa.RecordBatch]):
        sizes, flat = sent.value
        tier_sizes, tier_ids = np.frombuffer(sizes, np.uint16).astype(np.int64), np.frombuffer(flat, np.int32)
        for b in arrow:
            for i in range(b.num_rows):
                doc_ids, *row, found = (c[i] for c in b.columns)
                doc_sizes, segments, key_sizes, words, known = (np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in row)
                ids, wide = W.gathered(tier_ids, tier_sizes, known)
                new = found.values
                ids, wide = np.concatenate([ids, new.flatten().to_numpy()]), np.concatenate([wide, np.diff(new.offsets.to_numpy())])
                ids, wide = W.gathered(ids, wide, words)  # words of the keys
                ids, wide = W.gathered(ids, W.totals(wide, key_sizes), segments)  # keys of the texts
                ends = np.concatenate([[0], np.cumsum(W.totals(wide, doc_sizes))])
                ids = ids.astype("<i4")
                sha = [hashlib.sha256(ids[x:y]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(sha, pa.string())], schema=IDS)

    return go


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = W.MOST_WORDS) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, ids array<int>, ids_sha256 of the ids as little-endian 32-bit numbers)."""
    spark = docs.sparkSession
    made = W.splitter(pattern)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    top = W.frequent(W.word_counts(rows.select("text"), made), most)
    merges = RankMap(ranks)
    encode = encoder(merges)
    got = top.select("word", merges.bound(lambda t: encode(t, F.encode("word", "UTF-8"))).alias("ids")).toArrow().combine_chunks()
    words, sizes, flat = got.column(0).to_pylist(), b"", b""
    if words:
        ids = got.column(1).chunk(0)
        sizes, flat = np.diff(ids.offsets.to_numpy()).astype(np.uint16).tobytes(), ids.flatten().to_numpy().astype(np.int32).tobytes()
    names, known = spark.sparkContext.broadcast((uuid.uuid4().hex, "\n\0".join(words) if words else None)), spark.sparkContext.broadcast((sizes, flat))
    blocks = rows.mapInArrow(_looked_up(made, names), BLOCK_SQL)
    encoded = blocks.withColumn("missed", merges.bound(lambda t: F.transform("missed", lambda w: encode(t, w))))
    return encoded.mapInArrow(_assembled(known), IDS_SQL)


def bpe_round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = W.MOST_WORDS) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    out = bpe_encode(docs, ranks, pattern, most)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(decoded(F.col("ids"), piece_literal(ranks)), 256).alias("decoded_sha256"))
