import base64
import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracklume.llm import bpe, token_count, words

TEXTS = ["", None, "hello world", "  two  spaces\n\n end ", "don't you'll", "ünïcödé ½ Ⅷ ² 三 ٣", "<|endoftext|> in <|endoftext|>text", "a" * 700, "\x1c \x85 　x", "\0\xff", "the the the", "emoji 🎉🎉 end", "x\n\0y"]


def rows(spark):
    rnd = random.Random(2)
    more = ["".join(rnd.choice("ab  é'\n1²_-🎉") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    data = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS + more)]
    return data, spark.createDataFrame(data + [data[2]], "doc_id long, text string").selectExpr("text", "doc_id", "1 AS ids", "'w' AS word", "2 AS n").repartition(3)


@pytest.mark.parametrize("most", [5, 1 << 19])
def test_bpe(spark, most):
    data, df = rows(spark)
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.bpe_round_trip(df, ranks, public_tokenizers.PATTERN, most).collect()
    want = []
    for i, t in data + [data[2]]:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    pieces = bpe.piece_literal(ranks)
    out = bpe.bpe_encode(df, ranks, public_tokenizers.PATTERN, most).select("doc_id", bpe.decoded(F.col("ids"), pieces).alias("b")).collect()
    assert sorted([(r.doc_id, bytes(r.b)) for r in out], key=str) == sorted([(i, (t or "").encode()) for i, t in data + [data[2]]], key=str)


def test_pieces_that_merging_never_builds(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"xyz": 257}
    assert [p for p, _ in bpe.RankMap(ranks).exceptions] == [b"xyz"]
    df = spark.createDataFrame([(1, "ab xyz abx")], "doc_id long, text string")
    enc = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.bpe_encode(df, ranks, r"\p{L}+|\s+").first().ids == [i for w in ["ab", " ", "xyz", " ", "abx"] for i in enc.encode_ordinary(w)]


@pytest.mark.parametrize("most", [5, 1 << 19])
def test_counts(spark, most):
    data, df = rows(spark)
    spec = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    lib = Tokenizer.from_str(spec)
    got = token_count.token_counts(df, spec, public_tokenizers.PATTERN, 20, most).collect()
    want = []
    for i, t in data + [data[2]]:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 20))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    ranks = {bytes([i]): i for i in range(256)}
    assert bpe.bpe_encode(df, ranks, public_tokenizers.PATTERN).count() == 0
    assert token_count.token_counts(df, Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(), public_tokenizers.PATTERN).count() == 0


def test_splitter_like_the_regex_module():
    enc = tiktoken.Encoding("bytes", pat_str=r"\p{L}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    assert all(bool(enc.encode_ordinary(c)) == (c in words._members("L")) for c in "aé三٣²½Ⅷ\u1c89\U00016d40\U0001f389")
    split, want = words.finder(words.splitter(public_tokenizers.PATTERN)), regex.compile(public_tokenizers.PATTERN).findall
    rnd = random.Random(3)
    for _ in range(5000):
        x = "".join(rnd.choice("ab  '\n\t_-1²½Ⅷé\x1c\x85 三٣.s't") for _ in range(rnd.randint(0, 12)))
        assert split(x) == want(x)


def test_segments():
    find = words.finder(words.splitter(public_tokenizers.PATTERN))
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab  '\n\t_-1²½Ⅷé\x1c\x85 三٣.s't") for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    got = words.Segments(pa.array(texts), words.splitter(public_tokenizers.PATTERN))
    found, sizes = got.words()
    ends, at = np.cumsum(sizes), 0
    for text, n in zip(texts, got.sizes.tolist()):
        assert [w for c in got.codes[at : at + n].tolist() for w in found[ends[c] - sizes[c] : ends[c]]] == find(text)
        at += n
    assert at == len(got.codes) and got.counts().sum() == at


def test_rank_file():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(None, path)
    assert len(ranks) == 50256 and ranks[base64.b64decode(open(path, "rb").readline().split()[0])] == 0
