"""Whitening, exact duplicates and resampling against brute force and their SQL twins."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from comparing import same
from conftest import SMALL

from tracklume.llm import exact_dedup, queries, resampling, whitening


@pytest.mark.parametrize("name", ["op12_exact_dedup", "op13_resampling"])
def test_matches_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SMALL).toPandas(), duck.sql(queries.ORACLES[name]).df())


# whitening


def simple_whitening(rows, most):
    """Rows (id, vector) by the definition, with exact whole numbers and numpy."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    y = np.array([[float(n * a - b) / n for a, b in zip(r, s)] for r in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    return n, deviation, e, e / np.trace(v), y @ u


def whitened(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("1 AS x", "embedding", "vec_id", "2 AS v", "3 AS component", "4 AS shard")
    return whitening.whiten(df.repartition(3), **how).collect()


def test_whitening(spark):
    rnd = np.random.default_rng(3)
    mix = rnd.normal(size=(6, 6))
    rows = [(k, [float(c) for c in r]) for k, r in enumerate(rnd.normal(size=(150, 6)) @ mix + 40)]
    rows += [rows[5]]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] + [1.0] * 5), (903, [float("inf")] + [1.0] * 5), (904, []), (905, [1.0, 2.0]), (906, [3e38] * 6)]
    got = whitened(spark, rows + bad, most=4)
    n, deviation, e, explained, centred = simple_whitening(rows, 4)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} == {151}
    by = {(r.vec_id, r.component): r for r in got}
    for j in range(4):
        want = centred[:, j] / math.sqrt(e[j])
        have = np.array([by[k, j + 1].whitened for k, _ in rows])
        assert np.allclose(have, want, atol=1e-8) or np.allclose(have, -want, atol=1e-8)
        assert all(abs(by[k, j + 1].explained / explained[j] - 1) < 1e-9 for k, _ in rows)
    assert [by[k, 1].deviation for k, _ in rows] == deviation
    assert len({r.identity_error for r in got}) == 1 and 0 < got[0].identity_error < 1e-9


def test_whitening_edges(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, None), (2, [])]) == []
    one = whitened(spark, [(None, [1.0, 2.0])])
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(None, 1, 1, 0, None, None, None), (None, 2, 1, 0, None, None, None)]
    # one direction only: the other component is flat
    line = whitened(spark, [(k, [float(k), 2.0 * k]) for k in range(10)])
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-9
    # numbers that 64 bits do not hold
    wide = whitened(spark, [(1, [2.0**40]), (2, [-(2.0**40)]), (3, [0.5])])
    assert [r.deviation for r in sorted(wide, key=lambda r: r.vec_id)][:2] == [None, None]
    x = [int(64 * 2.0**40), -int(64 * 2.0**40), 32]
    assert {r.vec_id: r.deviation_wide for r in wide} == {k + 1: str((3 * a - sum(x)) ** 2) for k, a in enumerate(x)}
    with pytest.raises(ValueError):
        whitened(spark, [(1, [0.5] * 200)])


def test_whitening_is_exact_for_any_order(spark):
    rnd = random.Random(1)
    rows = [(k, [rnd.uniform(-1, 1) for _ in range(5)]) for k in range(200)]
    a = whitened(spark, rows)
    rnd.shuffle(rows)
    assert {(r.vec_id, r.component, r.whitened) for r in a} == {(r.vec_id, r.component, r.whitened) for r in whitened(spark, rows)}


# exact duplicates


def simple_owners(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for bare, members in groups.items():
        keep = rows[min(members)[3]][0]
        sha = hashlib.sha256(bare.encode()).hexdigest()
        out += [(rows[m[3]][0], keep, len(members), sha, m[:3]) for m in members]
    return out


def owned(spark, rows, limit=exact_dedup.LIMIT, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'n' AS hash", "text", "7 AS kept", "doc_id", "'x' AS keep_id").repartition(parts)
    return df, exact_dedup.exact_dedup(df, limit=limit).collect()


@pytest.mark.parametrize("limit", [400, 5000, exact_dedup.LIMIT])
def test_exact_dedup(spark, limit):
    rnd = random.Random(2)
    base = ["", "a", "ab", "abc", "a b\tc", "ä ö", "x" * 5000, "x" * 4999 + "y", "x" * 2500, " wide", "\n\x0b\x0c\r "] + ["".join(rnd.choice("ab \n") for _ in range(rnd.randint(0, 6))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(base)] + [(None, "abc"), (None, None), (None, None), (3, "abc"), (3, "abc"), (500, None), (501, " " * 9)] + [(k, "hot text") for k in range(1000, 1100)]
    rnd.shuffle(rows)
    _, got = owned(spark, rows, limit)
    want = simple_owners(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(w[:4] for w in want)
    # one row stays of each group, with the most code points, then the smallest id
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {w[3] for w in want}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_keeps_columns(spark):
    rows = [(k, "same") for k in range(4)] + [(9, "other"), (9, "other"), (None, "s ame"), (None, None)]
    df, _ = owned(spark, rows)
    kept = exact_dedup.keep_owners(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text, r.hash, r.kept) for r in kept.where("text IS NOT NULL").collect()) == [(False, 9, "other", "n", 7), (True, 0, "s ame", "n", 7)]
    assert kept.count() == 3
    assert owned(spark, [])[1] == []


def test_trie_spills_whole_subtrees():
    rnd = random.Random(5)
    keys = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))).encode() for _ in range(400)]
    trie, seen = exact_dedup.Trie(), []
    for k, key in enumerate(keys):
        trie.insert(key, (len(key), k, 1, 1))
        if k % 50 == 49:
            before = trie.held
            cut = list(trie.spill())
            assert len({c[0][:1] for c in cut}) == 1 and trie.held < before
            seen += cut
    seen += list(trie.drain())
    assert trie.held == 0 and not list(trie.drain())
    got = {}
    for key, owner in seen:
        got[key] = exact_dedup.merged(got.get(key), owner)
    assert got == {key: (len(key), keys.index(key), 1, n) for key, n in Counter(keys).items()}


# resampling


def simple_scores(docs, target, most, buckets, seed=2024):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)}
    out = []
    for i, x in docs:
        n, f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(y)] for y in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return out


@pytest.mark.parametrize("most,nodes", [(1, 1 << 18), (1, 3), (3, 1 << 18), (3, 10)])
def test_resampling(spark, most, nodes):
    rnd = random.Random(6)
    vocabulary = ["One", "two", "drei", "école", "日本", "a1", "x_y", "it's"]
    docs = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))) for k in range(80)] + [(None, "two " * 30), (None, None), (81, ""), (7, docs_text := "one " * 25), (7, docs_text)]
    target = [" ".join(rnd.choice(vocabulary[:3]) for _ in range(40)) for _ in range(5)] + [None, ""]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("1 AS score", "'w' AS weight", "text", "doc_id", "2 AS rank", "3 AS part").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string").selectExpr("9 AS bucket", "text")
    got = resampling.resample(d, t, percent=30, most=most, buckets=97, nodes=nodes).collect()
    want = simple_scores(docs, target, most, 97)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((i, f, w, s) for i, _, f, w, s in want)
    fit = sorted(((-s, i is None, i or 0) for i, n, _, _, s in want if n >= 20))
    drawn = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank is not None)
    assert drawn == [(k + 1, *x) for k, x in enumerate(fit[: 30 * len(fit) // 100])]


def test_resampling_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(k, "word " * 25) for k in range(10)], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    got = resampling.resample(some, none).collect()
    assert len(got) == 10 and sum(r.rank is not None for r in got) == 1
    assert resampling.drawn_documents(some, none, percent=50).count() == 5
