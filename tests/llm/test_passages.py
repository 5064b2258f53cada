"""Passage operators against brute force, with edge cases."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tracklume.llm import substring_dedup, suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_bytes(rows, length):
    """rows: distinct (id, text), in the operator's order -> {(id, text): (n, removed, spans, sha)}."""
    seen, out = set(), {}
    for doc_id, text in rows:
        t = (text or "").encode()
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            w = t[a : a + length]
            if w in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out[doc_id, text or ""] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, length):
    """rows: (id, text), repeated rows too -> {(id, text): (n, removed, sha)}."""
    words = [WORD.findall((r[1] or "").encode()) for r in rows]
    count = Counter(tuple(w[a : a + length]) for w in words for a in range(len(w) - length + 1))
    out = {}
    for (doc_id, text), w in zip(rows, words):
        gone = bytearray(len(w))
        for a in range(len(w) - length + 1):
            if count[tuple(w[a : a + length])] > 1:
                gone[a : a + length] = b"\1" * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[doc_id, text or ""] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["la", "de", "x", "été", "ab", "zz zz", " ", "q" * 50]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "word"), (None, "null id " * 30), (None, None)]
    for i in range(3, 40):
        words = [rnd.choice(vocabulary) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(0, 80))]
        if rnd.random() < 0.6:
            a = rnd.randint(0, 20)
            words[len(words) // 2 : len(words) // 2] = passage[a : a + rnd.randint(10, 40)]
        rows.append((i, " ".join(words) + rnd.choice(["", "\n", "\t \n", "|" * rnd.randint(1, 300)])))
    rows += [(50, rows[10][1]), (51, "ab " * 200), (52, "ab " * 150), (53, "\0" * 130 + "\xff" * 130)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_bytes(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows + [rows[12]], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS dk", "'x' AS k1", "2 AS spans")
    got = suffix_dedup.suffix_dedup_digest(df.repartition(3), window=40, gram=16).collect()
    assert len(got) == len(rows) + 1
    # a null id sorts first; of rows with one id the order is by a hash, so texts without a repeat are compared only
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or "")))
    want = brute_bytes(order, 40)
    ids = Counter(r[0] for r in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if ids[r.doc_id] == 1) == Counter(
        (i, *want[i, t or ""]) for i, t in rows + [rows[12]] if ids[i] == 1
    )


@pytest.mark.parametrize("batches", [1, 4])
def test_words(spark, batches):
    rows = corpus(7)
    rows += [rows[12], (3, "a lone row " * 20), (60, " ".join(f"q{i}" for i in range(30))), (60, " ".join(f"q{i}" for i in range(30))), (61, "short row"), (61, "short row"), (None, "null id " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("missing", "x")
    got = substring_dedup.substring_dedup(df, window=12, gram=4, batches=batches).collect()
    want = brute_words(rows, 12)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((i, *want[i, t or ""]) for i, t in rows)
    assert want[60, rows[-5][1]][1] == 30  # a row that stands twice recurs as a whole


def test_later_batches_meet_the_history(spark, tmp_path):
    rows = [r for r in corpus(9) if r[0] is not None]
    want = brute_words(rows, 12)
    old, new = rows[:25], rows[25:]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    first = substring_dedup.FingerprintIndex(spark, str(tmp_path / "ix"), window=12, gram=4, most_runs=1)
    substring_dedup.substring_dedup(frame(old), index=first, batches=2).count()
    assert first.compactions == 1
    again = substring_dedup.FingerprintIndex(spark, str(tmp_path / "ix"))
    assert (again.window, again.runs, len(again.texts)) == (12, first.runs, 2)
    got = substring_dedup.substring_dedup(frame(new), index=again, batches=1).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((i, *want[i, t or ""]) for i, t in new)
    assert "Exchange" not in again._bodies(again.runs[0], "a").hint("merge").join(again._bodies(again.runs[-1], "b").hint("merge"), "part")._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "Exchange")


def test_remove_repeats_keeps_columns(spark):
    df = spark.createDataFrame(corpus(3), "doc_id long, text string").selectExpr("'a' AS dk", "doc_id", "1.5D AS tl_k1", "text", "array(1) AS body")
    out = substring_dedup.remove_repeats(df, window=12, gram=4)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.where("text IS NULL").count() == df.where("text IS NULL").count()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.suffix_dedup_digest(df).count() == 0
    assert substring_dedup.substring_dedup(df).count() == 0


def test_index_compacts(spark):
    from tracklume.llm.anchors import ANCHORS, taken

    def postings(ix):
        rows = [r for at in ix.runs for r in ix._bodies(at, "body").collect()]
        return sorted(x for r in rows for v, d, _ in [taken(r.body, ANCHORS)] for x in zip(v.tolist(), d.tolist()))

    base = suffix_dedup._base(spark.createDataFrame(corpus(1), "doc_id long, text string"))
    index = substring_dedup.FingerprintIndex(spark, window=12, gram=4, most_runs=2)
    for k in range(5):
        index.add(base.where(f"pmod(dk, 5) = {k}"))
    assert len(index.runs) <= 2 and index.compactions >= 1
    whole = substring_dedup.FingerprintIndex(spark, window=12, gram=4)
    whole.add(base)
    assert {v for v, _ in postings(index)} >= {v for v, _ in postings(whole)} and postings(index)


def test_intervals_by_brute_force():
    rnd = random.Random(5)
    for _ in range(60):
        length = rnd.choice([3, 8, 20, 57, 100])
        pool = bytes(rnd.choice(b"ab\0\xff") for _ in range(300))
        texts = [b"".join(pool[a : a + rnd.randint(0, 150)] for a in (rnd.randint(0, 200), rnd.randint(0, 200))) or b"x" for _ in range(5)]
        seen, want = set(), []
        for i, t in enumerate(texts):
            for a in range(len(t) - length + 1):
                if t[a : a + length] in seen:
                    want.append((i, a))
                seen.add(t[a : a + length])
        which, at = suffix_dedup.later_windows(texts, length)
        assert list(zip(which.tolist(), at.tolist())) == want


@pytest.mark.parametrize("most_runs", [1, 2, 4, 5, 8])
def test_an_index_reopened_after_each_batch_keeps_its_state(spark, tmp_path, most_runs):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    frame = lambda rows: substring_dedup._base(spark.createDataFrame(rows, "doc_id long, text string"))
    before = set(t.name for t in spark.catalog.listTables())
    for k in range(10):
        index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "ix"), window=12, gram=4, most_runs=most_runs, buckets=2)
        assert (index.commits, len(index.texts), index.most_runs) == (k, k, most_runs) and len(index.runs) <= most_runs
        index.add(frame([(k, text(k))])).count()
    last = substring_dedup.FingerprintIndex(spark, str(tmp_path / "ix"))
    assert (last.runs, last.texts, last.compactions, last.commits) == (index.runs, index.texts, index.compactions, 10)
    got = substring_dedup.substring_dedup(spark.createDataFrame([(99, text(9)), (98, text(4)), (97, text(50))], "doc_id long, text string"), index=last, batches=1).collect()
    assert {r.doc_id: r.n_removed for r in got} == {99: 20, 98: 20, 97: 0}
    assert set(t.name for t in spark.catalog.listTables()) == before


def test_a_commit_is_whole_or_absent(spark, tmp_path):
    at = str(tmp_path / "ix")
    make = lambda: substring_dedup.FingerprintIndex(spark, at, window=12, gram=4, buckets=2)
    frame = substring_dedup._base(spark.createDataFrame([(1, "a b c " * 9)], "doc_id long, text string"))
    one, other = make(), make()
    one.add(frame).count()
    (tmp_path / "ix" / "manifest" / "_half").write_text("{")  # what a writer that died leaves
    assert make().runs == one.runs
    with pytest.raises(RuntimeError):
        other.add(frame)
    assert make().runs == one.runs
