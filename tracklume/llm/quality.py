"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Each document gets counts and a few features in whole units (per mille, tenths).
The sketch of a feature is the histogram of those units: it merges by adding
counts, has at most 1,001 cells per group however many documents there are, is
the same for any partitioning, and gives quantiles that are exact to the unit.
Sketches are built per language and source, and merged to sketches per language
and of the whole corpus for groups of fewer than ``least_docs`` documents.  A
feature's fence is its upper quartile plus three times the interquartile range,
or plus the feature's least margin if that is larger, so a uniform source loses
nothing.  A document beyond a fence of its group is rejected.

Defined results: a null text is empty (no words, so it fails the base rules); a
null language or source is a group of its own; equal rows get equal results;
an empty table gives an empty result; other columns pass through
:func:`apply_rules` unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import fresh, text_or_empty
from .simhash import _stored

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Feature -> (its value in whole units, the least margin above the upper quartile).
FEATURES = {"symbols": 60, "dup_lines": 300, "word_length": 30, "repeats": 300}
CELLS = 1000
#: Groups (four numbers each) whose fences are broadcast; with more of them the join is an ordinary one.
MOST_BROADCAST = 20_000


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with tl_n_words, tl_word_chars, tl_n_symbols, tl_n_dup_lines, tl_n_lines, tl_n_repeat_words.

    The columns must be free; see :func:`rated`.  A 3-word window is compared by its 64-bit hash, then by its words.
    """
    t = text_or_empty(text)
    bare = lambda c: F.translate(c, SPACE, "")
    rows = docs.withColumn("tl_w", F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    lines = F.filter(F.split(t, "\n"), lambda x: bare(x) != "")
    rows = rows.withColumn("tl_lines", lines)
    n = F.size("tl_w")
    hashes = F.when(n >= 3, F.transform(F.slice("tl_w", 1, n - 2), lambda x, i: F.xxhash64(x, F.get("tl_w", i + 1), F.get("tl_w", i + 2))))
    rows = rows.withColumn("tl_h", hashes)
    again = F.size(F.array_distinct("tl_h")) < F.size("tl_h")
    rows = rows.withColumn("tl_s", F.when(again, F.sort_array(F.transform("tl_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def same(x: Column, y: Column) -> Column:
        word = lambda z, k: F.get("tl_w", z["i"] + k)
        return (x["h"] == y["h"]) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))

    near = lambda x, k: F.coalesce(same(x, F.get("tl_s", k - 1)), F.lit(False)) | F.coalesce(same(x, F.get("tl_s", k + 1)), F.lit(False))
    rows = rows.withColumn("tl_p", F.filter("tl_s", lambda x, k: near(x, k)))
    starts = F.transform("tl_p", lambda x: x["i"])
    rows = rows.withColumn("tl_p", starts)
    shifted = lambda k: F.transform("tl_p", lambda i: i + k)
    repeated = F.coalesce(F.size(F.array_distinct(F.concat(F.col("tl_p"), shifted(1), shifted(2)))), F.lit(0))
    chars = F.length(bare(t))
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        n.cast("long").alias("tl_n_words"),
        chars.cast("long").alias("tl_word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("tl_n_symbols"),
        (F.size("tl_lines") - F.size(F.array_distinct("tl_lines"))).cast("long").alias("tl_n_dup_lines"),
        F.size("tl_lines").cast("long").alias("tl_n_lines"),
        F.when(F.col("tl_p").isNull(), 0).otherwise(repeated).cast("long").alias("tl_n_repeat_words"),
    )


def _units() -> dict[str, Column]:
    """Features in whole units, at most CELLS: per mille of symbols among word characters, of repeated
    lines, tenths of characters a word, per mille of words in repeated windows."""
    of = lambda a, b, k: F.least(F.lit(CELLS), F.floor(F.lit(k) * F.col(a) / F.greatest(F.col(b), F.lit(1)))).cast("int")
    return {
        "symbols": of("tl_n_symbols", "tl_word_chars", 1000),
        "dup_lines": of("tl_n_dup_lines", "tl_n_lines", 1000),
        "word_length": of("tl_word_chars", "tl_n_words", 10),
        "repeats": of("tl_n_repeat_words", "tl_n_words", 1000),
    }


def sketches(rated: DataFrame) -> DataFrame:
    """Mergeable sketches: (lang, source, feature, unit, n); of documents that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"tl_{k}").alias("unit")) for k in FEATURES]))
    rows = rated.where(~F.col("tl_failed")).select(F.col("tl_lang"), F.col("tl_source"), pairs.alias("p"))
    return rows.groupBy("tl_lang", "tl_source", "p.feature", "p.unit").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, least_docs: int) -> DataFrame:
    """(tl_lang, tl_source, fence per feature): of the group itself, its language or the corpus."""
    levels = {0: ("tl_lang", "tl_source"), 1: ("tl_lang",), 2: ()}
    out = None
    for level, keys in levels.items():
        merged = sketch.groupBy(*keys, "feature", "unit").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "feature").orderBy("unit")
        cum = merged.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys, "feature")))
        quartile = lambda p: F.min(F.when(F.col("upto") * 4 >= F.col("all") * p, F.col("unit")))
        margin = reduce(lambda c, k: c.when(F.col("feature") == k, FEATURES[k]), list(FEATURES)[1:], F.when(F.col("feature") == list(FEATURES)[0], FEATURES[list(FEATURES)[0]]))
        f = cum.groupBy(*keys, "feature").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("all").alias("docs"))
        f = f.select(*keys, "feature", "docs", (F.col("q3") + F.greatest(3 * (F.col("q3") - F.col("q1")), margin)).alias("fence"))
        f = f.groupBy(*keys).agg(F.max("docs").alias(f"docs{level}"), *[F.max(F.when(F.col("feature") == k, F.col("fence"))).alias(f"{k}{level}") for k in FEATURES])
        if out is None:
            out = f
        elif keys:
            out = out.join(f.withColumnRenamed("tl_lang", "l"), F.col("tl_lang").eqNullSafe(F.col("l"))).drop("l")
        else:
            out = out.join(F.broadcast(f))  # one row
    pick = lambda k: F.when(F.col("docs0") >= least_docs, F.col(f"{k}0")).when(F.col("docs1") >= least_docs, F.col(f"{k}1")).otherwise(F.col(f"{k}2"))
    return out.select(F.col("tl_lang").alias("g_lang"), F.col("tl_source").alias("g_source"), *[pick(k).alias(f"fence_{k}") for k in FEATURES])


def rated(docs: DataFrame, least_docs: int, keep: list[str]) -> DataFrame:
    """``keep`` columns of docs (narrow ones: they are stored) with the counts, tl_failed and tl_kept."""
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    side = lambda c: F.col(at[c]).cast("string") if c in at else F.lit(None).cast("string")
    rows = counts(inner, at["text"])
    failed = (F.col("tl_n_words") < 50) | (100 * F.col("tl_n_repeat_words") > 50 * F.col("tl_n_words"))
    rows = rows.select(*[at[c] for c in keep], *[c for c in rows.columns if c.startswith("tl_")], side("lang").alias("tl_lang"), side("source").alias("tl_source"), failed.alias("tl_failed"), *[u.alias(f"tl_{k}") for k, u in _units().items()])
    rows = _stored(rows, "rated")  # the counts are dear and are read twice: for the sketches and for the verdicts
    limits = _stored(fences(sketches(rows), least_docs), "fences")
    if limits.count() <= MOST_BROADCAST:
        limits = F.broadcast(limits)
    judged = rows.join(limits, F.col("tl_lang").eqNullSafe(F.col("g_lang")) & F.col("tl_source").eqNullSafe(F.col("g_source")), "left")
    beyond = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"tl_{k}") > F.col(f"fence_{k}"), F.lit(False)) for k in FEATURES])
    names = [F.col(at[c]).alias(c) for c in keep]
    return judged.select(*names, *[F.col(f"tl_{c}").alias(c2) for c, c2 in zip(_COUNTS, fresh(docs, *_COUNTS))], F.col("tl_failed").alias(fresh(docs, "failed")[0]), (~F.col("tl_failed") & ~beyond).alias(fresh(docs, "kept")[0]))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_counts(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """Documents (doc_id, text, lang, source) -> counts and verdict of each."""
    narrow = docs.select(*[c for c in ("doc_id", "text", "lang", "source") if c in docs.columns])
    out = rated(narrow, least_docs, ["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"tl_{c}").alias(c) for c in _COUNTS], F.col("tl_failed").alias("base_failed"), F.col("tl_kept").alias("kept"))


def apply_rules(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """The documents that no rule rejects, with all their columns.

    Verdicts are stored without the texts, by 128 bits of hash of what they depend on; an anti join takes the rejected out.
    """
    a, b = fresh(docs, "ka", "kb")
    parts = [F.col(f"`{c}`").cast("string") for c in ("text", "lang", "source") if c in docs.columns]
    keyed = docs.withColumns({k: F.xxhash64(F.lit(i), *[F.coalesce(p, F.lit("")) for p in parts], *[p.isNull() for p in parts]) for i, k in enumerate((a, b))})
    narrow = keyed.select(*[c for c in ("text", "lang", "source") if c in docs.columns], a, b)
    verdicts = rated(narrow, least_docs, [a, b])
    rejected = verdicts.where(~F.col(fresh(narrow, "kept")[0])).select(a, b).distinct()
    return keyed.join(rejected, [a, b], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
