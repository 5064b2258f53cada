"""URL filter: explicit rules, and association rules mined by FP-growth.

An explicit rule names a host (and so all its subdomains) and the start of a path;
the longest rule that fits decides.  Where none fits, the method's verdict holds:
FP-growth mines the combinations of URL tokens (host labels, path segments, query
keys) among labelled pages; a combination whose share of bad pages has enough
support and confidence, and more confidence than every part of it, becomes a
block rule.  Tokens that stand on the same labelled pages are one item.  Rules are matched through an inverted index: URL tokens join the
rules' tokens, and a rule fits when all of its tokens have met.

Defined results: a null url or one without ``://`` has an empty host and path, fits
no rule and is allowed; a null label counts as not bad; without labels, or
without any rule, everything is allowed; equal rows get equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .simhash import _stored

#: The standing rules of the contract: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Bad pages that a mined rule rests on at the least: fewer are chance.
LEAST = 10
#: The item of a bad page.
BAD = "!bad"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next of / ? #, A-Z lower-cased; empty without."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; digits in path segments count as one ``#``."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(labels, parts, keys))


def classes_of(rows: DataFrame) -> DataFrame:
    """(row, tokens, bad) -> (token, cls, n, hits): tokens that stand on the same labelled pages are one class, named by its least token.

    In every combination such tokens can stand for each other, so constant keys of a site count as one item.
    Pages are compared by two sums of hashes.
    """
    at = rows.select(F.explode("tokens").alias("token"), "row", "bad")
    print_of = [F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(38,0)")).alias(f"p{k}") for k in (1, 2)]
    tokens = at.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("hits"), *print_of)
    names = tokens.groupBy("n", "p1", "p2").agg(F.min("token").alias("cls"))
    return tokens.join(names, ["n", "p1", "p2"]).select("token", "cls", "n", "hits")


def mine(tokens: DataFrame, support: float, confidence: float, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(tokens array, bad boolean) -> rules (rule_id, items, confidence), least parts only, and the classes (token, cls) that items name.

    A rule rests on ``support`` of the labelled pages and on ``least`` bad ones at the least; it holds if each of its
    classes has a token in the URL.  FP-growth runs on the classes that enough bad pages hold.  A class that is always bad is a rule
    and no part of a wider one, so it does not take part.  Of the sets found, a rule stays if it is surer than every rule within it:
    the surest rule within a set is handed up from its sets of one item less, size by size.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = tokens.sparkSession
    rows = _stored(tokens.withColumn("row", F.monotonically_increasing_id()), "labelled")
    n, n_bad = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("bad"), 1))).first()
    none = spark.createDataFrame([], "rule_id long, items array<string>, confidence double"), spark.createDataFrame([], "token string, cls string")
    need = max(math.ceil(support * n), least)
    if n_bad < need:
        return none
    classes = _stored(classes_of(rows), "url_classes")
    some = classes.where(F.col("hits") >= need)
    sure = some.where(F.col("hits") == F.col("n")).select("cls").distinct()
    open_ = some.where(F.col("hits") < F.col("n")).select("token", "cls")
    at = rows.select("row", "bad", F.explode("tokens").alias("token")).join(open_, "token").groupBy("row", "bad").agg(F.collect_set("cls").alias("items"))
    at = _stored(at.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "class_rows")
    sets = spark.createDataFrame([], "items array<string>, hits long, n long, size int")
    if m := at.count():
        found = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / m, minConfidence=0.0).fit(at).freqItemsets
        found = _stored(found.select(F.sort_array("items").alias("items"), "freq"), "itemsets")
        whole = found.where(~F.array_contains("items", BAD)).withColumnRenamed("freq", "n")
        sets = found.where(F.array_contains("items", BAD)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("hits")).where(F.size("items") > 0).join(whole, "items")
    sets = _stored(sets.select("items", F.size("items").alias("size"), (F.col("hits") / F.col("n")).alias("confidence")), "rated_sets")
    kept = sure.select(F.array("cls").alias("items"), F.lit(1.0).alias("confidence"))
    best = None
    for size in range(1, (sets.agg(F.max("size")).first()[0] or 0) + 1):
        level = sets.where(F.col("size") == size).select("items", "confidence").withColumn("rule", F.col("confidence") >= confidence)
        if best is None:
            level = level.withColumn("within", F.lit(None).cast("double"))
        else:
            parts = level.select("items", F.explode("items").alias("gone")).select("items", F.array_remove("items", F.col("gone")).alias("part"))
            level = level.join(parts.join(best, "part").groupBy("items").agg(F.max("surest").alias("within")), "items", "left")
        level = _stored(level, "url_level")
        kept = kept.unionByName(level.where(F.col("rule") & (F.col("within").isNull() | (F.col("confidence") > F.col("within")))).select("items", "confidence"))
        best = level.select(F.col("items").alias("part"), F.greatest(F.when(F.col("rule"), F.col("confidence")), "within").alias("surest"))
    return kept.select(F.xxhash64("items").alias("rule_id"), "items", "confidence"), classes.join(kept.select(F.explode("items").alias("cls")).distinct(), "cls").select("token", "cls")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, support: float = 0.002, confidence: float = 0.75) -> DataFrame:
    """Pages (page_id, url) and labels (doc_id, quality, toxic) -> (page_id, host, path, rule, verdict).

    A page is bad if the document of its id is labelled toxic or of quality 0.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    tokens = tokens_of(F.col("url"), F.col("host"), F.col("path"))
    # equal hosts, directories and keys give equal token sets: each set is matched once
    rows = rows.withColumn("tokens", F.sort_array(tokens))
    rules_, classes = mine(rows.join(known, "page_id").select("tokens", "bad"), support, confidence)
    found, classes = _stored(rules_, "url_rules"), _stored(classes, "rule_tokens")
    sets = rows.select("tokens").distinct().withColumn("set_id", F.xxhash64("tokens"))
    index = found.select("rule_id", F.size("items").alias("need"), F.explode("items").alias("cls"))
    held = sets.select("set_id", F.explode("tokens").alias("token")).join(classes, "token").select("set_id", "cls").distinct()
    met = held.join(index, "cls").groupBy("set_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    blocked = met.where("n = need").select("set_id").distinct().withColumn("mined", F.lit(True))
    out = rows.withColumn("set_id", F.xxhash64("tokens")).join(blocked, "set_id", "left")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("mined"), "block").otherwise("allow")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first, so it comes last here
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, f"{host}{path}").otherwise(rule), F.when(fits, what).otherwise(verdict)
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
