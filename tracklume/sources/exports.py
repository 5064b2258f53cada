"""Exports of sequences: tables by suffix, nested JSON, archives, NumPy arrays, official results, folders of sequences."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import normalize
from .readers import DETECTION, checked_detections, normalize_candidates, stripped


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TSV, JSON, JSON lines (gzip too) or Parquet by suffix; values as text, so ids keep leading zeros."""
    name = path.lower().removesuffix(".gz")
    if name.endswith((".csv", ".txt")):
        return stripped(spark.read.csv(path, header=True))
    if name.endswith(".tsv"):
        return stripped(spark.read.csv(path, header=True, sep="\t"))
    if name.endswith((".jsonl", ".ndjson")):
        return stripped(spark.read.json(path, primitivesAsString=True))
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".json"):
        return read_json_records(spark, path)
    if name.endswith((".npy", ".npz")):
        return read_arrays(spark, path)
    raise ValueError(f"unknown format: {path}")


def records_of(value) -> list[dict]:
    """The first list of objects found in nested JSON, breadth first; an object of equally long lists is a table of columns; a lone object is one record."""
    todo, first = [value], None
    while todo:
        v = todo.pop(0)
        if isinstance(v, list):
            if v and all(isinstance(x, dict) for x in v):
                return v
            todo += [x for x in v if isinstance(x, (list, dict))]
        elif isinstance(v, dict):
            lists = [x for x in v.values() if isinstance(x, list)]
            if lists and len(lists) == len(v) and len({len(x) for x in lists}) == 1 and not any(isinstance(y, (dict, list)) for x in lists for y in x):
                return [dict(zip(v, row)) for row in zip(*lists)]
            first = v if first is None else first
            todo += [x for x in v.values() if isinstance(x, (list, dict))]
    return [first] if first else []


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON documents of any nesting, one document per file; values as text."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def go(parts):
        for p in parts:
            yield pd.DataFrame({"line": [json.dumps({str(k): v for k, v in r.items()}) for c in p["content"] for r in records_of(json.loads(bytes(c)))]}, dtype=object)

    rows = files.mapInPandas(go, "line string").select(F.from_json("line", "map<string, string>").alias("m"))
    names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("m"))).distinct().collect())  # a table's columns
    return stripped(rows.select(*[F.col("m").getItem(n).alias(n) for n in names]))


def read_arrays(spark: SparkSession, path: str, columns: tuple[str, ...] = ("time_s", "x_m", "y_m", "z_m")) -> DataFrame:
    """NPY or NPZ arrays of rows: structured ones by their own names, plain ones by ``columns``; pickled objects are refused."""
    files = spark.read.format("binaryFile").load(path).select("content", "path")

    def go(parts):
        for p in parts:
            for content, at in zip(p["content"], p["path"]):
                got = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                for a in [got] if isinstance(got, np.ndarray) else [got[k] for k in got.files]:
                    d = pd.DataFrame(a) if a.dtype.names else pd.DataFrame(np.atleast_2d(a)[:, : len(columns)], columns=list(columns)[: np.atleast_2d(a).shape[1]])
                    yield d.reindex(columns=list(columns)).astype(float).assign(file=at)

    return files.mapInPandas(go, ", ".join(f"{c} double" for c in columns) + ", file string")


def read_truth_table(spark: SparkSession, path: str, default_sequence: str = "default") -> DataFrame:
    """Truth of any of these formats in canonical columns."""
    return normalize.normalize_truth(read_table(spark, path), default_sequence)


def read_candidate_table(spark: SparkSession, path: str, **defaults) -> DataFrame:
    return normalize_candidates(read_table(spark, path), **defaults)


def official_results(df: DataFrame) -> DataFrame:
    """Sequence, Timestamp, Position "(x, y, z)", Classification -> sequence_id, time_s, x_m, y_m, z_m, label; a cell that cannot be read fails the query."""
    x, y, z = parse.position_cell(F.col("Position"))
    d = df.select(F.trim(F.col("Sequence").cast("string")).alias("sequence_id"), parse.finite(F.col("Timestamp")).alias("time_s"), x.alias("x_m"), y.alias("y_m"), z.alias("z_m"), F.expr("try_cast(Classification AS int)").alias("label"))
    ok = F.expr("time_s IS NOT NULL AND x_m IS NOT NULL AND y_m IS NOT NULL AND z_m IS NOT NULL AND sequence_id <> ''")
    return d.where(ok | F.raise_error(F.concat(F.lit("bad result row of sequence "), F.coalesce("sequence_id", F.lit("?")))).cast("boolean"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Official result rows from CSV or from the CSV members of a ZIP."""
    if path.lower().endswith(".zip"):
        lines = members(spark, path, ".csv").select(F.explode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("line")).where("trim(line) <> '' AND line NOT LIKE 'Sequence,%'")
        kind = "Sequence string, Timestamp string, Position string, Classification string"
        return official_results(lines.select(F.from_csv("line", kind).alias("r")).select("r.*"))
    return official_results(stripped(spark.read.csv(path, header=True)))


def template_times(results: DataFrame) -> DataFrame:
    """The distinct times that a template asks of each sequence."""
    return results.select("sequence_id", "time_s").distinct()


def members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Members of ZIP archives: (archive, member, content).  Absolute names, names that leave the archive and repeated names fail the query."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def go(parts):
        for p in parts:
            for at, content in zip(p["path"], p["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    seen: set[str] = set()
                    for info in z.infolist():
                        name = info.filename.replace("\\", "/")
                        if info.is_dir():
                            continue
                        if name.startswith("/") or ".." in name.split("/") or ":" in name.split("/")[0]:
                            raise ValueError(f"unsafe member {name!r}")
                        if name in seen:
                            raise ValueError(f"member {name!r} occurs twice")
                        seen.add(name)
                        if name.lower().endswith(suffix):
                            yield pd.DataFrame({"archive": [at], "member": [name], "content": [z.read(info)]})

    return files.mapInPandas(go, "archive string, member string, content binary")


def read_prediction_archive(spark: SparkSession, path: str) -> DataFrame:
    """Detections from the text members of a ZIP, one member per sequence."""
    text = members(spark, path, ".txt")
    name = F.regexp_replace(F.element_at(F.split("member", "/"), -1), r"\.txt$", "")
    lines = text.select(name.alias("sequence_id"), F.explode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("line")).where("trim(line) <> ''")
    return checked_detections(lines.select("sequence_id", F.from_csv("line", DETECTION, {"mode": "FAILFAST"}).alias("r")).select("r.*", "sequence_id"))


#: Words in file names and the role they stand for.
ROLES = (("truth", ("truth", "ground_truth", "groundtruth", "gt")), ("template", ("template",)), ("candidates", ("candidate", "candidates", "detections")), ("estimates", ("estimate", "estimates", "results")))
CLOUDS = (".pcd", ".ply", ".las", ".laz", ".bin")


def discover_sequences(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder, each with the sequence it belongs to (the first folder, or the stem of a file at the top) and its role by name."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    top = F.lit(root.rstrip("/") + "/")
    tail = F.regexp_replace(F.substring_index("path", ":", -1), r"^/+", "/")
    inside = F.split(F.expr("substring(tail, length(top) + 1)"), "/")
    d = d.withColumn("tail", tail).withColumn("top", top).withColumn("parts", inside)
    name = F.lower(F.element_at("parts", -1))
    stem = F.regexp_replace(F.element_at("parts", -1), r"\.[^.]*(\.gz)?$", "")
    role = F.lit("other")
    for kind, words in reversed(ROLES):
        role = F.when(name.rlike("(^|[^a-z])(" + "|".join(words) + ")([^a-z]|$)"), kind).otherwise(role)
    cloud = F.lit(False)
    for suffix in CLOUDS:
        cloud = cloud | name.endswith(suffix)
    return d.select(F.when(F.size("parts") > 1, F.get("parts", 0)).otherwise(stem).alias("sequence_id"), F.when(cloud, "points").otherwise(role).alias("role"), "path", F.col("length").alias("n_bytes"))


def sequence_manifest(files: DataFrame) -> DataFrame:
    """Per sequence the files of each role, in order, and what is missing."""
    g = files.groupBy("sequence_id").pivot("role", ["candidates", "truth", "template", "estimates", "points", "other"]).agg(F.sort_array(F.collect_list("path")))
    return g.withColumn("complete", (F.coalesce(F.size("candidates"), F.lit(0)) > 0) & (F.coalesce(F.size("truth"), F.lit(0)) > 0))


def read_topics(spark: SparkSession, topics: dict[str, str]) -> DataFrame:
    """Exports of bag topics, a table each: the union with the topic as source."""
    out = None
    for topic, path in topics.items():
        d = normalize_candidates(read_table(spark, path), default_source=topic)
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no topics")
    return out
