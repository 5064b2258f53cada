"""Readers of sensor logs, candidate tables and detections as lazy scans with fixed schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, parse
from ..operators import normalize

TRUTH = "sample int, longitude double, latitude double, altitude_m double, attitude_raw string, velocity_raw string, battery double, timestamp_raw string, field9 string, field10 string"
DETECTION = "frame_id int, object_id int, x1 double, y1 double, width double, height double, confidence double, class_id int, visibility double"
TRACK = (
    "struct<id:string,lla:array<double>,positionLLA:array<double>,velocityNed:array<double>,catProb:array<double>,"
    "range:double,azimuth:double,elevation:double,globalTime:string,rcs:double>"
)
RADAR = f"struct<trackData:array<{TRACK}>,globalTime:string,params:struct<trackData:array<{TRACK}>,globalTime:string>>"

#: Names under which the canonical candidate columns occur.
ALIASES = {
    "sequence_id": ("sequence_id", "sequence", "seq", "seq_id", "flight_id"),
    "source": ("source", "sensor", "modality"),
    "track_id": ("track_id", "track", "object_id", "id"),
    "candidate_branch": ("candidate_branch", "branch"),
    "x_m": ("x_m", "x", "east_m", "pose.pose.position.x", "position.x"),
    "y_m": ("y_m", "y", "north_m", "pose.pose.position.y", "position.y"),
    "z_m": ("z_m", "z", "up_m", "pose.pose.position.z", "position.z"),
    "confidence": ("confidence", "score", "probability", "conf"),
}
TIMES = {"time_s": 1.0, "timestamp": 1.0, "time": 1.0, "time_ms": 1e3, "timestamp_ms": 1e3, "time_us": 1e6, "time_ns": 1e9, "timestamp_ns": 1e9}
PAIRS = (("header.stamp.sec", "header.stamp.nanosec"), ("header.stamp.secs", "header.stamp.nsecs"), ("sec", "nanosec"))


def stripped(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])


def read_rf_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV; names lose outer spaces, values stay text until they are normalised."""
    return stripped(spark.read.csv(path, header=True))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ten-column CSV with quoted tuples."""
    return spark.read.schema(TRUTH).csv(path, quote='"', mode="PERMISSIVE")


def read_radar_tracks(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; a row per track.  A bad line fails the query; blank lines do not count.

    frame_index counts the records of a file in order: lines get their place from the file's whole
    text, so a file is one task, as it must be to number its lines.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("frame_index", "line"))
    rec = F.from_json("line", RADAR, {"mode": "FAILFAST"})
    d = lines.select("file", "frame_index", rec.alias("r"))
    tracks = F.coalesce("r.trackData", "r.params.trackData")
    d = d.select("file", "frame_index", F.coalesce("r.globalTime", "r.params.globalTime").alias("frame_time"), F.posexplode(tracks).alias("track_index", "t"))
    lla = F.coalesce("t.lla", "t.positionLLA")
    at = lambda a, i: F.get(a, F.lit(i))
    return d.select(
        "file", "frame_index", "track_index",
        parse.canonical_id(F.col("t.id")).alias("track_id"),
        at(lla, 0).alias("latitude"), at(lla, 1).alias("longitude"), at(lla, 2).alias("altitude_m"),
        *[at("t.velocityNed", i).alias(f"velocity_{c}_mps") for i, c in enumerate(("north", "east", "down"))],
        F.col("t.catProb").alias("cat_prob_raw"), at("t.catProb", 0).alias("cat_prob_uav"),
        F.col("t.range").alias("range_m"), F.col("t.azimuth").alias("azimuth_deg"), F.col("t.elevation").alias("elevation_deg"), F.col("t.rcs").alias("rcs"),
        F.coalesce("t.globalTime", "frame_time").alias("global_time"),
    )


def timestamp(c: Column) -> Column:
    """Two formats, with and without a fraction of a second."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss.SSS")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")))


def normalize_truth(truth: DataFrame) -> DataFrame:
    """Valid rows with relative seconds and ENU about the first of them in time."""
    d = truth.withColumn("timestamp", timestamp(F.col("timestamp_raw")))
    ok = F.col("timestamp").isNotNull()
    for c in ("latitude", "longitude", "altitude_m"):
        ok = ok & parse.finite(F.col(c)).isNotNull()
    d = d.where(ok)
    first = d.agg(F.min_by(F.struct("timestamp", "latitude", "longitude", "altitude_m"), F.struct("timestamp", "sample")).alias("o")).first()
    if first is None or first.o is None:
        return d.withColumns({c: F.lit(None).cast("double") for c in ("time_s", "east_m", "north_m", "up_m")})
    o = first.o
    e, n, u = geo.lla_to_enu(F.col("latitude"), F.col("longitude"), F.col("altitude_m"), (o.latitude, o.longitude, o.altitude_m))
    t = (F.unix_micros("timestamp") - F.unix_micros(F.lit(o.timestamp))) / F.lit(1e6)
    return d.withColumns({"time_s": t, "east_m": e, "north_m": n, "up_m": u})


def normalize_rf(rf: DataFrame, origin: tuple[float, float, float], start, default_std_m: float = 75.0, clock_offset_s: float = -4 * 3600.0) -> DataFrame:
    """Clock offset, invalid positions out (null island; the equator and the meridian stay), ENU, CEP as std."""
    num = {c: parse.finite(F.col(c)) for c in ("Latitude", "Longitude", "Elevation", "CEP") if c in rf.columns}
    lat, lon = num["Latitude"], num["Longitude"]
    alt = F.coalesce(num.get("Elevation", F.lit(None).cast("double")), F.lit(0.0))
    t = (F.unix_micros(timestamp(F.col("Time"))) - F.unix_micros(F.lit(start))) / F.lit(1e6) + clock_offset_s
    e, n, u = geo.lla_to_enu(lat, lon, alt, origin)
    std = num.get("CEP", F.lit(None).cast("double"))
    d = rf.withColumns({"time_s": t, "latitude": lat, "longitude": lon, "east_m": e, "north_m": n, "up_m": u, "std_m": F.when(std > 0, std).otherwise(F.lit(default_std_m))})
    return d.where("time_s IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)")


def _first(df: DataFrame, names: tuple) -> Column | None:
    lower = {c.lower(): c for c in df.columns}
    return next((F.col(f"`{lower[n]}`") for n in names if n in lower), None)


def normalize_candidates(df: DataFrame, default_sequence: str = "default", default_source: str = "candidate") -> DataFrame:
    """Canonical candidate columns from aliased ones; rows without a finite time and position go."""
    lower = {c.lower(): F.col(f"`{c}`") for c in df.columns}
    times = [parse.finite(lower[n]) / F.lit(k) for n, k in TIMES.items() if n in lower]
    times += [parse.finite(lower[a]) + parse.finite(lower[b]) / F.lit(1e9) for a, b in PAIRS if a in lower and b in lower]
    if not times:
        raise ValueError("no time column")
    found = {k: _first(df, v) for k, v in ALIASES.items()}
    absent = [k for k in ("x_m", "y_m", "z_m") if found[k] is None]
    if absent:
        raise ValueError(f"no column for {absent}")
    default = {"sequence_id": default_sequence, "source": default_source, "candidate_branch": "raw"}
    out = [F.coalesce(*times).alias("time_s")]
    for k, c in found.items():
        if k in default:
            out.append((parse.text_or(c, default[k]) if c is not None else F.lit(default[k])).alias(k))
        elif k == "track_id":
            out.append((parse.canonical_id(c) if c is not None else F.lit(None).cast("string")).alias(k))
        else:
            v = parse.finite(c) if c is not None else F.lit(None).cast("double")
            out.append((F.coalesce(v, F.lit(1.0)) if k == "confidence" else v).alias(k))
    d = df.select(*out)
    return d.where("time_s IS NOT NULL AND x_m IS NOT NULL AND y_m IS NOT NULL AND z_m IS NOT NULL").select("sequence_id", "time_s", "source", "track_id", "candidate_branch", "x_m", "y_m", "z_m", "confidence")


def read_candidates(spark: SparkSession, path: str, **defaults) -> DataFrame:
    """CSV, TSV or JSON lines (gzip too), by suffix; ids are read as text, so leading zeros stay."""
    name = path.lower().removesuffix(".gz")
    if name.endswith((".csv", ".txt")):
        d = spark.read.csv(path, header=True)
    elif name.endswith(".tsv"):
        d = spark.read.csv(path, header=True, sep="\t")
    elif name.endswith((".jsonl", ".ndjson")):
        d = spark.read.json(path, primitivesAsString=True)
    elif name.endswith(".json"):
        d = spark.read.json(path, multiLine=True, primitivesAsString=True)
    elif name.endswith(".parquet"):
        d = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown candidate format: {path}")
    return normalize_candidates(stripped(d), **defaults)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Nine-column detection text, one file per sequence; a row that breaks the format fails the query."""
    d = spark.read.schema(DETECTION).csv(path, mode="FAILFAST").withColumn("sequence_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", ""))
    return checked_detections(d)


def checked_detections(d: DataFrame) -> DataFrame:
    """Fails on ids that are not positive, boxes without size and numbers that are not finite."""
    finite = F.lit(True)
    for c in ("x1", "y1", "width", "height", "confidence"):
        finite = finite & (F.abs(F.col(c)) < float("inf"))  # neither infinite nor NaN, which sorts above infinity
    ok = F.expr("frame_id > 0 AND object_id > 0 AND width > 0 AND height > 0 AND visibility BETWEEN 0 AND 1") & finite
    return d.where(F.coalesce(ok, F.lit(False)) | F.raise_error(F.concat(F.lit("bad detection in "), F.col("sequence_id"))).cast("boolean"))


def merge(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of every file below a path."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Expected (path, n_bytes, sha256) against the files: ok, changed, missing or unexpected."""
    e = expected.select("path", F.col("n_bytes").alias("n_e"), F.col("sha256").alias("sha_e"))
    d = file_manifest(spark, path).join(e, "path", "full_outer")
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha_e").isNull(), "unexpected").when((F.col("sha256") == F.col("sha_e")) & (F.col("n_bytes") == F.col("n_e")), "ok").otherwise("changed")
    return d.select("path", status.alias("status"))


#: Names of a manifest's sequence, split and list fields, fields that are no splits, and texts that name nothing.
SEQUENCE_FIELDS = ("sequence_id", "sequence", "seq", "scene", "scene_id", "id", "name")
SPLIT_FIELDS = ("split", "subset", "partition", "fold", "set")
LIST_FIELDS = ("sequence_ids", "sequences", "ids", "items", "sequence_names")
ABOUT_FIELDS = ("schema", "version", "description", "metadata", "meta")
NOTHING = ("", "nan", "none", "<na>", "nat")


def _field(entry: dict, names: tuple) -> str | None:
    """The first of these fields, in any case, that has a text or number."""
    low = {str(k).lower(): v for k, v in entry.items()}
    texts = (str(low[n]).strip() for n in names if isinstance(low.get(n), (str, int, float)) and not isinstance(low.get(n), bool))
    return next((t for t in texts if t.lower() not in NOTHING), None)


def _ids(values: object) -> list[str]:
    """Sequence names in what stands under a split: a list of names or rows, a mapping by name, or an object with a list."""
    if isinstance(values, dict):
        if own := _field(values, SEQUENCE_FIELDS):
            return [own]
        low = {str(k).lower(): v for k, v in values.items()}
        inner = next((low[n] for n in LIST_FIELDS if n in low), None)
        if inner is not None:
            return _ids(inner)
        return [(_field(v, SEQUENCE_FIELDS) if isinstance(v, dict) else None) or str(k) for k, v in values.items() if str(k).lower() not in ABOUT_FIELDS]
    if isinstance(values, list):
        found = (_field(v, SEQUENCE_FIELDS) if isinstance(v, dict) else _field({"id": v}, ("id",)) for v in values)
        return [f for f in found if f is not None]
    return []


def split_rows(payload: object) -> list[tuple[str, str]]:
    """(sequence_id, split) of a manifest: rows with both fields, splits with their sequences, either of them under ``splits`` or ``sequences``."""
    if isinstance(payload, list):
        rows = [(_field(r, SEQUENCE_FIELDS), _field(r, SPLIT_FIELDS)) for r in payload if isinstance(r, dict)]
        return list(dict.fromkeys((a, b) for a, b in rows if a is not None and b is not None))
    if not isinstance(payload, dict):
        return []
    low = {str(k).lower(): v for k, v in payload.items()}
    for inner in ([payload], low.get("splits"), low.get("sequences")):
        if isinstance(inner, (list, dict)) and (found := split_rows(inner) if isinstance(inner, list) else _of_splits(inner)):
            return found
    return _of_splits(payload)


def _of_splits(splits: dict) -> list[tuple[str, str]]:
    return list(dict.fromkeys((i, str(k)) for k, v in splits.items() if str(k).lower() not in ABOUT_FIELDS for i in _ids(v)))


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest in CSV, JSON or YAML -> (sequence_id, split); a manifest is one small file.  One without any sequence fails."""
    if path.lower().endswith((".json", ".yaml", ".yml")):
        text = spark.read.text(path, wholetext=True).first()[0]
        if path.lower().endswith(".json"):
            payload = json.loads(text)
        else:
            import yaml

            payload = yaml.safe_load(text)
    else:
        payload = [r.asDict() for r in stripped(spark.read.csv(path, header=True)).collect()]
    rows = split_rows(payload)
    if not rows:
        raise ValueError(f"{path} names no sequences of a split")
    return normalize.split_manifest(spark.createDataFrame(rows, "sequence_id string, split string"))


#: Names of the folder that holds a data set's flights.
ROOT_NAMES = ("RF Sensor and Radar", "RF_Sensor_and_Radar")


def find_root(spark: SparkSession, path: str) -> str:
    """The folder of one of ``ROOT_NAMES`` at or below a path: the shortest, then the first; it fails if no file lies in one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    names = "|".join(ROOT_NAMES)
    root = F.regexp_extract("path", f"^(.*?/(?:{names}))/", 1)
    found = files.select(root.alias("root")).where("root <> ''").agg(F.min(F.struct(F.length("root").alias("n"), "root"))).first()[0]
    if found is None:
        raise FileNotFoundError(f"no folder {ROOT_NAMES[0]!r} at or below {path}")
    return found.root


def discover_flights(spark: SparkSession, path: str, variant: str = "auto") -> DataFrame:
    """Folders with an RF CSV, a radar JSON log or a truth text: one row per flight, with its files of a variant.

    A file whose name has ``rerun`` is of that variant, any other of ``original``; ``auto`` takes reruns where there are some.
    Of several files the first in the alphabet counts.  ``<kind>_variant`` says what was taken.
    """
    if variant not in ("auto", "original", "rerun"):
        raise ValueError(f"unknown variant {variant!r}")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name, folder = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    low = F.lower(name)
    again = low.contains("rerun")
    kinds = {"rf": low.endswith(".csv"), "radar": low.rlike(r"\.(json|jsonl|ndjson)$"), "truth": low.endswith(".txt")}
    wanted = F.lit(True) if variant == "auto" else again if variant == "rerun" else ~again
    first = [F.min(F.when(ok & wanted, F.struct((~again).alias("o"), F.col("path")))).alias(k) for k, ok in kinds.items()]
    g = d.groupBy(folder.alias("flight")).agg(*first, *[F.max(ok.cast("int")).alias(f"_{k}") for k, ok in kinds.items()]).where("_rf + _radar + _truth > 0")
    kind = lambda k: F.when(F.col(f"{k}.o"), "original").when(~F.col(f"{k}.o"), "rerun").alias(f"{k}_variant")
    return g.select("flight", *[F.col(f"{k}.path").alias(k) for k in kinds], *[kind(k) for k in kinds])


def select_flight(flights: DataFrame, name: str) -> DataFrame:
    """The exact name, else names that contain it in any case."""
    exact = F.col("flight") == name
    has = F.max(exact.cast("int")).over(Window.partitionBy())
    return flights.withColumn("_h", has).where(exact | ((F.col("_h") == 0) & F.contains(F.lower("flight"), F.lit(name.lower())))).drop("_h")
