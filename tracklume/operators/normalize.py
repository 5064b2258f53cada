"""Normalising truth, radar rows and splits to the canonical columns; selecting radar measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, parse
from .calibrate import draw
from .joins import asof_nearest
from .select import best_per_frame

# Other names of the canonical truth columns.
PARTS = "{0} pos_{0} position_{0} center_{0} bbox_center_{0} c{0} p{0} point.{0} position.{0} pose.position.{0} pose.pose.position.{0} translation.{0} transform.translation.{0} center.position.{0} bbox.center.position.{0} bbox.center.{0} location.{0} coordinates.{0}"
TRUTH_ALIASES = {
    "sequence_id": ("sequence", "seq", "scene", "scene_id", "clip", "clip_id"),
    "x_m": (*PARTS.format("x").split(), "east_m"),
    "y_m": (*PARTS.format("y").split(), "north_m"),
    "z_m": (*PARTS.format("z").split(), "up_m"),
    "class_name": ("uav_type", "class", "label", "category", "class_id"),
}


def renamed(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Canonical names for the first alias present (case does not matter); a canonical column that is there stays."""
    lower = {c.strip().lower(): c for c in df.columns}
    for name, others in aliases.items():
        if name not in lower and (hit := next((lower[o] for o in others if o in lower), None)) is not None:
            df = df.withColumnRenamed(hit, name)
    return df


def normalize_truth(df: DataFrame, default_sequence: str = "default") -> DataFrame:
    """sequence_id, time_s, x_m, y_m, z_m (and what else there is): numbers parsed, rows that lack one dropped, blank sequences given the default."""
    d = renamed(df, TRUTH_ALIASES)
    d = d if "time_s" in d.columns else d.withColumn("time_s", parse.seconds(d))
    missing = {"time_s", "x_m", "y_m", "z_m"} - set(d.columns)
    if missing:
        raise ValueError(f"truth lacks {sorted(missing)}")
    if "sequence_id" not in d.columns:
        d = d.withColumn("sequence_id", F.lit(default_sequence))
    numbers = {c: parse.finite(F.col(c)) for c in ("time_s", "x_m", "y_m", "z_m")}
    d = d.withColumns({**numbers, "sequence_id": parse.text_or(F.col("sequence_id").cast("string"), default_sequence)})
    return d.where(" AND ".join(f"{c} IS NOT NULL" for c in numbers))


#: Numeric columns of radar tracks.
RADAR_NUMBERS = (
    "latitude", "longitude", "altitude_m", "cat_prob_uav", "range_m", "azimuth_deg", "elevation_deg", "rcs_dbsm", "radial_velocity_mps", "num_inliers",
    "track_age", "confidence", "velocity_east_mps", "velocity_north_mps", "velocity_down_mps",
)


def normalize_radar(df: DataFrame, origin: tuple[float, float, float], origin_time_s: float, clock_offset_s: float = 0.0) -> DataFrame:
    """Radar tracks with time_s relative to the truth's first time (after the radar's own clock offset) and local ENU columns; rows without a time or place go."""
    d = df.withColumns({c: parse.finite(F.col(c)) for c in (*RADAR_NUMBERS, "global_time_raw_s") if c in df.columns})
    d = d.withColumn("time_s", F.col("global_time_raw_s") + clock_offset_s - origin_time_s)
    d = d.where("time_s IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND altitude_m IS NOT NULL")
    e, n, u = geo.lla_to_enu(F.col("latitude"), F.col("longitude"), F.col("altitude_m"), origin)
    return d.withColumns({"east_m": e, "north_m": n, "up_m": u})


def probable(df: DataFrame, threshold: float, prob: str = "cat_prob_uav") -> DataFrame:
    """Rows whose probability reaches the threshold (nulls do not)."""
    return df.where(F.col(prob) >= threshold)


def within_range(df: DataFrame, limit: float, required: bool = True, range_col: str = "range_m") -> DataFrame:
    """Rows within a range; rows without a range go if it is required, else they stay."""
    ok = F.col(range_col) <= limit
    return df.where(F.coalesce(ok, F.lit(not required)))


def require_range(df: DataFrame, range_col: str = "range_m") -> DataFrame:
    """The rows as they are; a run fails on the first row without a range."""
    if range_col not in df.columns:
        raise ValueError(f"{range_col} is needed")
    bad = F.col(range_col).isNull() | F.isnan(range_col)
    return df.withColumn(range_col, F.when(bad, F.raise_error(F.lit(f"{range_col} is needed in every row")).cast("double")).otherwise(F.col(range_col)))


def truth_gated(df: DataFrame, truth: DataFrame, keys: list[str], axes: list[str], gate_m: float, gate_s: float) -> DataFrame:
    d = asof_nearest(df, truth, keys, payload=[*axes, "key"], order="key", tolerance=gate_s)
    return d.where(geo.distance([F.col(a) for a in axes], [F.col(f"match.{a}") for a in axes]) <= gate_m).drop("match")


def select_radar(df: DataFrame, selection: str = "catprob", threshold: float = 0.5, frame: list[str] | None = None, prob: str = "cat_prob_uav", truth: DataFrame | None = None, gate_m: float = 150.0, gate_s: float = 1.0, axes: list[str] | None = None) -> DataFrame:
    """none, all, catprob (each frame's best row over the threshold), catprob-all (all over it), truth-gated (near the truth in time and space)."""
    frame = frame or ["frame_index"]
    if selection == "none":
        return df.where("false")
    if selection == "all":
        return df
    if selection == "catprob":
        order = [F.col(prob).desc(), *[F.col(c) for c in ("track_id", "track_index", "key") if c in df.columns]]
        return best_per_frame(probable(df, threshold, prob), frame, order)
    if selection == "catprob-all":
        return probable(df, threshold, prob)
    if selection == "truth-gated":
        if truth is None:
            raise ValueError("truth-gated selection needs the truth")
        return truth_gated(df, truth, frame[:1], axes or ["x_m", "y_m", "z_m"], gate_m, gate_s)
    raise ValueError(f"unknown selection {selection!r}")


def in_truth_window(df: DataFrame, truth: DataFrame, keys: list[str], margin_s: float = 0.0) -> DataFrame:
    """Rows within their key's first and last truth time, widened by a margin."""
    span = truth.groupBy(*keys).agg(F.min("time_s").alias("_a"), F.max("time_s").alias("_b"))
    return df.join(span, keys).where(F.col("time_s").between(F.col("_a") - margin_s, F.col("_b") + margin_s)).drop("_a", "_b")


def shifted(df: DataFrame, offset_s: float) -> DataFrame:
    """time_s moved by an offset once: the offset is kept in ``time_offset_s``, and a second call moves by the difference only."""
    done = F.coalesce(F.col("time_offset_s"), F.lit(0.0)) if "time_offset_s" in df.columns else F.lit(0.0)
    return df.withColumn("time_s", F.col("time_s") - done + offset_s).withColumn("time_offset_s", F.lit(float(offset_s)))


def split_manifest(rows: DataFrame) -> DataFrame:
    """(sequence_id, split) from a manifest; a sequence in two splits is an error."""
    d = rows.select(parse.text_or(F.col("sequence_id").cast("string"), "").alias("sequence_id"), F.lower(F.trim("split")).alias("split")).where("sequence_id <> ''").distinct()
    g = d.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("_n"), F.min("split").alias("split"))
    bad = F.raise_error(F.concat(F.lit("more than one split for sequence "), "sequence_id"))
    return g.select("sequence_id", F.when(F.col("_n") > 1, bad).otherwise(F.col("split")).alias("split"))


def in_split(df: DataFrame, manifest: DataFrame, split: str) -> DataFrame:
    """Rows of the sequences of one split."""
    return df.join(manifest.where(F.col("split") == split.strip().lower()).select("sequence_id"), "sequence_id", "left_semi")


def perturbed(df: DataFrame, key: list[str], axes: list[str], seed: int, drop: float = 0.0, noise_m: float = 0.0, jitter_s: float = 0.0, false_share: float = 0.0, spread_m: float = 100.0) -> DataFrame:
    """Rows dropped, moved, shifted in time and joined by false ones, by seeded hashes of their keys: the same on any partitioning."""

    def uniform(salt: str) -> Column:
        return draw(seed, F.lit(salt), *[F.col(k) for k in key]) + 0.5 / (1 << 32)

    def normal(salt: str) -> Column:
        return F.sqrt(-2 * F.log(uniform(salt + "a"))) * F.cos(2 * F.pi() * uniform(salt + "b"))

    kept = df.where(uniform("drop") >= drop)
    moved = kept.withColumns({**{a: F.col(a) + noise_m * normal(a) for a in axes}, "time_s": F.col("time_s") + jitter_s * (2 * uniform("t") - 1)}).withColumn("is_false", F.lit(False))
    false = kept.where(uniform("false") < false_share).withColumns({a: F.col(a) + spread_m * (2 * uniform("f" + a) - 1) for a in axes}).withColumn("is_false", F.lit(True))
    return moved.unionByName(false)
