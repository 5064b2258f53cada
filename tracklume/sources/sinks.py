"""Sinks: trajectory CSV, official result CSV and single-member ZIP."""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_trajectories(df: DataFrame, path: str, track_id: str = "track") -> None:
    """Estimates as CSV parts with a header."""
    df.select("sequence_id", "time_s", F.lit(track_id).alias("track_id"), "state_x_m", "state_y_m", "state_z_m").write.csv(path, header=True)


def official_rows(df: DataFrame, classification: int = 0) -> DataFrame:
    """Sequence, Timestamp, Position text and Classification; rows without a finite position fail."""
    ok = " AND ".join(f"state_{a}_m IS NOT NULL AND NOT isnan(state_{a}_m)" for a in "xyz")
    d = df.where(F.expr(ok) | F.raise_error(F.lit("a result row without a position")).cast("boolean"))
    cls = F.coalesce("classification", F.lit(classification)) if "classification" in df.columns else F.lit(classification)
    text = F.format_string("(%s, %s, %s)", *[F.col(f"state_{a}_m").cast("string") for a in "xyz"])
    return d.select(F.col("sequence_id").alias("Sequence"), F.col("time_s").alias("Timestamp"), text.alias("Position"), cls.cast("int").alias("Classification"))


def write_official_csv(df: DataFrame, path: str, classification: int = 0) -> None:
    official_rows(df, classification).write.csv(path, header=True)


def write_official_zip(df: DataFrame, path: str, member: str = "mmaud_results.csv", most_rows: int = 1_000_000) -> None:
    """A submission is one file by its format, so its rows pass through the driver; a larger table is refused."""
    rows = official_rows(df).orderBy("Sequence", "Timestamp").limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"over {most_rows} rows: write_official_csv has no such bound")
    text = io.StringIO()
    w = csv.writer(text)
    w.writerow(["Sequence", "Timestamp", "Position", "Classification"])
    w.writerows(rows)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, text.getvalue())
