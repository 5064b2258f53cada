"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without ASCII white space; on UTF-8 bytes it is the same run.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The same for Spark's (Java) expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: A null id sorts before every other id.
NULL_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only in local mode."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        has = sc._jsc.sc().getCheckpointDir()
        found = has.get() if has.isDefined() else None
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tracklume_")
        sc.setCheckpointDir(found)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows of df behind a reliable checkpoint: lineage is cut, an executor may be lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that clash with none of df's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        at = f"tl_{name}"
        while at.lower() in taken:
            at += "_"
        taken.add(at.lower())
        out.append(at)
    return out


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), for whole arrays."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def table_of(schema: pa.Schema, cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def docs_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column's texts as bytes (null: empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]
