"""Point files as a Python data source: a file is read by several tasks, each its own range of records.

``points_reader(spark)`` registers the format ``points``.  Files of fixed-size records (LAS, binary PCD and PLY, raw float32) are cut into
blocks of about ``block`` bytes; a task reads the header and then only its records, in pieces of bounded size.
Text and compressed files are one task's work each.  Only the columns of the schema that is asked for are handed on:

    spark.read.format("points").schema("file string, z_m double").option("block", 1 << 26).load(folder)

Files are opened through Arrow's file systems, on executors.  Points that are not finite go.  The format also writes raw float32 files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .pointclouds import DECODERS, PCD_TYPES, PLY_TYPES

AXES = ("x_m", "y_m", "z_m")
BLOCK = 64 << 20
#: Bytes in which a header must end, and records decoded at once.
HEAD, PIECE = 1 << 16, 1 << 16


@dataclass
class Layout:
    """Where the records of a file lie, and each axis within a record."""

    start: int
    size: int
    n: int
    at: dict[str, tuple[str, int]]
    scale: tuple = (1.0, 1.0, 1.0)
    shift: tuple = (0.0, 0.0, 0.0)


def _offsets(kinds: list[tuple[str, str, int]]) -> tuple[dict[str, tuple[str, int]], int]:
    out, at = {}, 0
    for name, kind, count in kinds:
        out[name] = (kind, at)
        at += np.dtype(kind).itemsize * count
    return out, at


def layout_of(suffix: str, head: bytes, size: int) -> Layout | None:
    """None: the file cannot be cut."""
    if suffix == "bin":
        return Layout(0, 16, size // 16, {a: ("<f4", 4 * i) for i, a in enumerate("xyz")})
    if suffix == "las" and head[:4] == b"LASF":
        n = int(np.frombuffer(head, "<u4", 1, 107)[0]) or (int(np.frombuffer(head, "<u8", 1, 247)[0]) if head[25] >= 4 else 0)
        scale, shift = (tuple(np.frombuffer(head, "<f8", 3, k).tolist()) for k in (131, 155))
        return Layout(int(np.frombuffer(head, "<u4", 1, 96)[0]), int(np.frombuffer(head, "<u2", 1, 105)[0]), n, {a: ("<i4", 4 * i) for i, a in enumerate("xyz")}, scale, shift)
    if suffix == "pcd" and (m := re.search(rb"(?m)^DATA\s+binary\s*\n", head)):
        words = {k.upper(): v for k, *v in (x.split() for x in head[: m.start()].decode("ascii", "replace").splitlines() if x.strip() and x[0] != "#")}
        counts = map(int, words.get("COUNT", ["1"] * len(words["FIELDS"])))
        at, record = _offsets([(f, PCD_TYPES[t, int(s)], c) for f, t, s, c in zip(words["FIELDS"], words["TYPE"], words["SIZE"], counts)])
        return Layout(m.end(), record, int(words["POINTS"][0]), at)
    if suffix == "ply" and (m := re.search(rb"end_header\r?\n", head)):
        lines = [x.split() for x in head[: m.start()].decode("ascii", "replace").splitlines()]
        fmt = next(x[1] for x in lines if x[:1] == ["format"])
        first = next((i for i, x in enumerate(lines) if x[:1] == ["element"]), None)
        if fmt == "ascii" or first is None or lines[first][1] != "vertex":
            return None
        own = []
        for x in lines[first + 1 :]:
            if x[:1] == ["element"]:
                break
            if x[:1] == ["property"]:
                own.append(x)
        if any(x[1] == "list" for x in own):
            return None
        order = "<" if "little" in fmt else ">"
        at, record = _offsets([(x[2], order + PLY_TYPES[x[1]], 1) for x in own])
        return Layout(m.end(), record, int(lines[first][2]), at)
    return None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    k: int
    of: int


class PointReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        unknown = set(self.names) - {"file", *AXES}
        if unknown:
            raise ValueError(f"points have no column {sorted(unknown)}")
        self.path, self.block = options["path"], int(options.get("block", BLOCK))

    def partitions(self):
        store, at = _opened(self.path)
        info = store.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        out = []
        for f in sorted(files, key=lambda x: x.path):
            suffix = f.path.rsplit(".", 1)[-1].lower()
            if f.type == fs.FileType.File and suffix in DECODERS:
                of = max(1, -(-f.size // self.block)) if suffix in ("bin", "las", "pcd", "ply") else 1
                out += [Range(f.path, k, of) for k in range(of)]
        return out

    def _batch(self, path: str, xyz: np.ndarray) -> pa.RecordBatch:
        xyz = xyz[np.isfinite(xyz).all(1)]
        cols = {"file": lambda: pa.array([path] * len(xyz)), **{a: (lambda i=i: pa.array(np.ascontiguousarray(xyz[:, i]))) for i, a in enumerate(AXES)}}
        return pa.RecordBatch.from_arrays([cols[n]() for n in self.names], names=self.names)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        suffix = part.path.rsplit(".", 1)[-1].lower()
        with store.open_input_file(part.path) as f:
            size = f.size()
            layout = layout_of(suffix, f.read_at(min(HEAD, size), 0), size)
            if layout is None:
                if part.k == 0:
                    yield self._batch(part.path, DECODERS[suffix](f.read_at(size, 0)))
                return
            first, last = layout.n * part.k // part.of, layout.n * (part.k + 1) // part.of
            for i in range(first, last, PIECE):
                count = min(PIECE, last - i)
                raw = np.frombuffer(f.read_at(count * layout.size, layout.start + i * layout.size), np.uint8).reshape(count, layout.size)
                cols = []
                for a, k, b in zip("xyz", layout.scale, layout.shift):
                    kind, at = layout.at[a]
                    cols.append(np.ascontiguousarray(raw[:, at : at + np.dtype(kind).itemsize]).view(kind)[:, 0].astype(float) * k + b)
                yield self._batch(part.path, np.stack(cols, 1))


@dataclass
class Written(WriterCommitMessage):
    path: str


class PointWriter(DataSourceWriter):
    """One raw float32 file (x, y, z, 0) for each task; a job that fails leaves none."""

    def __init__(self, schema, options):
        names = [f.name for f in schema.fields]
        self.at, self.path = [names.index(a) for a in AXES], options["path"]

    def write(self, iterator):
        store, at = _opened(self.path)
        store.create_dir(at, recursive=True)
        name, held = f"{at}/points-{uuid.uuid4().hex}.bin", []
        with store.open_output_stream(name) as out:
            for row in iterator:
                held.append([row[i] for i in self.at] + [0.0])
                if len(held) >= PIECE:
                    out.write(np.array(held, "<f4").tobytes())
                    held = []
            if held:
                out.write(np.array(held, "<f4").tobytes())
        return Written(name)

    def commit(self, messages):
        pass

    def abort(self, messages):
        store, _ = _opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class Points(DataSource):
    @classmethod
    def name(cls):
        return "points"

    def schema(self):
        return "file string, x_m double, y_m double, z_m double"

    def reader(self, schema):
        return PointReader(schema, self.options)

    def writer(self, schema, overwrite):
        return PointWriter(schema, self.options)


def points_reader(spark: SparkSession) -> SparkSession:
    """Registers the format ``points`` with the session."""
    spark.dataSource.register(Points)
    return spark
