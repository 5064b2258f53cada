"""Point clouds: PCD and PLY (ascii and binary), raw float32 and PointCloud2 blobs, decoded per file."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse

# Type letters of the formats.
PCD_TYPES = {("F", 4): "<f4", ("F", 8): "<f8", ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4"}
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
ROS_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


class _Bytes:
    """A reader that fails where the data ends too early."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> memoryview:
        if self.at + n > len(self.data):
            raise ValueError("LZF data end inside a run")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]


def lzf_decompress(data: bytes, size: int) -> bytes:
    """LibLZF: a control byte below 32 begins a literal run, any other a reference (length in its top three bits) to what stands before."""
    source, out = _Bytes(data), bytearray()
    while source.at < len(data):
        control = source.byte()
        if control < 32:
            out += source.take(control + 1)
            continue
        length = (control >> 5) + 2
        if length == 9:
            length += source.byte()
        back = ((control & 31) << 8 | source.byte()) + 1
        if back > len(out):
            raise ValueError("LZF reference before the start")
        piece = bytes(out[-back:][:length])
        out += (piece * (-(-length // len(piece))))[:length]  # a reference may overlap what it makes
    if len(out) != size:
        raise ValueError("LZF data of another length")
    return bytes(out)


def read_pcd(data: bytes) -> np.ndarray:
    m = re.search(rb"(?m)^DATA\s+(\S+)\s*\n", data)
    if not m:
        raise ValueError("PCD without DATA")
    head = {k.upper(): v for k, *v in (x.split() for x in data[: m.start()].decode("ascii", "replace").splitlines() if x.strip() and x[0] != "#")}
    fields, counts = head["FIELDS"], list(map(int, head.get("COUNT", ["1"] * len(head["FIELDS"]))))
    n, body, kind = int(head["POINTS"][0]), data[m.end() :], m[1].decode().lower()
    types = [PCD_TYPES[t, int(s)] for t, s in zip(head["TYPE"], head["SIZE"])]
    if kind == "ascii":
        at = dict(zip(fields, np.cumsum([0, *counts[:-1]])))
        rows = np.loadtxt(body.decode().splitlines(), ndmin=2)
        return rows[:, [at["x"], at["y"], at["z"]]].astype(float).reshape(-1, 3)
    kinds = [(f, t) if c == 1 else (f, t, (c,)) for f, t, c in zip(fields, types, counts)]
    if kind == "binary_compressed":
        packed, size = np.frombuffer(body, "<u4", 2)
        raw, at, cols = lzf_decompress(body[8 : 8 + int(packed)], int(size)), 0, {}
        for f, t, c in zip(fields, types, counts):
            cols[f] = np.frombuffer(raw, t, n * c, at)
            at += n * c * np.dtype(t).itemsize
        return np.stack([cols[a].astype(float) for a in "xyz"], 1)
    rows = np.frombuffer(body, np.dtype(kinds), n)
    return np.stack([rows[a].astype(float) for a in "xyz"], 1)


def read_ply(data: bytes) -> np.ndarray:
    end = data.index(b"end_header")
    end = data.index(b"\n", end) + 1
    lines = data[:end].decode("ascii", "replace").split("\n")
    fmt, kinds, n, inside = "", [], 0, False
    for line in lines:
        w = line.split()
        if w[:1] == ["format"]:
            fmt = w[1]
        elif w[:1] == ["element"]:
            inside = w[1] == "vertex"
            n = int(w[2]) if inside else n
        elif w[:1] == ["property"] and inside:
            kinds.append((w[2], PLY_TYPES[w[1]]))
    names = [k for k, _ in kinds]
    if fmt == "ascii":
        rows = np.loadtxt(data[end:].decode().splitlines()[:n], ndmin=2)
        return rows[:, [names.index(a) for a in "xyz"]].astype(float)
    order = "<" if "little" in fmt else ">"
    rows = np.frombuffer(data, np.dtype([(k, order + t) for k, t in kinds]), n, end)
    return np.stack([rows[a].astype(float) for a in "xyz"], 1)


def read_las(data: bytes) -> np.ndarray:
    """Uncompressed LAS: scaled integers behind the header's point offset."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    offset, = np.frombuffer(data, "<u4", 1, 96)
    size, = np.frombuffer(data, "<u2", 1, 105)
    n, = np.frombuffer(data, "<u4", 1, 107)
    if n == 0 and data[25] >= 4:
        n, = np.frombuffer(data, "<u8", 1, 247)
    scale, shift = np.frombuffer(data, "<f8", 3, 131), np.frombuffer(data, "<f8", 3, 155)
    raw = np.frombuffer(data, np.uint8, int(n) * int(size), int(offset)).reshape(int(n), int(size))
    return np.ascontiguousarray(raw[:, :12]).view("<i4").reshape(-1, 3) * scale + shift


def read_bin(data: bytes) -> np.ndarray:
    """Raw float32 rows of x, y, z, intensity."""
    return np.frombuffer(data, "<f4").reshape(-1, 4)[:, :3].astype(float)


def pointcloud2(data: bytes, fields: list[tuple[str, int, int]], step: int, n: int, big_endian: bool = False) -> np.ndarray:
    """Positions of a PointCloud2 message: fields are (name, offset, type number)."""
    order = ">" if big_endian else "<"
    at = {name: (offset, order + ROS_TYPES[kind]) for name, offset, kind in fields}
    kind = np.dtype({"names": list("xyz"), "formats": [at[a][1] for a in "xyz"], "offsets": [at[a][0] for a in "xyz"], "itemsize": step})
    rows = np.frombuffer(data, kind, n)
    return np.stack([rows[a].astype(float) for a in "xyz"], 1)


DECODERS = {"pcd": read_pcd, "ply": read_ply, "las": read_las, "bin": read_bin}


def read_points(spark: SparkSession, path: str, source: str = "lidar") -> DataFrame:
    """Files by suffix -> (file, time_s from the name, source, x_m, y_m, z_m); non-finite points go."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches):
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                xyz = DECODERS[p.rsplit(".", 1)[-1].lower()](bytes(data))
                xyz = xyz[np.isfinite(xyz).all(1)]
                yield pd.DataFrame({"file": p, "x_m": xyz[:, 0], "y_m": xyz[:, 1], "z_m": xyz[:, 2]})

    d = files.mapInPandas(decode, "file string, x_m double, y_m double, z_m double")
    return d.select("file", parse.last_number(F.col("file")).alias("time_s"), F.lit(source).alias("source"), "x_m", "y_m", "z_m")
