"""The data source of point files against the whole-file decoders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklume.sources import point_source, pointclouds


def files(folder):
    rng = np.random.default_rng(4)
    xyz = rng.normal(size=(5000, 3)).astype("<f4")
    xyz[7, 1] = np.nan
    wide = np.zeros(5000, [("i", "<u2"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("t", "<f8")])
    wide["x"], wide["y"], wide["z"] = xyz.T
    (folder / "a.bin").write_bytes(np.c_[xyz, np.zeros(5000, "<f4")].astype("<f4").tobytes())
    head = "VERSION .7\nFIELDS i x y z t\nSIZE 2 4 4 4 8\nTYPE U F F F F\nCOUNT 1 1 1 1 1\nWIDTH 5000\nHEIGHT 1\nPOINTS 5000\nDATA binary\n"
    (folder / "b.pcd").write_bytes(head.encode() + wide.tobytes())
    big = wide.astype([("i", ">u2"), ("x", ">f4"), ("y", ">f4"), ("z", ">f4"), ("t", ">f8")])
    (folder / "c.ply").write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 5000\nproperty ushort i\nproperty float x\nproperty float y\nproperty float z\nproperty double t\nend_header\n" + big.tobytes())
    las = bytearray(375)
    las[:4] = b"LASF"
    las[96:100], las[105:107], las[107:111] = (375).to_bytes(4, "little"), (20).to_bytes(2, "little"), (5000).to_bytes(4, "little")
    las[131:155], las[155:179] = np.array([0.01, 0.01, 0.1]).tobytes(), np.array([5.0, 6.0, 7.0]).tobytes()
    rows = np.zeros((5000, 20), np.uint8)
    rows[:, :12] = rng.integers(-1000, 1000, (5000, 3)).astype("<i4").view(np.uint8).reshape(5000, 12)
    (folder / "d.las").write_bytes(bytes(las) + rows.tobytes())
    (folder / "e.pcd").write_text("FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS 2\nDATA ascii\n1 2 3\n4 5 6\n")
    (folder / "notes.txt").write_text("no points")


@pytest.mark.parametrize("block", [700, 40_000, 1 << 30])
def test_blocks_give_the_same_points(spark, tmp_path, block):
    files(tmp_path)
    point_source.points_reader(spark)
    df = spark.read.format("points").option("block", block).load(str(tmp_path))
    tasks = df.rdd.getNumPartitions()
    assert (tasks > 100) if block == 700 else (tasks < 30)
    got = {}
    for r in df.collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.x_m, r.y_m, r.z_m))
    assert set(got) == {"a.bin", "b.pcd", "c.ply", "d.las", "e.pcd"}
    for name, rows in got.items():
        want = pointclouds.DECODERS[name.rsplit(".", 1)[-1]]((tmp_path / name).read_bytes())
        assert np.array_equal(np.array(sorted(rows)), np.array(sorted(map(tuple, want[np.isfinite(want).all(1)].tolist()))))


def test_only_asked_columns_and_a_round_trip(spark, tmp_path):
    point_source.points_reader(spark)
    df = spark.range(3000).select(F.col("id").cast("double").alias("x_m"), (F.col("id") % 7).cast("double").alias("y_m"), F.lit(2.5).alias("z_m"))
    df.repartition(3).write.format("points").mode("append").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.bin"))) == 3
    back = spark.read.format("points").schema("z_m double, x_m double").option("block", 2000).load(f"file://{tmp_path}/out")
    assert back.columns == ["z_m", "x_m"] and back.agg(F.sum("x_m"), F.count("*"), F.max("z_m")).first()[:] == (3000 * 2999 / 2, 3000, 2.5)
    with pytest.raises(Exception, match="no column"):
        spark.read.format("points").schema("w double").load(str(tmp_path / "out")).collect()
