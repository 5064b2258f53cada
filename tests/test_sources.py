import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklume.sources import pointclouds as P
from tracklume.sources import readers as R
from tracklume.sources import sinks


def test_truth_and_rf(spark, tmp_path):
    truth = tmp_path / "t.txt"
    truth.write_text('2,-78.0,35.001,120,"(0,0,0)","(1,2,3)",90,2024-01-01 10:00:01.500,a,b\n1,-78.0,35.0,100,"(0,0,0)","(1,2,3)",90,2024-01-01 10:00:00,a,b\n3,-78,35,1,"x","y",9,bad,a,b\n')
    t = R.normalize_truth(R.read_truth(spark, str(truth))).orderBy("time_s").collect()
    assert [r.time_s for r in t] == [0.0, 1.5] and t[0].velocity_raw == "(1,2,3)"
    assert abs(t[0].east_m) < 1e-6 and abs(t[0].up_m) < 1e-6 and 110 < t[1].north_m < 112
    rf = tmp_path / "rf.csv"
    rf.write_text(" Time , Latitude,Longitude,Elevation,CEP\n2024-01-01 14:00:01,35.0,-78.0,100,\n2024-01-01 14:00:02,0,0,0,5\n2024-01-01 14:00:03,0,-78,0,5\n2024-01-01 14:00:04,x,-78,0,5\n")
    got = R.normalize_rf(R.read_rf_csv(spark, str(rf)), (35.0, -78.0, 100.0), t[0].timestamp).orderBy("time_s").collect()
    assert [r.time_s for r in got] == [1.0, 3.0] and got[0].std_m == 75.0 and got[1].std_m == 5.0


def test_radar(spark, tmp_path):
    f = tmp_path / "r.jsonl"
    rows = [{"globalTime": "g", "trackData": [{"id": 7.0, "lla": [35, -78, 10], "catProb": [0.9], "range": 5}]}, {"params": {"trackData": [{"id": "007", "positionLLA": [1, 2, 3]}, {"id": "b"}]}}]
    f.write_text(json.dumps(rows[0]) + "\n\n" + json.dumps(rows[1]) + "\n")
    got = R.read_radar_tracks(spark, str(f)).orderBy("frame_index", "track_index").collect()
    assert [(r.frame_index, r.track_index, r.track_id, r.latitude, r.cat_prob_uav) for r in got] == [(0, 0, "7", 35.0, 0.9), (1, 0, "007", 1.0, None), (1, 1, "b", None, None)]
    f.write_text("{bad\n")
    with pytest.raises(Exception):
        R.read_radar_tracks(spark, str(f)).collect()


def test_candidates(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text("Sequence,header.stamp.sec,header.stamp.nanosec,X,Y,Z,Track,Score\n007,3,250000000,1,2,3,1.0,0.5\n nan ,4,0,1,inf,3,2,0.5\n,5,0,1,2,3,,\n")
    got = R.read_candidates(spark, str(f)).orderBy("time_s").collect()
    assert [(r.sequence_id, r.time_s, r.track_id, r.confidence, r.source) for r in got] == [("007", 3.25, "1", 0.5, "candidate"), ("default", 5.0, None, 1.0, "candidate")]
    j = tmp_path / "c.jsonl"
    j.write_text('{"seq": "01", "time_ms": 1500, "x": 1, "y": 2, "z": 3, "sensor": "radar"}\n')
    both = R.merge([R.read_candidates(spark, str(f)), R.read_candidates(spark, str(j))])
    assert both.count() == 3 and both.where("source = 'radar'").first().time_s == 1.5
    with pytest.raises(ValueError):
        R.read_candidates(spark, "a.xyz")


def test_detections(spark, tmp_path):
    (tmp_path / "S.txt").write_text("1,5,0,0,10,10,0.9,1,1\n")
    assert R.read_detections(spark, str(tmp_path / "S.txt")).first().sequence_id == "S"
    (tmp_path / "B.txt").write_text("1,5,0,0,-1,10,0.9,1,1\n")
    with pytest.raises(Exception):
        R.read_detections(spark, str(tmp_path / "B.txt")).collect()


def test_manifest_and_flights(spark, tmp_path):
    for name in ("Opt1/rf.csv", "Opt1/radar.jsonl", "Opt2/truth.txt"):
        p = tmp_path / "d" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    m = R.file_manifest(spark, str(tmp_path / "d"))
    saved = spark.createDataFrame(m.collect(), m.schema)
    (tmp_path / "d/Opt2/truth.txt").write_text("other")
    got = {r.path.rsplit("/", 1)[-1]: r.status for r in R.verify_manifest(spark, str(tmp_path / "d"), saved).collect()}
    assert got == {"rf.csv": "ok", "radar.jsonl": "ok", "truth.txt": "changed"}
    flights = R.discover_flights(spark, str(tmp_path / "d"))
    assert {r.flight for r in flights.collect()} == {"Opt1", "Opt2"}
    assert R.select_flight(flights, "opt2").first().flight == "Opt2" and R.select_flight(flights, "Opt1").count() == 1


def test_pointclouds(spark, tmp_path):
    xyz = np.array([[1.0, 2, 3], [4, 5, 6], [7, 8, 9]], np.float32)
    head = "VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 3\nHEIGHT 1\nPOINTS 3\nDATA {}\n"
    (tmp_path / "a_1.5.pcd").write_bytes(head.format("ascii").encode() + b"1 2 3\n4 5 6\n7 8 9\n")
    (tmp_path / "b_2.pcd").write_bytes(head.format("binary").encode() + xyz.tobytes())
    raw = xyz.T.tobytes()
    packed = b"".join(bytes([len(raw[i : i + 32]) - 1]) + raw[i : i + 32] for i in range(0, len(raw), 32))
    (tmp_path / "c_3.pcd").write_bytes(head.format("binary_compressed").encode() + struct.pack("<II", len(packed), len(raw)) + packed)
    ply = "ply\nformat {} 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (tmp_path / "d_4.ply").write_bytes(ply.format("ascii").encode() + b"1 2 3\n4 5 6\n7 8 9\n")
    (tmp_path / "e_5.ply").write_bytes(ply.format("binary_big_endian").encode() + xyz.astype(">f4").tobytes())
    (tmp_path / "f_6.bin").write_bytes(np.hstack([xyz, np.zeros((3, 1), np.float32)]).tobytes())
    las = bytearray(227)
    las[:4] = b"LASF"
    struct.pack_into("<I", las, 96, 227)
    struct.pack_into("<BHI", las, 104, 0, 20, 3)
    struct.pack_into("<6d", las, 131, 0.01, 0.01, 0.01, 0, 0, 0)
    (tmp_path / "g_7.las").write_bytes(bytes(las) + b"".join(struct.pack("<iii8x", *(int(v) * 100 for v in p)) for p in xyz))
    got = R.merge([P.read_points(spark, str(p)) for p in sorted(tmp_path.iterdir())]).groupBy("time_s").agg(F.sum("x_m").alias("x"), F.sum("z_m").alias("z"), F.count("*").alias("n")).collect()
    assert sorted(r.time_s for r in got) == [1.5, 2, 3, 4, 5, 6, 7] and all((r.x, r.z, r.n) == (12, 18, 3) for r in got)
    blob = np.hstack([np.zeros((3, 1), np.float32), xyz]).tobytes()
    assert np.array_equal(P.pointcloud2(blob, [("x", 4, 7), ("y", 8, 7), ("z", 12, 7)], 16, 3), xyz)


def test_back_references():
    assert P.lzf_decompress(bytes([2]) + b"abc" + bytes([(4 << 5), 2]), 9) == b"abcabcabc"
    assert P.lzf_decompress(bytes([0]) + b"z" + bytes([(7 << 5), 3, 0]), 13) == b"z" * 13
    for bad in (bytes([2]) + b"abc" + bytes([(4 << 5), 3]), bytes([5]) + b"ab", bytes([(7 << 5)]), bytes([0]) + b"a"):
        with pytest.raises(ValueError):
            P.lzf_decompress(bad, 9)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", 1.0, 1.5, 2.0, 3.0), ("s", 0.5, 0.0, 0.0, 0.0)], "sequence_id string, time_s double, state_x_m double, state_y_m double, state_z_m double")
    sinks.write_official_zip(df, str(tmp_path / "o.zip"), "r.csv")
    with zipfile.ZipFile(tmp_path / "o.zip") as z:
        assert z.namelist() == ["r.csv"] and z.read("r.csv").decode().splitlines() == ["Sequence,Timestamp,Position,Classification", 's,0.5,"(0.0, 0.0, 0.0)",0', 's,1.0,"(1.5, 2.0, 3.0)",0']
    sinks.write_trajectories(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 2
    with pytest.raises(Exception):
        sinks.official_rows(df.withColumn("state_x_m", F.lit(None).cast("double"))).collect()


def test_exports(spark, tmp_path):
    from tracklume.sources import exports as X

    nested = {"meta": {"n": 2}, "data": {"items": [{"sequence": "007", "time_s": 1.5, "pos_x": 1, "pos_y": 2, "pos_z": 3}, {"sequence": "007", "time_s": "bad", "pos_x": 1, "pos_y": 2, "pos_z": 3}]}}
    (tmp_path / "t.json").write_text(json.dumps(nested))
    assert [tuple(r) for r in X.read_truth_table(spark, str(tmp_path / "t.json")).select("sequence_id", "time_s", "x_m").collect()] == [("007", 1.5, 1.0)]
    assert X.records_of({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 4}] and X.records_of([]) == []
    np.save(tmp_path / "c.npy", np.array([[0.0, 1, 2, 3], [1.0, 4, 5, 6]]))
    assert X.read_candidate_table(spark, str(tmp_path / "c.npy")).count() == 2
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("r.csv", 'Sequence,Timestamp,Position,Classification\ns,0.5,"(1, 2, -3.5)",2\n')
    row = X.read_results(spark, str(tmp_path / "r.zip")).first()
    assert (row.sequence_id, row.time_s, row.z_m, row.label) == ("s", 0.5, -3.5, 2)
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("a/seq1.txt", "1,1,0,0,5,5,0.9,1,1\n2,1,0,0,5,5,0.9,1,1\n")
    assert [(r.sequence_id, r.frame_id) for r in X.read_prediction_archive(spark, str(tmp_path / "p.zip")).orderBy("frame_id").collect()] == [("seq1", 1), ("seq1", 2)]
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("../x.txt", "1")
    with pytest.raises(Exception, match="unsafe"):
        X.members(spark, str(tmp_path / "u.zip")).collect()
    (tmp_path / "root" / "s1").mkdir(parents=True)
    for name in ("candidates.csv", "gt_truth.csv", "0001.pcd"):
        (tmp_path / "root" / "s1" / name).write_text("x")
    (tmp_path / "root" / "s2.csv").write_text("x")
    got = {r.sequence_id: r for r in X.sequence_manifest(X.discover_sequences(spark, str(tmp_path / "root"))).collect()}
    assert got["s1"].complete and len(got["s1"].points) == 1 and not got["s2"].complete


@pytest.mark.parametrize("row", ["1,1,inf,0,5,5,0.9,1,1", "1,1,0,0,NaN,5,0.9,1,1", "1,1,0,0,5,5,-Infinity,1,1", "0,1,0,0,5,5,0.9,1,1"])
def test_bad_detections_fail(spark, tmp_path, row):
    from tracklume.sources import readers

    (tmp_path / "s.txt").write_text(row.replace("inf,", "Infinity,") + "\n")
    with pytest.raises(Exception):
        readers.read_detections(spark, str(tmp_path / "s.txt")).collect()


def test_root_and_variants(spark, tmp_path):
    top = tmp_path / "archive" / "v1" / "RF Sensor and Radar"
    for name in ("Opt1/a.csv", "Opt1/a_rerun.csv", "Opt1/b_rerun.csv", "Opt1/radar_data.json", "Opt2/vehicleOut.txt", "Opt3/readme.md"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("x")
    root = R.find_root(spark, str(tmp_path))
    assert root.endswith("/archive/v1/RF Sensor and Radar") and R.find_root(spark, root) == root
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        (tmp_path / "empty" / "x.csv").write_text("x")
        R.find_root(spark, str(tmp_path / "empty"))
    tail = lambda p: p and p.rsplit("/", 1)[-1]
    of = lambda v: {r.flight: (tail(r.rf), r.rf_variant, tail(r.radar), tail(r.truth)) for r in R.discover_flights(spark, root, v).collect()}
    assert of("auto") == {"Opt1": ("a_rerun.csv", "rerun", "radar_data.json", None), "Opt2": (None, None, None, "vehicleOut.txt")}
    assert of("original")["Opt1"] == ("a.csv", "original", "radar_data.json", None) and of("rerun")["Opt1"] == ("a_rerun.csv", "rerun", None, None)
    with pytest.raises(ValueError):
        of("newest")


def test_split_manifests(spark, tmp_path):
    forms = {
        "a.json": '{"Train": ["s1", 2, null, "nan"], "val": [{"Name": "s3"}]}',
        "b.json": '{"version": 3, "splits": {"train": {"sequences": [{"sequence_id": "s1"}, {"id": "2"}]}, "val": {"s3": {"frames": 4}}}}',
        "c.json": '{"sequences": [{"scene": "s1", "Subset": "train"}, {"scene": "2", "subset": "train"}, {"scene": "s3", "subset": "val"}, {"scene": "s4"}]}',
        "d.yaml": "splits:\n  train: [s1, 2]\n  val:\n    - seq: s3\n",
        "e.csv": "id,partition\ns1,train\n2, Train \ns3,val\n",
    }
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        assert sorted(map(tuple, R.read_split_manifest(spark, str(tmp_path / name)).collect())) == [("2", "train"), ("s1", "train"), ("s3", "val")], name
    for text in ("[]", '{"train": []}', "3"):
        (tmp_path / "none.json").write_text(text)
        with pytest.raises(ValueError):
            R.read_split_manifest(spark, str(tmp_path / "none.json"))
