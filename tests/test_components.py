"""Components and the clusters that rest on them against brute force."""

import random
from itertools import combinations

from tracklume.operators import components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(3)
    chain = [(k, k + 1) for k in range(1000, 1120)]  # a long path
    star = [(2000, 2000 + k) for k in range(1, 200)]
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(140)] + chain + star + [(5, 5), (7, 8), (8, 7)]
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    some = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots(some, links)
    assert components.components(df.limit(0)).count() == 0


def test_voxel_clusters(spark):
    rnd = random.Random(4)
    rows = [("s", k, *(rnd.uniform(-9, 9) for _ in range(3))) for k in range(120)] + [("t", 500 + k, 1.0, 1.0, 1.0) for k in range(4)] + [(None, 900, 1.0, 1.0, 1.0), (None, 901, 1.5, 1.0, 2.5), ("s", 902, float("nan"), 0.0, 0.0), ("s", 903, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "sequence_id string, key long, x_m double, y_m double, z_m double")
    got = {r.key: r for r in components.voxel_clusters(df, ["sequence_id"], 2.0, 2).collect()}
    fine = [r for r in rows if r[1] < 902]
    cell = {r[1]: (r[0], *(int(x // 2.0) for x in r[2:])) for r in fine}
    near = lambda a, b: a[0] == b[0] and all(abs(x - y) <= 1 for x, y in zip(a[1:], b[1:]))
    root = roots(cell, [(a, b) for a, b in combinations(cell, 2) if near(cell[a], cell[b])])
    size = {k: sum(v == root[k] for v in root.values()) for k in root}
    assert len(got) == len(rows) and got[902].cluster is None and got[903].cluster is None
    for k in cell:
        assert (got[k].cluster, got[k].cluster_points) == ((root[k], size[k]) if size[k] >= 2 else (None, None))


def test_cross_sensor_clusters(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("pq"), round(rnd.uniform(0, 6), 1), rnd.choice("ABC"), k, *(round(rnd.uniform(0, 5), 1) for _ in range(3)), rnd.choice([None, 0.0, 1.0, 2.5])) for k in range(60)]
    df = spark.createDataFrame(rows, "sequence_id string, time_s double, source string, key long, x_m double, y_m double, z_m double, score double")
    got = {(r.sequence_id, r.anchor_s, r.n, round(r.x_m, 6), round(r.confidence, 6)) for r in components.cross_sensor_clusters(df, 0.4, 2.0).collect()}
    want, seen = set(), set()
    for s, t in sorted({(r[0], r[1]) for r in rows}):
        near = {r[3]: r for r in rows if r[0] == s and abs(r[1] - t) <= 0.4}
        root = roots(near, [(a, b) for a, b in combinations(near, 2) if sum((x - y) ** 2 for x, y in zip(near[a][4:7], near[b][4:7])) <= 4.0])
        for top in set(root.values()):
            own = [near[k] for k in root if root[k] == top]
            name = tuple(sorted(r[3] for r in own))
            if len({r[2] for r in own}) > 1 and name not in seen:
                seen.add(name)
                w = [max(1.0 if r[7] is None else r[7], 1e-6) for r in own]
                want.add((s, t, len(own), round(sum(a * r[4] for a, r in zip(w, own)) / sum(w), 6), round(sum(w), 6)))
    assert got == want


def test_voxels_in_tasks_and_by_joins_are_the_same(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["s", "t", None]), f"k{k}", *(rnd.choice([None, float("nan"), *(rnd.uniform(-12, 12) for _ in range(30))]) for _ in range(3))) for k in range(300)]
    df = spark.createDataFrame(rows, "sequence_id string, key string, x_m double, y_m double, z_m double")
    got = [sorted((str(tuple(r)) for r in components.voxel_clusters(df, ["sequence_id"], 2.0, 3, few=few).collect())) for few in (0, 90, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 300 and sum("None)" not in r for r in got[0]) > 30


def test_sensors_in_tasks_and_by_joins_are_the_same(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["p", "q", "q", None]), round(rnd.uniform(-9, 30), 1), rnd.choice(["A", "B", None]), k, *(round(rnd.uniform(0, 6), 1) for _ in range(3)), rnd.choice([None, 0.0, 1.0, 2.5])) for k in range(240)]
    df = spark.createDataFrame([*rows, ("p", None, "A", 900, 1.0, 1.0, 1.0, 1.0), ("p", float("nan"), "B", 901, 1.0, 1.0, 1.0, 1.0)], "sequence_id string, time_s double, source string, key long, x_m double, y_m double, z_m double, score double")
    fixed = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    for window in (0.0, 0.1, 0.7):
        got = [sorted((fixed(r) for r in components.cross_sensor_clusters(df, window, 1.6, few=few).collect()), key=str) for few in (0, 60, 1000)]
        assert got[0] == got[1] == got[2] and (len(got[0]) > 3 or window < 0.7)


def test_small_frames_take_one_shuffle_of_their_rows(spark):
    df = spark.range(200).selectExpr("CAST(id % 40 AS string) AS sequence_id", "CAST(id % 3 AS double) AS time_s", "CAST(id % 2 AS string) AS source", "id AS key", "CAST(id % 7 AS double) AS x_m", "1.0D AS y_m", "2.0D AS z_m", "1.0D AS score")
    for out in (components.voxel_clusters(df, ["sequence_id", "time_s"], 1.0, 2), components.cross_sensor_clusters(df, 1.0, 2.0)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Generate explode(array" not in plan and "Join" not in plan
