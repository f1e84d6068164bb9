"""Operators that replace a gathering or a loop by rounds over relations, each against plain code."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.operators import cloud, mesh, neighbours, orientation, planes
from stratagrid.operators.quantiles import quantile

POINT = "point_id long, x double, y double, z double"


def plain_quantile(values, share):
    s, place = sorted(values), share * (len(values) - 1)
    a, b, part = s[int(np.floor(place))], s[int(np.ceil(place))], place - np.floor(place)
    return a if a == b else a * (1 - part) + b * part


@pytest.mark.parametrize("few", [8, 20_000])
def test_quantiles(spark, few):
    rng = np.random.default_rng(0)
    groups = {"normal": rng.normal(size=2000).tolist(), "one value": [7.0] * 1500, "ties": rng.integers(0, 4, 1000).astype(float).tolist(), "narrowing": (2.0 ** -np.arange(40.0)).tolist(), "single": [3.0], "ends": [float("inf"), -float("inf")] * 3 + [1.0, 2.0, 1.7e308, -1.7e308]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("nothing", None), ("normal", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("low", F.lit("clash"))
    for share in (0.0, 0.013, 0.5, 1.0):
        got = {r.g: r["quantile"] for r in quantile(df, "v", share, ("g",), bins=16, few=few).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            assert got[g] == plain_quantile(vs, share) or np.isnan(got[g]) and np.isnan(plain_quantile(vs, share))
    assert quantile(df.where("g = 'normal'"), "v", 0.5, few=few).first()[0] == plain_quantile(groups["normal"], 0.5)
    assert quantile(df.where("g = 'nothing'"), "v", 0.5).first()[0] is None


def test_adaptive_slices_of_many_scans(spark):
    rows = [("thick", 1.0 + k / 1000, float(k)) for k in range(-90, 91)] + [("thin", k / 10, float(k)) for k in range(40)] + [("none", None, 0.0)]
    df = spark.createDataFrame(rows, "scan_id string, z double, x double")
    got = {(r.scan_id, r.x) for r in cloud.adaptive_slice(df, 1.0, 0.1, 100, 0.25, by=("scan_id",)).collect()}
    assert got == {("thick", x) for _, z, x in rows[:181]} | {("thin", x) for s, z, x in rows if s == "thin" and 1.7 < z < 2.2}
    one = {r.x for r in cloud.adaptive_slice(df.where("scan_id = 'thin'"), 1.0, 0.1, 100, 0.25).collect()}
    assert one == {x for s, x in got if s == "thin"}


def test_density_trim_with_ties(spark):
    v = spark.createDataFrame([(k, 0.0, 0.0, 0.0, float(k % 5 == 0)) for k in range(100)], "vertex_id long, x double, y double, z double, density double")
    t = spark.createDataFrame([(0, 1, 2, 3), (1, 4, 5, 6)], "face_id long, v0 long, v1 long, v2 long")
    kept, left = mesh.trim(v, t, share=0.85)
    assert {r.vertex_id for r in kept.collect()} == set(range(0, 100, 5)) and left.count() == 0
    assert mesh.trim(v, t, share=0.5)[0].count() == 100


def plain_nearest(points, others, k, widest=None):
    out = []
    for i, p in points:
        near = sorted(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2, j) for j, q in others if j != i)
        out += [(i, j, rank + 1) for rank, (d, j) in enumerate([n for n in near if widest is None or n[0] <= widest * widest][:k])]
    return sorted(out)


def placed(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in points] + [(-1, None, 0.0, 0.0), (-2, float("nan"), 0.0, 0.0)], POINT)


def clouds():
    rng = np.random.default_rng(1)
    return {
        "even": rng.random((300, 3)), "ties": [(i % 5, i // 5 % 5, 0) for i in range(150)], "one place": [(1, 2, 3)] * 30, "two points": [(0, 0, 0), (1, 1, 1)],
        "a third in one cell": np.concatenate([rng.random((100, 3)) * 50, 7 + 1e-7 * rng.random((100, 3)), [(7, 7, 7)] * 20, [(5000, 5000, 5000)]]),
    }


@pytest.mark.parametrize("name", clouds())
def test_nearest(spark, name):
    points = list(enumerate(clouds()[name]))
    df = placed(spark, points)
    for k in (1, 6) if name.startswith("a") else (5,):
        assert sorted((r.point, r.other, r.rank) for r in neighbours.nearest(df, df, k).collect()) == plain_nearest(points, points, k)
    away = [(1000 + i, p) for i, p in enumerate(np.random.default_rng(2).random((20, 3)) * 300 - 100)]
    assert sorted((r.point, r.other, r.rank) for r in neighbours.nearest(placed(spark, away), df, 3).collect()) == plain_nearest(away, points, 3)
    assert sorted((r.point, r.other, r.rank) for r in neighbours.nearest(df, df, 4, widest=0.2).collect()) == plain_nearest(points, points, 4, 0.2)
    assert neighbours.nearest(df, df.limit(0), 3).collect() == [] and neighbours.nearest(df.limit(0), df, 3).collect() == []


def test_dense_cell_stays_divided(spark):
    """Pairs that are compared grow with the points, not with the square of those in one dense cell."""
    rng = np.random.default_rng(3)
    n = 3000
    points = np.concatenate([rng.random((2 * n // 3, 3)) * 100, 50 + 1e-4 * rng.random((n // 3, 3))])
    t = neighbours.tree(placed(spark, list(enumerate(points))), 4)
    sizes = [r["count"] for r in t.leaves.groupBy("level", "cx", "cy", "cz").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 5 and t.depth > 12
    bounds = t.cells.where("level = at.level and not leaf").select(F.size("parts").alias("s")).agg(F.max("s"), F.min("s")).first()
    assert bounds[0] <= 8 and bounds[1] >= 2


def plain_signs(n, edges):
    """Kruskal's forest, then signs from each tree's first point."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = {i: [] for i in range(n)}
    for w, a, b, s in sorted((w, a, b, s) for a, b, w, s in edges):
        if root(a) != root(b):
            up[root(a)] = root(b)
            links[a].append((b, s))
            links[b].append((a, s))
    sign, tree = {}, {}
    for first in range(n):
        todo = [] if first in sign else [(first, 1)]
        while todo:
            i, s = todo.pop()
            sign[i], tree[i] = s, first
            todo += [(j, s * t) for j, t in links[i] if j not in sign]
    return tree, sign


def test_orientation_along_the_forest(spark):
    rng = np.random.default_rng(4)
    n = 240
    place = np.concatenate([rng.random((n // 2, 3)), 10 + rng.random((n // 2, 3))])
    normal = rng.normal(size=(n, 3))
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    normal[5] = normal[6]
    df = spark.createDataFrame([(i, *map(float, p), *map(float, v)) for i, (p, v) in enumerate(zip(place, normal, strict=True))] + [(n, 0.0, 0.0, 0.0, None, None, None), (n + 1, 99.0, 99.0, 99.0, 0.0, 0.0, -1.0)], POINT + ", nx double, ny double, nz double")
    pairs = neighbours.nearest(df.where(f"point_id < {n}"), df.where(f"point_id < {n}"), 5).cache()
    edges = [tuple(r) for r in orientation.weighted(df, pairs).collect()]
    tree, sign = plain_signs(n, edges)
    assert len(set(tree.values())) == 2
    found = {r.point_id: (r.tree, r.sign) for r in orientation.spanning_signs(df.where(f"point_id < {n}"), orientation.weighted(df, pairs)).collect()}
    for a, b in itertools.combinations(range(n), 2):
        if tree[a] == tree[b]:
            assert found[a][0] == found[b][0] and found[a][1] * found[b][1] == sign[a] * sign[b]
        else:
            assert found[a][0] != found[b][0]
    turned = {r.point_id: (r.nx, r.ny, r.nz) for r in orientation.orient(df, pairs).collect()}
    for t in set(tree.values()):
        own = [i for i in range(n) if tree[i] == t]
        top = max(own, key=lambda i: (place[i][2], -i))
        up = -1 if normal[top][2] < 0 else 1
        for i in own:
            assert np.array_equal(turned[i], normal[i] * sign[i] * sign[top] * up)
    assert turned[n] == (None, None, None) and turned[n + 1] == (0.0, 0.0, 1.0)


def test_orientation_of_a_sphere(spark):
    """All normals of a closed surface come out outward, whatever their first signs."""
    rng = np.random.default_rng(5)
    out = rng.normal(size=(500, 3))
    out /= np.linalg.norm(out, axis=1)[:, None]
    flipped = out * rng.choice([-1, 1], 500)[:, None]
    df = spark.createDataFrame([(i, *map(float, p), *map(float, v)) for i, (p, v) in enumerate(zip(out, flipped, strict=True))], POINT + ", nx double, ny double, nz double")
    got = orientation.orient(df, neighbours.nearest(df, df, 8)).collect()
    assert all(r.nx * r.x + r.ny * r.y + r.nz * r.z > 0 for r in got)


def test_planes_of_scans(spark):
    """Two scans of different planes, one of which is too small, and one scan with a point at no place."""
    rng = np.random.default_rng(6)
    flat = lambda n, z: [(*p, z) for p in rng.random((n, 2)) * 10]
    scans = {"a": flat(900, 0.0) + flat(700, 2.5), "b": [(1.0, y, z) for y, z in rng.random((600, 2)) * 5] + [(x + 2, y, z) for x, y, z in flat(80, 9.0)], "c": flat(50, 1.0)}
    rows = [(s, 1000 * k + i, *map(float, p)) for k, (s, ps) in enumerate(scans.items()) for i, p in enumerate(ps)] + [("a", -1, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "scan_id string, " + POINT)
    found, members = planes.detect_scans(df, candidates=200)
    got = {(r.scan_id, r.plane_id): r for r in found.collect()}
    assert {k: (r.num_points, r.type) for k, r in got.items()} == {("a", 0): (900, "floor/ceiling"), ("a", 1): (700, "floor/ceiling"), ("b", 0): (600, "wall")}
    assert abs(got["a", 1].c - 1) < 1e-12 and abs(got["a", 1].d + 2.5) < 1e-12
    assert {(r.scan_id, r.plane_id): r["count"] for r in members.groupBy("scan_id", "plane_id").count().collect()} == {k: r.num_points for k, r in got.items()}
    one, own = planes.detect(df.where("scan_id = 'b'"), candidates=200)
    assert [(r.num_points, r.type) for r in one.collect()] == [(600, "wall")] and own.count() == 600
    none, held = planes.detect_scans(df.where("scan_id = 'c'"))
    assert none.collect() == [] and held.collect() == [] and none.columns == found.columns


def test_large_scan_is_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(planes, "CHUNK", 100)
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([("s", i, *map(float, p), 1.0) for i, p in enumerate(rng.random((950, 2)))], "scan_id string, " + POINT)
    assert [r.num_points for r in planes.detect_scans(df, candidates=50)[0].collect()] == [950]


def plain_registration(moving, target, normals, distance, rounds):
    pose = np.eye(4)
    for _ in range(rounds):
        now = moving @ pose[:3, :3].T + pose[:3, 3]
        d = ((now[:, None] - target[None]) ** 2).sum(axis=2)
        near, ok = d.argmin(axis=1), d.min(axis=1) <= distance**2
        if not ok.any():
            break
        p, n = now[ok], normals[near[ok]]
        rows, gap = np.hstack([np.cross(p, n), n]), ((target[near[ok]] - p) * n).sum(axis=1)
        w = np.linalg.lstsq(rows.T @ rows, rows.T @ gap, rcond=1e-9)[0]
        step = np.eye(4)
        step[:3, :3], step[:3, 3] = planes.rotation(w[:3]), w[3:]
        pose = step @ pose
        if np.abs(w).max() < 1e-7:
            break
    return pose


def test_registration_of_pairs(spark):
    """Pairs that settle at different rounds, one that matches nothing and one without a target."""
    rng = np.random.default_rng(8)
    target = rng.random((120, 3))
    normals = rng.normal(size=(120, 3))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    moves = {"still": np.eye(4), "shift": np.eye(4), "turn": np.eye(4), "far": np.eye(4)}
    moves["shift"][:3, 3] = (0.004, -0.003, 0.002)
    moves["turn"][:3, :3], moves["turn"][:3, 3] = planes.rotation(np.array([0.0, 0.0, 0.01])), (0.002, 0.001, 0.0)
    moves["far"][:3, 3] = 100
    moving = {k: target @ m[:3, :3].T + m[:3, 3] for k, m in moves.items()} | {"alone": target}
    left = spark.createDataFrame([(k, i, *map(float, p)) for k, ps in moving.items() for i, p in enumerate(ps)], "pair_id string, " + POINT)
    right = spark.createDataFrame([(k, 1000 + i, *map(float, p), *map(float, n)) for k in moves for i, (p, n) in enumerate(zip(target, normals, strict=True))], f"pair_id string, {POINT}, nx double, ny double, nz double")
    got = {r.pair_id: r for r in planes.register_pairs(left, right, 0.05, rounds=6).collect()}
    assert got.keys() == moving.keys()
    for k, ps in moving.items():
        want = np.eye(4) if k == "alone" else plain_registration(ps, target, normals, 0.05, 6)
        pose = np.asarray([[got[k][f"r{i}{j}"] for j in range(3)] + [got[k][("tx", "ty", "tz")[i]]] for i in range(3)])
        assert np.allclose(pose, want[:3], atol=1e-9), k
        if k in ("shift", "turn"):
            assert np.allclose(pose @ np.vstack([np.linalg.inv(np.vstack([pose, [0, 0, 0, 1]]))]), np.eye(4)[:3], atol=1e-9) and np.allclose((ps @ pose[:, :3].T + pose[:, 3]), target, atol=1e-4)
    assert planes.register_pairs(left.limit(0), right, 0.05).collect() == []


def test_query_registration_pair_by_pair(spark):
    from stratagrid.plans import queries

    d = "/root/testdata/sf0.01"
    got = {r.pair_id: r for r in queries.QUERIES["p3_registration"](spark, d).collect()}
    moving, target = queries._shifted(spark, d)
    assert len(got) == 5
    for k in (0, 4):
        m = np.asarray([(r.x, r.y, r.z) for r in moving.where(f"pair_id = {k}").orderBy("point_id").collect()])
        rows = target.where(f"pair_id = {k}").orderBy("point_id").collect()
        pose = np.eye(4)
        t, n = (np.asarray([[r[c] for c in cs] for r in rows]) for cs in (("x", "y", "z"), ("nx", "ny", "nz")))
        for _ in range(10):
            now = m @ pose[:3, :3].T + pose[:3, 3]
            d2 = ((now[:, None] - t[None]) ** 2).sum(axis=2)
            near, ok = d2.argmin(axis=1), d2.min(axis=1) <= 0.05**2
            rows_, gap = np.hstack([np.cross(now[ok], n[near[ok]]), n[near[ok]]]), ((t[near[ok]] - now[ok]) * n[near[ok]]).sum(axis=1)
            w = np.linalg.lstsq(rows_.T @ rows_, rows_.T @ gap, rcond=1e-9)[0]
            step = np.eye(4)
            step[:3, :3], step[:3, 3] = planes.rotation(w[:3]), w[3:]
            pose = step @ pose
            if np.abs(w).max() < 1e-7:
                break
        found = np.asarray([[got[k][f"r{i}{j}"] for j in range(3)] + [got[k][("tx", "ty", "tz")[i]]] for i in range(3)])
        assert np.allclose(found, pose[:3], atol=1e-7)


def test_match_looks_near_first(spark, monkeypatch):
    """A dense heap with copies, points at its edge and far ones, in two groups: the nearest of all, and few pairs met."""
    rng = np.random.default_rng(3)
    heap = [tuple(map(float, p)) for p in rng.random((600, 3)).round(3) * 0.5]
    heap = heap + heap[:100] + [(0.9, 0.25, 0.25), (5.0, 5.0, 5.0), (5.4, 5.0, 5.0)]
    rows = [(k, i, x + k, y, z) for k in (0, 1) for i, (x, y, z) in enumerate(heap)]
    points, radii, plain = spark.createDataFrame(rows, "k int, " + POINT), [], neighbours.within

    def seen(left, others, radius, *args, **kw):
        radii.append((radius, left.count()))
        return plain(left, others, radius, *args, **kw)

    monkeypatch.setattr(neighbours, "within", seen)
    place = np.asarray(heap)
    d2 = ((place[:, None] - place[None]) ** 2).sum(axis=2)
    for apart in (True, False):
        radii.clear()
        got = {(r.k, r.point): r.other for r in neighbours.match(points, points, 0.5, by=("k",), apart=apart).collect()}
        d = d2 + np.diag([np.inf] * len(heap)) if apart else d2
        near = {i: set(np.flatnonzero(d[i] <= d[i].min() + 1e-12)) for i in range(len(heap)) if d[i].min() <= 0.25}
        assert got.keys() == {(k, i) for k in (0, 1) for i in near}
        assert all(got[k, i] in near[i] for k, i in got) and all(got[k, i] == min(near[i]) for k, i in got if d[i].min() == 0)
        assert radii[0][0] < 0.2 and radii[-1][0] == 0.5 and radii[-1][1] < 10


def test_mesh_joins_are_merged(spark):
    """Vertices and faces grow together: tables of a mesh that look small are not sent to the driver and every executor."""
    from stratagrid.plans import queries

    d = "/root/testdata/sf0.01"
    for name in ("a10_m19_o2_edge_angles", "g7_feature_edges", "m18_j7_face_normals", "g5_vertex_normals"):
        plan = queries.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name


def test_one_search_serves_normals_and_forest(spark, monkeypatch):
    """The query looks for neighbours once; normals from a wider search are those of their own."""
    from stratagrid.plans import inputs, queries

    searched, nearest = [], neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda *a, **b: searched.append(1) or nearest(*a, **b))
    d = "/root/testdata/sf0.001"
    assert queries.QUERIES["p5_spanning_orientation"](spark, d).count() and len(searched) == 1
    p = inputs.identified(spark, d)
    near = nearest(p, p, 35).cache()
    own, shared = (sorted(tuple(r) for r in cloud.normals(p, radius=0.2, most=12, **given).collect()) for given in ({}, {"near": near}))
    assert [r[0] for r in own] == [r[0] for r in shared] and np.allclose(own, shared, rtol=0, atol=1e-9)


def test_members_are_counted_by_boxes():
    """Boxes give the counts of single tests, with limits hit exactly, points at one place and far ones; most aren't tested singly."""
    rng = np.random.default_rng(8)
    x, y = rng.random((2, 6000)) * 8
    z = np.where(np.arange(6000) % 7 == 0, rng.random(6000) * 3, np.arange(6000) % 5 / 4.0)
    x[:900], y[:900], z[:900] = 1.0, 2.0, 0.25
    x[-1], y[-2] = np.inf, 1e12
    normal = rng.normal(size=(200, 3))
    normal[:60] = (0.0, 0.0, 1.0)
    a, b, c = (normal / np.linalg.norm(normal, axis=1)[:, None]).T
    d = -rng.random(200) * 4
    d[:60] = -(np.arange(60) - 10) / 20.0
    with np.errstate(invalid="ignore"):
        want = (np.abs(a * x[:, None] + b * y[:, None] + c * z[:, None] + d) < 0.05).sum(axis=0)
        assert np.array_equal(planes.count_within(x, y, z, [a, b, c, d], 0.05), want)


@pytest.mark.parametrize("repeated", [False, True])
def test_candidates_are_drawn_below_a_digest(spark, monkeypatch, repeated):
    """Few of many points are ranked, and the same are drawn; where one id is repeated all are ranked."""
    import hashlib

    rows, write = [], planes.durable
    monkeypatch.setattr(planes, "durable", lambda df, name: rows.append(write(df, name)) or rows[-1])
    place = [(i // 2000 if repeated else i, float(i % 13), float(i % 17), float(i * i % 29)) for i in range(4000)]
    points = spark.createDataFrame([("s", *p) for p in place], "scan_id string, " + POINT)
    sizes = points.groupBy("scan_id").count().withColumnRenamed("count", "n")
    got = planes.candidate_planes(points, sizes, 20, 1, 42, "point_id", "scan_id").count()
    assert got > 0
    if not repeated:
        assert 60 <= rows[0].count() < 500
        first = {p[0] for p in sorted(place, key=lambda p: hashlib.md5(f"s:{p[0]}:42:1".encode()).hexdigest())[:60]}
        assert first <= {r.point_id for r in rows[0].collect()}
