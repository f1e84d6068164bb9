"""Fixtures with results worked out by hand, properties, and streams."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.functions import geometry as g
from stratagrid.operators import cloud, frames, mesh, neighbours, planes, planning, raster
from stratagrid.plans import pipelines
from stratagrid.sources import rooms, scan_files
from stratagrid.streaming import scans

IDENTITY = {f"r{i}{j}": float(i == j) for i in range(3) for j in range(3)}


def poses(spark, xs, turn=None):
    rows = []
    for i, x in enumerate(xs):
        a = math.radians(turn[i]) if turn else 0.0
        rows.append(("s", i, math.cos(a), -math.sin(a), 0.0, math.sin(a), math.cos(a), 0.0, 0.0, 0.0, 1.0, float(x), 0.0, 0.0))
    return spark.createDataFrame(rows, "scan_id string, frame_id int, " + ", ".join(f"{c} double" for c in g.POSE))


def ids(df, name="frame_id"):
    return sorted(r[name] for r in df.collect())


def test_keyframes(spark):
    assert ids(frames.keyframes(poses(spark, [0, 0.05, 0.09, 0.10, 0.20]))) == [0, 2, 4]
    assert ids(frames.keyframes(poses(spark, [0.0] * 4, [0, 3, 5, 8]))) == [0, 2]
    assert ids(frames.keyframes(poses(spark, [0.3]))) == [0]


def test_depth_filter(spark):
    nan = float("nan")
    rows = [(0.0, 1.0), (7.9, 0.6), (8.0, 1.0), (-1.0, 1.0), (2.0, 0.5), (2.0, None), (nan, 1.0), (2.0, nan)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "frame_id int, depth double, conf double")
    assert ids(frames.valid_pixels(df)) == [1, 5]
    assert ids(frames.valid_pixels(df, least_conf=0)) == [1, 4, 5, 7]


def test_back_projection_and_sampling(spark):
    df = spark.createDataFrame([(150, 50, 2.0, 100.0, 100.0, 50.0, 50.0), (1, 1, 1.0, 0.0, 1.0, 0.0, 0.0)], "u int, v int, d double, fx double, fy double, cx double, cy double")
    got = df.select(*(v.alias(k) for k, v in g.back_project("u", "v", "d", "fx", "fy", "cx", "cy").items())).collect()
    assert tuple(got[0]) == (2.0, 0.0, 2.0) and got[1]["x"] is None
    fps = spark.createDataFrame([(30.0,), (29.97,), (1.0,), (0.0,)], "fps double")
    assert [r[0] for r in fps.select(g.sampling_interval("fps", 2)).collect()] == [15, 14, 1, 1]
    angles = spark.createDataFrame([(float(a),) for a in (0, 15, 45, 75, 90)], "a double")
    assert [r[0] for r in angles.select(g.plane_class("a")).collect()] == ["floor/ceiling", "sloped", "sloped", "sloped", "wall"]


def test_pose_inverse_and_distances(spark):
    p = poses(spark, [0.4, 1.7], [33, 71])
    both = p.withColumns({f"i_{k}": v for k, v in g.invert_pose().items()}).withColumns({"x": F.lit(1.5), "y": F.lit(-2.0), "z": F.lit(0.25)})
    there = both.withColumns(g.transform("x", "y", "z"))
    back = there.withColumns(g.transform("x", "y", "z", tuple(f"i_{c}" for c in g.POSE)))
    for r in back.collect():
        assert np.allclose([r["x"], r["y"], r["z"]], [1.5, -2.0, 0.25])


def test_room(spark):
    room = rooms.room(spark)
    assert room.count() == 66_800 and cloud.closed_slice(room, 1.0, 0.3).count() == 12_120
    level = cloud.closed_slice(room, 1.0, 0.3)
    info = raster.grid_info(level, 0.1)
    cells = raster.occupied(level, info)
    total = lambda df: tuple(df.agg(F.count("*"), F.sum("gx"), F.sum("gy")).first())
    assert total(cells) == (708, 34_782, 25_117)
    wide = raster.inflate(cells, info, 2)
    assert total(wide) == (1_644, 81_678, 59_613) and cells.join(wide, ["gx", "gy"], "left_anti").isEmpty()
    assert raster.free_cells(wide, info).count() == 6_356


def test_room_path(spark):
    ends = spark.createDataFrame([("room", 1.0, 1.0, 9.0, 7.0)], "scan_id string, start_x double, start_y double, goal_x double, goal_y double")
    planned = pipelines.plan_scan(rooms.room(spark), ends)
    s = planned.statistics.first()
    assert s["success"] and math.isclose(s["path_cost_cells"], 60 * math.sqrt(2) + 20, rel_tol=1e-9) and s["path_length_grid"] == 81
    steps = [(r["gx"], r["gy"]) for r in planned.paths.orderBy("seq").collect()]
    taken = {(r["gx"], r["gy"]) for r in planned.occupied.collect()}
    assert steps[0] == (10, 10) and steps[-1] == (90, 70) and not taken & set(steps)
    assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(steps, steps[1:]))


def best_first(free: set[tuple[int, int]], start: tuple[int, int], goal: tuple[int, int]) -> tuple[list[tuple[int, int]], int, float]:
    """The cheapest 8-connected path, the cells settled (the goal too) and the cost; no path: ([], n, inf)."""
    best, came, settled, n = {start: 0.0}, {}, set(), 0
    heap = [(math.dist(start, goal), 0, start)]
    while heap:
        _, _, at = heapq.heappop(heap)
        if at in settled:
            continue
        settled.add(at)
        if at == goal:
            path = [at]
            while at in came:
                at = came[at]
                path.append(at)
            return path[::-1], len(settled), best[goal]
        for dx, dy, c in planning.STEPS:
            to = (at[0] + dx, at[1] + dy)
            if to in free and to not in settled and best[at] + c < best.get(to, math.inf) - 1e-12:
                best[to], came[to] = best[at] + c, at
                n += 1
                heapq.heappush(heap, (best[to] + math.dist(to, goal), n, to))
    return [], len(settled), math.inf


def test_walled_grid(spark):
    free = rooms.walled_grid(spark)
    cost = {(r["gx"], r["gy"]): r["cost"] for r in planning.cost_field(free, (0, 0)).collect()}
    assert len(cost) == 134 and math.isclose(cost[11, 0], 24.556349, abs_tol=1e-6) and math.isclose(max(cost.values()), 24.556349, abs_tol=1e-6)
    assert best_first(set(cost), (0, 0), (11, 0))[2] == pytest.approx(cost[11, 0])
    asked = spark.createDataFrame([("w", 1.0, 0.0, 0.0, 12, 12, 0.5, 0.5, 11.5, 0.5)], "scan_id string, resolution double, x0 double, y0 double, nx int, ny int, x1 double, y1 double, x2 double, y2 double")
    trees = planning.random_trees(free.withColumn("scan_id", F.lit("w")), asked, seeds=3).collect()
    for seed in range(3):
        way = [(r["x"], r["y"]) for r in sorted((r for r in trees if r["seed"] == seed), key=lambda r: r["seq"])]
        assert way[0] == (0.5, 0.5) and way[-1] == (11.5, 0.5)
        for p, q in zip(way, way[1:]):
            assert math.dist(p, q) <= 0.5 + 1e-9
            assert all((int(p[0] + t * (q[0] - p[0])), int(p[1] + t * (q[1] - p[1]))) in cost for t in (0, 0.5, 1))


def test_meshes(spark):
    v, t = rooms.cube(spark)
    assert mesh.edge_faces(v, t).count() == 18 and mesh.feature_edges(v, t).count() == 12
    square = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.5, 0.5, 1.0)], "vertex_id long, x double, y double, z double")
    flat = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3)], "face_id long, v0 long, v1 long, v2 long")
    assert {(r["lo"], r["hi"]) for r in mesh.feature_edges(square, flat).collect()} == {(0, 1), (1, 2), (2, 3), (0, 3)}
    fan = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 3), (2, 0, 1, 4)], "face_id long, v0 long, v1 long, v2 long")
    assert {(r["lo"], r["hi"]) for r in mesh.feature_edges(square, fan).collect()} == {(0, 2), (1, 2), (0, 3), (1, 3), (0, 4), (1, 4)}
    twice = square.unionByName(spark.createDataFrame([(9, 1.0, 0.0, 0.0)], square.schema))
    kept, faces = mesh.clean(twice, spark.createDataFrame([(0, 0, 1, 2), (1, 0, 9, 2), (2, 1, 9, 3)], flat.schema))
    assert ids(kept, "vertex_id") == [0, 1, 2] and ids(faces, "face_id") == [0]


def test_planes(spark):
    points = rooms.room(spark).withColumn("point_id", F.xxhash64("part", "x", "y", "z"))
    found, members = planes.detect(points, most=3)
    rows = {r["plane_id"]: r for r in found.collect()}
    assert rows[0]["num_points"] >= 30_000 and rows[0]["type"] == "floor/ceiling"
    assert {r["plane_id"]: r["count"] for r in members.groupBy("plane_id").count().collect()} == {k: r["num_points"] for k, r in rows.items()}


def test_registration(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 1, (300, 2))
    z = 0.3 * np.sin(4 * xy[:, 0]) + 0.2 * np.cos(5 * xy[:, 1])
    rows = [(i, *map(float, (*p, h))) for i, (p, h) in enumerate(zip(xy, z))]
    target = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    moving = target.withColumns({"x": F.col("x") + 0.01, "z": F.col("z") - 0.015})
    pose = planes.register(moving, cloud.normals(target, radius=0.2).cache(), 0.08, rounds=12)
    assert np.allclose(pose[:3, 3], [-0.01, 0, 0.015], atol=4e-3) and np.allclose(pose[:3, :3], np.eye(3), atol=0.02)
    assert np.allclose(planes.register(moving, cloud.normals(target, radius=0.2), 1e-9, rounds=1), np.eye(4))


def test_neighbours_with_salt_and_few_points(spark):
    rows = [(i, float(i % 5), float(i // 5), 0.0) for i in range(25)]
    p = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    plain, salted = (sorted(map(tuple, neighbours.within(p, p, 1.0, salts=s).collect())) for s in (1, 3))
    assert plain == salted and len(plain) == 80
    near = neighbours.nearest(p, p, 3).groupBy("point").count().collect()
    assert len(near) == 25 and all(r["count"] == 3 for r in near)
    assert neighbours.nearest(p.limit(2), p.limit(2), 3).count() == 2
    thin = cloud.voxels(p, 0.5)
    assert thin.count() == 25 and cloud.statistical_inliers(p, 4, 100.0).count() == 25


def test_raster(spark):
    meta = spark.createDataFrame([(12, 12)], "img_width int, img_height int")
    px = spark.createDataFrame([(2, 2), (3, 2), (5, 2), (9, 9)], "px int, py int")
    closed = raster.close(px, meta)
    assert px.join(closed, ["px", "py"], "left_anti").isEmpty() and not closed.where("px = 4 and py = 2").isEmpty()
    block = spark.range(25).select((F.col("id") % 5).cast("int").alias("px"), F.expr("id div 5").cast("int").alias("py"))
    assert raster.boundary(block).count() == 16
    both = block.union(spark.createDataFrame([(20, 20)], block.schema))
    assert raster.components(both).select("comp").distinct().count() == 2
    corners = {(r["x"], r["y"]) for r in raster.outlines(both).collect()}
    assert corners == {(0, 0), (5, 0), (5, 5), (0, 5), (20, 20), (21, 20), (21, 21), (20, 21)}


def test_percentile(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 10.0), (1, 0.0)], "frame_id int, depth double")
    got = {r["frame_id"]: r["scale"] for r in frames.depth_statistics(df).collect()}
    assert got == {0: pytest.approx(9.92), 1: 10.0}


def test_empty_inputs(spark):
    none = rooms.room(spark).limit(0)
    occ, info = raster.occupancy(none)
    assert occ.count() == 0 and info.count() == 0
    assert cloud.adaptive_slice(none).count() == 0 and cloud.voxels(none, 0.1).count() == 0
    assert raster.blueprint_meta(none).count() == 0


def test_npy_and_status(spark, tmp_path):
    np.save(tmp_path / "00001.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    got = sorted((r["v"], r["u"], r["value"]) for r in scan_files.read_npy(spark, str(tmp_path)).collect())
    assert got == [(v, u, float(3 * v + u)) for v in range(2) for u in range(3)]
    log = spark.createDataFrame([("a", 1, "pending", None, None), ("a", 2, "done", "ok", {"x": "y"})], scan_files.STATUS)
    assert tuple(scan_files.latest_status(log).first()) == ("a", "done", "ok", {"x": "y"})
    with pytest.raises(FileNotFoundError):
        scan_files.first_cloud(spark, [str(tmp_path / "none")])


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    moves = [0.0, 0.05, 0.09, 0.10, 0.20, 0.21]
    every = poses(spark, moves).select("scan_id", F.col("frame_id").cast("long").alias("frame_id"), *g.POSE)
    # the fifth frame is turned by more than the limit without moving far
    every = every.withColumns({"r00": F.when(F.col("frame_id") == 5, 0.8).otherwise(F.col("r00")), "r01": F.when(F.col("frame_id") == 5, -0.6).otherwise(F.col("r01")),
                               "r10": F.when(F.col("frame_id") == 5, 0.6).otherwise(F.col("r10")), "r11": F.when(F.col("frame_id") == 5, 0.8).otherwise(F.col("r11"))})
    every = spark.createDataFrame(every.collect(), every.schema)
    every.where("frame_id in (0, 2)").coalesce(1).write.parquet(source)
    out = str(tmp_path / "kept")

    def keep(patience=600_000):
        kept = scans.keyframes(spark.readStream.schema(every.schema).parquet(source), patience_ms=patience)
        with scans.settings(spark):
            kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["frame_id"] for r in spark.read.schema(every.schema).parquet(out).collect())

    assert keep() == [0]  # the third frame waits for the second
    every.where("frame_id in (1, 3, 3)").coalesce(1).write.mode("append").parquet(source)
    assert keep() == [0, 2]
    every.where("frame_id in (4, 1)").coalesce(1).write.mode("append").parquet(source)
    assert keep() == [0, 2, 4]  # the last kept position comes from the state, the repeated frame is late
    every.where("frame_id = 5").coalesce(1).write.mode("append").parquet(source)
    assert keep() == [0, 2, 4, 5] == sorted(r["frame_id"] for r in frames.keyframes(every).collect())
    points = spark.readStream.schema(every.schema).parquet(source).select(F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    q = scans.voxel_counts(points, 0.1).writeStream.outputMode("complete").format("memory").queryName("cells").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["n_points"] for r in spark.table("cells").collect()) == 7


def test_missing_frames_are_given_up(spark, tmp_path):
    """The timer lets the frames go that wait for one that never comes; then that one is late."""
    source, out = str(tmp_path / "in"), str(tmp_path / "kept")
    every = poses(spark, [0.0, 0.5, 1.0, 1.5]).select("scan_id", F.col("frame_id").cast("long").alias("frame_id"), *g.POSE)

    def keep(*ids):
        every.where(F.col("frame_id").isin(*ids)).coalesce(1).write.mode("append").parquet(source)
        kept = scans.keyframes(spark.readStream.schema(every.schema).parquet(source), patience_ms=1)
        with scans.settings(spark):
            kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["frame_id"] for r in spark.read.schema(every.schema).parquet(out).collect())

    keep(0, 2)
    keep(3)
    assert keep(1) == [0, 2, 3]


def test_no_rows_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    every = poses(spark, [0.0]).select("scan_id", "frame_id", *g.POSE)
    every.where("false").write.parquet(source)
    assert scans.appended(scans.keyframes(spark.readStream.schema(every.schema).parquet(source)), "kept").count() == 0


def test_keyframes_ask_the_state_seldom():
    """A scan costs few round trips to the state: four where frames begin to wait, six where the last gap closes."""
    from unittest.mock import MagicMock

    import pandas as pd

    from stratagrid.functions import geometry as g
    from stratagrid.streaming import scans

    def frames(*ids):
        return iter([pd.DataFrame([(i, *[1.0, 0, 0, 0, 1, 0, 0, 0, 1], float(i), 0, 0) for i in ids], columns=["frame_id", *g.POSE])])

    one, held, times = scans._Keyframes("scan_id", 0.08, 4.0, 1000, 10_000), {}, MagicMock()
    times.getCurrentProcessingTimeInMs.return_value = 5
    one.handle, one.last, one.waiting = MagicMock(), MagicMock(), MagicMock()
    one.last.get.side_effect = lambda: held.get("last")
    one.last.update.side_effect = lambda v: held.update(last=v)
    one.waiting.get.side_effect = lambda: iter(held["wait"])
    one.waiting.put.side_effect = lambda v: held.update(wait=v)
    calls = lambda: sum(len(m.method_calls) for m in (one.handle, one.last, one.waiting))
    assert [list(d["frame_id"]) for d in one.handleInputRows(("a",), frames(0, 2), times)] == [[0]] and calls() == 4
    assert [list(d["frame_id"]) for d in one.handleInputRows(("a",), frames(1), times)] == [[1, 2]] and calls() <= 10
    one.handle.deleteTimer.assert_called_once_with(1005)
