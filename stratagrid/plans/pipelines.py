"""The scan pipelines, composed of the operators: fusion, floor plan, planning, wireframe, demonstration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FLOOR, GRID, MESH, SCAN, FloorConfig, GridConfig, ScanConfig
from ..functions import geometry as g
from ..iterate import durable
from ..operators import cloud, frames, mesh, planes, planning, raster


def align(points: DataFrame, config: ScanConfig = SCAN, rounds: int = 5) -> DataFrame:
    """points(frame_id, x, y, z) with each frame registered to the cloud of the frames before it.

    Frames are few and come in order, each depending on all before, so this is a loop on the driver; its
    target is a running thinned cloud, not the whole growing one."""
    order = [r["frame_id"] for r in points.select("frame_id").distinct().orderBy("frame_id").collect()]
    done = running = None
    for frame in order:
        own = points.where(F.col("frame_id") == frame)
        if running is not None:
            thin = cloud.voxels(own, config.voxel).withColumn("point_id", F.xxhash64("vx", "vy", "vz")).select("point_id", "x", "y", "z")
            target = durable(cloud.normals(running, config.normal_radius), "target")
            pose = planes.register(durable(thin, "frame"), target, config.icp_distance, rounds)
            m = {f"r{i}{j}": g.real(pose[i, j]) for i in range(3) for j in range(3)} | {t: g.real(pose[i, 3]) for i, t in enumerate(("tx", "ty", "tz"))}
            own = own.withColumns(m)
            own = own.withColumns(g.transform("x", "y", "z")).drop(*g.POSE)
        own = durable(own, "aligned")
        done = own if done is None else done.unionByName(own)
        running = durable(cloud.voxels(done, config.voxel).withColumn("point_id", F.xxhash64("vx", "vy", "vz")).select("point_id", "x", "y", "z"), "running")
    return points if done is None else done


def fuse(pixels: DataFrame, poses: DataFrame, config: ScanConfig = SCAN, all_frames: bool = False, ghosts: bool = True, register: bool = False) -> DataFrame:
    """One cloud from the valid pixels of a scan's keyframes: back-projected, moved, thinned, de-noised.

    Poses are one row for each frame. register aligns each frame to those before it. all_frames and
    ghosts=False give the wireframe's variant."""
    used = poses if all_frames else poses.join(frames.keyframes(poses).select("scan_id", "frame_id"), ["scan_id", "frame_id"], "left_semi")
    valid = frames.valid_pixels(pixels, most=config.depth_truncation, least_conf=config.confidence)
    points = frames.world_points(valid, used, ["scan_id", "frame_id"])
    if register:
        points = align(durable(points, "points"), config)
    thin = durable(cloud.voxels(points, config.voxel).withColumn("point_id", F.xxhash64("vx", "vy", "vz")).select("point_id", "x", "y", "z"), "fused")
    kept = cloud.statistical_inliers(thin, config.outlier_neighbours, config.outlier_ratio)
    if ghosts:
        kept = cloud.without_ghosts(durable(kept, "inliers"), config.voxel).select("point_id", "x", "y", "z")
    return kept


@dataclass(frozen=True)
class FloorPlan:
    meta: DataFrame
    pixels: DataFrame
    outline: DataFrame


def floor_plan(points: DataFrame, found: DataFrame, config: FloorConfig = FLOOR, signed: bool = False, by: list[str] | None = None) -> FloorPlan:
    """Wall pixels in a slice above the floor: drawn as dots, closed, and their outline.

    by: the columns that tell scans apart in points and planes; each has a plan of its own, all in one job."""
    heights = planes.floor_height(found, points, signed, by)
    if by:
        level = points.join(heights, by).withColumn("level", F.coalesce("floor_height", F.lit(0)) + g.real(config.height)).drop("floor_height")
        level = cloud.adaptive_slice(durable(level, "levels"), F.col("level"), config.half_height, config.least_points, config.fallback_half_height, tuple(by)).drop("level")
    else:
        height = heights.first()["floor_height"]
        level = cloud.adaptive_slice(points, (height or 0.0) + config.height, config.half_height, config.least_points, config.fallback_half_height)
    meta = durable(raster.blueprint_meta(level, config.padding, config.pixels_per_metre, by), "meta")
    pixels = durable(raster.close(raster.splat(level, meta, config.dot_radius, by), meta, config.close_size, by), "plan")
    return FloorPlan(meta, pixels, raster.boundary(pixels, by))


@dataclass(frozen=True)
class Planned:
    occupied: DataFrame
    info: DataFrame
    paths: DataFrame
    statistics: DataFrame


def grids(points: DataFrame, config: GridConfig = GRID) -> tuple[DataFrame, DataFrame]:
    """The occupancy grids of points, written: (inflated occupied cells, grid facts), for each scan where points have a scan_id."""
    by = ["scan_id"] if "scan_id" in points.columns else None
    occ, info = raster.occupancy(points, config.resolution, config.height, config.half_height, config.margin, by)
    return durable(occ, "occupied"), info


def plan_scan(points: DataFrame, endpoints: DataFrame, config: GridConfig = GRID, made: tuple[DataFrame, DataFrame] | None = None) -> Planned:
    """Occupancy grids and the paths between endpoints(scan_id, start_x, ..., goal_y).

    Where points have a scan_id each scan has a grid of its own, and all are planned side by side; without one
    they are one scan's, and all endpoints share its grid. made: grids(points, config) where they are written
    already (endpoints are often chosen on them); points are not read then."""
    many = "scan_id" in points.columns
    by = ["scan_id"] if many else None
    occ, info = made or grids(points, config)
    free = raster.free_cells(occ, info, by)
    if not many:
        free = free.join(endpoints.select("scan_id").distinct(), how="cross")  # each asked scan plans on the one grid
    free = durable(free, "free")
    at = raster.beside(endpoints, info, by)
    cell = lambda p, a: g.to_cell(f"{p}_{a}", f"{a}0", F.col("resolution"))
    asked = at.select("scan_id", cell("start", "x").alias("sx"), cell("start", "y").alias("sy"), cell("goal", "x").alias("tx"), cell("goal", "y").alias("ty"))
    paths = raster.beside(planning.plan_paths(free, asked), info, by, "resolution", "x0", "y0")
    paths = durable(paths.withColumns({a: g.from_cell(f"g{a}", f"{a}0", F.col("resolution")) for a in "xy"}).drop("resolution", "x0", "y0"), "paths")
    return Planned(occ, info, paths, planning.path_statistics(paths, config.resolution))


def wireframe(vertices: DataFrame, triangles: DataFrame, least_angle: float = MESH.edge_angle) -> tuple[DataFrame, DataFrame]:
    """Visible edges of a mesh after cleaning, trimming and smoothing, and the counts of the drawing."""
    vertices, triangles = (durable(t, "cleaned") for t in mesh.clean(vertices, triangles))
    if "density" in vertices.columns:
        vertices, triangles = (durable(t, "trimmed") for t in mesh.trim(vertices, triangles))
    vertices = mesh.smooth(vertices, triangles)
    lines = durable(mesh.feature_edges(vertices, triangles, least_angle), "lines")
    counts = lines.agg(F.count("*").alias("n_edges")).crossJoin(triangles.agg(F.count("*").alias("n_triangles"))).crossJoin(mesh.extents(vertices))
    return lines, counts


def demonstration(points: DataFrame, endpoints: DataFrame, config: GridConfig = GRID, seeds: int = 4, iterations: int = 3000, step: float = 0.3, made: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Cheapest paths and random trees side by side for each scan of points and endpoints: rows of statistics
    (scan_id, algorithm, success, work, path_length_m). made as in plan_scan()."""
    planned = plan_scan(points, endpoints, config, made)
    first = planned.statistics.select("scan_id", "algorithm", "success", F.col("nodes_explored").alias("work"), "path_length_m")
    by = ["scan_id"] if "scan_id" in points.columns else []
    free = raster.free_cells(planned.occupied, planned.info, by)
    free = free if by else free.crossJoin(F.broadcast(endpoints.select("scan_id").distinct()))
    asked = raster.beside(endpoints, planned.info, by).select("scan_id", "resolution", "x0", "y0", "nx", "ny", F.col("start_x").alias("x1"), F.col("start_y").alias("y1"), F.col("goal_x").alias("x2"), F.col("goal_y").alias("y2"))
    trees = durable(planning.random_trees(free, asked, seeds, iterations, step), "trees")
    own = trees.withColumn("both", F.concat_ws("/", "scan_id", F.col("seed").cast("string")))
    lengths = frames.path_length(own.where("success").drop("scan_id").withColumnRenamed("both", "scan_id")).select(F.col("scan_id").alias("both"), "path_length_m")
    second = own.groupBy("scan_id", "seed", "both").agg(F.first("success").alias("success"), F.max("iterations").alias("work")).join(lengths, "both", "left")
    return first.unionByName(second.select("scan_id", F.concat(F.lit("RRT "), F.col("seed").cast("string")).alias("algorithm"), "success", "work", "path_length_m"))
