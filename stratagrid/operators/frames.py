"""Frames, depth pixels and poses: sampling, filters, back-projection, trajectories and keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SCAN
from ..functions import geometry as g


def sample_frames(frames: DataFrame, fps: str = "fps", index: str = "src_frame_idx", target: int = SCAN.sampling_fps) -> DataFrame:
    """Every interval-th frame, numbered anew from 0. No window: the new number is index / interval."""
    interval = g.sampling_interval(fps, target)
    return frames.withColumn("interval", interval).where(F.col(index) % F.col("interval") == 0).withColumn("frame_id", F.expr(f"{index} div interval").cast("int"))


def enough_frames(frames: DataFrame, scan: str = "scan_id", least: int = SCAN.least_frames) -> DataFrame:
    """Frames per scan and whether there are enough of them."""
    return frames.groupBy(scan).agg(F.count("*").alias("n_frames")).withColumn("enough", F.col("n_frames") >= least)


def batches(frames: DataFrame, frame: str = "frame_id", size: int = SCAN.batch) -> DataFrame:
    """Mini-batches of consecutive frames."""
    return frames.withColumn("batch_id", F.expr(f"{frame} div {size}").cast("int"))


def depth_pixels(maps: DataFrame, width: str = "width") -> DataFrame:
    """Packed depth maps (an array in row-major order) as a row for each pixel."""
    return maps.select("*", F.posexplode("depth").alias("pos", "d")).drop("depth").withColumns(
        {"u": (F.col("pos") % F.col(width)).cast("int"), "v": F.expr(f"pos div {width}").cast("int")}).withColumnRenamed("d", "depth").drop("pos")


def valid_pixels(pixels: DataFrame, depth: str = "depth", conf: str = "conf", most: float = SCAN.depth_truncation, least_conf: float = SCAN.confidence) -> DataFrame:
    return pixels.where(g.valid_depth(depth, conf, most, least_conf))


def with_colour(pixels: DataFrame, image: DataFrame, on: tuple[str, ...] = ("frame_id", "u", "v")) -> DataFrame:
    """Pixels with the colours (r, g, b from 0 to 255) of the image pixels at the same place, as 0 to 1."""
    return pixels.join(image.select(*on, *((F.col(c) / 255.0).alias(c) for c in "rgb")), list(on))


def world_points(pixels: DataFrame, poses: DataFrame, on: str | list[str] = "frame_id") -> DataFrame:
    """Valid pixels in world coordinates. poses has intrinsics (fx, fy, cx, cy) and twelve pose columns.

    Poses are a few numbers for each frame; Spark broadcasts them where their measured size allows."""
    joined = pixels.join(poses, on)
    camera = joined.withColumns(g.back_project("u", "v", "depth", "fx", "fy", "cx", "cy"))
    return camera.withColumns(g.transform("x", "y", "z")).drop("fx", "fy", "cx", "cy", *g.POSE)


def depth_statistics(pixels: DataFrame, frame: str = "frame_id", depth: str = "depth", share: float = 0.995, default: float = SCAN.depth_clip) -> DataFrame:
    """Each frame's scale for display: the percentile of its depths above 1e-6, or the default."""
    seen = F.when(~F.isnan(depth) & (F.col(depth) > 1e-6), F.col(depth))
    return pixels.groupBy(frame).agg(F.coalesce(F.percentile(seen, F.lit(share)), g.real(default)).alias("scale"), F.count(seen).alias("n_valid"))


def depth_levels(pixels: DataFrame, frame: str = "frame_id", depth: str = "depth") -> DataFrame:
    """Depth as 0 to 255 of its frame's scale."""
    scaled = pixels.join(depth_statistics(pixels, frame, depth), frame)
    share = F.try_divide(F.greatest(g.real(0), F.least(F.col("scale"), F.col(depth))), F.col("scale"))
    return scaled.withColumn("level", (share * 255.0).cast("int"))


def movement(poses: DataFrame, scan: str = "scan_id", least: float = SCAN.low_movement) -> DataFrame:
    """Diagonal of the box around the translations, of the given poses and of the camera centres."""
    inverse = poses.withColumns({f"c_{k}": v for k, v in g.invert_pose().items() if k[0] == "t"})
    spread = {f"{p}{a}": (F.max(f"{p}t{a}") - F.min(f"{p}t{a}")) for p in ("", "c_") for a in "xyz"}
    boxes = inverse.groupBy(scan).agg(*(v.alias(f"{k}_range") for k, v in spread.items()))
    return boxes.select(scan, g.norm("x_range", "y_range", "z_range").alias("movement"), g.norm("c_x_range", "c_y_range", "c_z_range").alias("centre_movement")).withColumn("low_movement", F.col("movement") < least)


def keyframes(poses: DataFrame, scan: str = "scan_id", frame: str = "frame_id", least_move: float = SCAN.keyframe_translation, least_turn: float = SCAN.keyframe_rotation) -> DataFrame:
    """Frames that moved or turned enough since the last frame that was kept; the first always stays.

    Which frame is compared depends on all choices before, so this is a fold over a scan's poses in order:
    one array of a few numbers for each frame of a scan, never its pixels."""
    names = [frame, *g.POSE]
    ordered = poses.groupBy(scan).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("poses"))
    kept = F.aggregate(F.slice("poses", 2, F.size("poses")), F.slice("poses", 1, 1), lambda done, p: F.when(
        moved(F.element_at(done, -1), p, least_move, least_turn), F.concat(done, F.array(p))).otherwise(done))
    return ordered.select(scan, F.explode(kept).alias("k")).select(scan, *(F.col(f"k.{n}").alias(n) for n in names))


def moved(last: Column, now: Column, least_move: float, least_turn: float) -> Column:
    distance = g.norm(*(now[t] - last[t] for t in ("tx", "ty", "tz")))
    turn = g.rotation_angle([last[n] for n in g.POSE[:9]], [now[n] for n in g.POSE[:9]])
    return (distance > least_move) | (turn > least_turn)


def ends(poses: DataFrame, scan: str = "scan_id", frame: str = "frame_id") -> DataFrame:
    """Start and goal: the ground positions of the first and the last frame."""
    at = F.struct("tx", "ty")
    return poses.groupBy(scan).agg(F.min_by(at, frame).alias("start"), F.max_by(at, frame).alias("goal")).select(
        scan, F.col("start.tx").alias("start_x"), F.col("start.ty").alias("start_y"), F.col("goal.tx").alias("goal_x"), F.col("goal.ty").alias("goal_y"))


def segments(path: DataFrame, scan: str = "scan_id", order: str = "seq") -> DataFrame:
    """Each waypoint with the next one and the distance to it; the last has none."""
    w = Window.partitionBy(scan).orderBy(order)
    out = path.withColumns({"next_x": F.lead("x").over(w), "next_y": F.lead("y").over(w)})
    return out.withColumn("length", F.sqrt((F.col("next_x") - F.col("x")) * (F.col("next_x") - F.col("x")) + (F.col("next_y") - F.col("y")) * (F.col("next_y") - F.col("y"))))


def path_length(path: DataFrame, scan: str = "scan_id", order: str = "seq") -> DataFrame:
    return segments(path, scan, order).groupBy(scan).agg(F.coalesce(F.sum("length"), g.real(0)).alias("path_length_m"), F.count("*").alias("n_points"))


def reveal(path: DataFrame, scan: str = "scan_id", order: str = "seq", frames: int = 60, full_at: int = 30) -> DataFrame:
    """Which waypoints each animation frame shows: the first int(min(f / full_at, 1) * n) of n.

    Each waypoint finds the first frame that shows it, then all later ones; no range join."""
    w = Window.partitionBy(scan)
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(order)) - 1
    numbered = path.withColumns({"n": n, "rank": rank})
    f = F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))
    shown = (F.least(F.col("animation_frame") / g.real(full_at), g.real(1)) * F.col("n")).cast("int")
    return numbered.withColumn("animation_frame", f).where(F.col("rank") < shown).drop("n", "rank")


def first_images(files: DataFrame, session: str = "session_id", path: str = "path", most: int = 6) -> DataFrame:
    """The first images of each session by path."""
    w = Window.partitionBy(session).orderBy(path)
    return files.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
