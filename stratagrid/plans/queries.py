"""One query for each operator of the scan pipeline, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SCAN
from ..functions import geometry as g
from ..iterate import durable, shared_dir
from ..operators import cloud, frames, mesh, neighbours, orientation, planes, planning, raster
from ..sources import images, rooms, scan_files
from ..streaming import scans as streams
from . import inputs, pipelines
from .inputs import CLOUD, IDENTIFIED, PIXELS, POSES, ROOM_SQL, SCANS, WALKS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n.split('.')[-1]}" for n in names)


# ---- frames, pixels and poses

@query("""WITH f AS (SELECT event_id, 1 + user_id % 60 AS fps FROM events), k AS (SELECT *, greatest(1, CAST(trunc(fps / 2.0::DOUBLE) AS INT)) AS step FROM f)
SELECT event_id, CAST(step AS INT) AS step, CAST(event_id // step AS INT) AS frame_id FROM k WHERE event_id % step = 0""")
def f0_frame_sampling(spark, d):
    f = inputs.read(spark, d, "events").select("event_id", (1 + F.col("user_id") % 60).alias("fps"))
    return frames.sample_frames(f, "fps", "event_id").select("event_id", F.col("interval").alias("step"), "frame_id")


@query(f"SELECT frame_id, u, v, {r('depth', 'conf')} FROM {PIXELS} WHERE depth > 0 AND depth < 8 AND (conf IS NULL OR conf > 0.5) AND NOT isnan(depth)")
def f1_valid_depth(spark, d):
    return rounded(frames.valid_pixels(inputs.pixels(spark, d)), "depth", "conf")


@query(f"""SELECT frame_id, u, v, {r('x', 'y', 'z')} FROM (SELECT frame_id, u, v, r00*cx_+r01*cy_+r02*d+tx AS x, r10*cx_+r11*cy_+r12*d+ty AS y, r20*cx_+r21*cy_+r22*d+tz AS z
FROM (SELECT p.*, q.u, q.v, q.depth AS d, (q.u-p.cx)*q.depth/p.fx AS cx_, (q.v-p.cy)*q.depth/p.fy AS cy_ FROM {PIXELS} q JOIN {POSES} p ON p.frame_id = q.frame_id
WHERE depth > 0 AND depth < 8 AND (conf IS NULL OR conf > 0.5)))""")
def m2_m4_world_points(spark, d):
    return rounded(frames.world_points(frames.valid_pixels(inputs.pixels(spark, d)), inputs.poses(spark, d)).select("frame_id", "u", "v", "x", "y", "z"), "x", "y", "z")


@query("""SELECT u, v, CAST(count(*) AS BIGINT) AS n, round(sum(depth), 6) + 0.0 AS depth FROM (SELECT CAST((k - 1) % 4 AS INT) AS u, CAST((k - 1) // 4 AS INT) AS v, a[k]::DOUBLE AS depth
FROM (SELECT embedding AS a, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)) GROUP BY u, v""")
def m1_pixel_grid(spark, d):
    maps = inputs.read(spark, d, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("depth"), F.lit(4).alias("width"))
    return rounded(frames.depth_pixels(maps).groupBy("u", "v").agg(F.count("*").alias("n"), F.sum("depth").alias("depth")), "depth")


@query(f"""SELECT frame_id, r00 AS i00, r10 AS i01, r20 AS i02, r01 AS i10, r11 AS i11, r21 AS i12, r02 AS i20, r12 AS i21, r22 AS i22,
round(-(r00*tx+r10*ty+r20*tz), 6) + 0.0 AS ix, round(-(r01*tx+r11*ty+r21*tz), 6) + 0.0 AS iy, round(-(r02*tx+r12*ty+r22*tz), 6) + 0.0 AS iz FROM {POSES}""")
def m5_pose_inversion(spark, d):
    out = inputs.poses(spark, d).select("frame_id", *(v.alias("i" + k[1:]) for k, v in g.invert_pose().items()))
    return rounded(out, "ix", "iy", "iz")


@query(f"""SELECT scan_id, frame_id, round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (t - 1.0) / 2.0)))), 6) + 0.0 AS angle, round(sqrt(dx*dx+dy*dy+dz*dz), 6) + 0.0 AS distance FROM (
SELECT b.scan_id, b.frame_id, {' + '.join(f'a.r{i}{j}*b.r{i}{j}' for i in range(3) for j in range(3))} AS t, b.tx-a.tx AS dx, b.ty-a.ty AS dy, b.tz-a.tz AS dz
FROM {WALKS} a JOIN {WALKS} b ON a.scan_id = b.scan_id AND b.frame_id = a.frame_id + 1)""")
def m6_m7_relative_motion(spark, d):
    w = inputs.walks(spark, d)
    before = w.select("scan_id", (F.col("frame_id") + 1).alias("frame_id"), *(F.col(c).alias(f"p_{c}") for c in g.POSE))
    pairs = w.join(before, ["scan_id", "frame_id"])
    angle = g.rotation_angle([F.col(f"p_{c}") for c in g.POSE[:9]], [F.col(c) for c in g.POSE[:9]])
    return rounded(pairs.select("scan_id", "frame_id", angle.alias("angle"), g.norm(*(F.col(t) - F.col(f"p_{t}") for t in g.POSE[9:])).alias("distance")), "angle", "distance")


@query(f"""WITH s AS (SELECT frame_id, coalesce(quantile_cont(depth, 0.995) FILTER (WHERE depth > 1e-6), 10.0::DOUBLE) AS scale FROM {PIXELS} GROUP BY frame_id)
SELECT p.frame_id, CAST(trunc(greatest(0.0::DOUBLE, least(scale, depth)) / scale * 255.0::DOUBLE) AS INT) AS level, CAST(count(*) AS BIGINT) AS n FROM {PIXELS} p JOIN s ON s.frame_id = p.frame_id GROUP BY ALL""")
def m9_depth_levels(spark, d):
    return frames.depth_levels(inputs.pixels(spark, d)).groupBy("frame_id", "level").agg(F.count("*").alias("n"))


@query(f"SELECT frame_id, round(coalesce(quantile_cont(depth, 0.995) FILTER (WHERE depth > 1e-6), 10.0::DOUBLE), 6) + 0.0 AS scale, CAST(count(*) FILTER (WHERE depth > 1e-6) AS BIGINT) AS n_valid FROM {PIXELS} GROUP BY frame_id")
def a8_f2_depth_scale(spark, d):
    return rounded(frames.depth_statistics(inputs.pixels(spark, d)), "scale")


@query("""SELECT l_orderkey, l_linenumber, round(greatest(0.0::DOUBLE, least(5.0::DOUBLE, l_quantity / 5)), 6) + 0.0 AS clipped, CAST(trunc(least(255.0::DOUBLE, greatest(0.0::DOUBLE, l_tax * 12.5::DOUBLE * 255.0::DOUBLE))) AS INT) AS alpha FROM lineitem""")
def m8_m10_clip_and_alpha(spark, d):
    t = inputs.read(spark, d, "lineitem")
    return rounded(t.select("l_orderkey", "l_linenumber", g.clip_depth(F.col("l_quantity") / 5, 5.0).alias("clipped"), g.alpha(F.col("l_tax") * 12.5).alias("alpha")), "clipped")


@query(f"""SELECT scan_id, {r('movement', 'centre_movement')}, movement < 0.1 AS low_movement FROM (SELECT scan_id, sqrt(power(max(tx)-min(tx),2)+power(max(ty)-min(ty),2)+power(max(tz)-min(tz),2)) AS movement,
sqrt(power(max(ix)-min(ix),2)+power(max(iy)-min(iy),2)+power(max(iz)-min(iz),2)) AS centre_movement FROM (SELECT *, -(r00*tx+r10*ty+r20*tz) AS ix, -(r01*tx+r11*ty+r21*tz) AS iy, -(r02*tx+r12*ty+r22*tz) AS iz FROM {WALKS}) GROUP BY scan_id)""")
def a2_f11_movement(spark, d):
    return rounded(frames.movement(inputs.walks(spark, d)), "movement", "centre_movement")


@query(f"""WITH RECURSIVE w AS MATERIALIZED (SELECT * FROM {WALKS}), k AS (
SELECT w.*, true AS kept, tx AS lx, ty AS ly, r00 AS l00, r10 AS l10 FROM w WHERE frame_id = 0
UNION ALL SELECT w.*, m.hit, CASE WHEN m.hit THEN w.tx ELSE k.lx END, CASE WHEN m.hit THEN w.ty ELSE k.ly END, CASE WHEN m.hit THEN w.r00 ELSE k.l00 END, CASE WHEN m.hit THEN w.r10 ELSE k.l10 END
FROM k JOIN w ON w.scan_id = k.scan_id AND w.frame_id = k.frame_id + 1,
LATERAL (SELECT sqrt((w.tx-k.lx)*(w.tx-k.lx)+(w.ty-k.ly)*(w.ty-k.ly)) > 0.08 OR degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (2*(w.r00*k.l00+w.r10*k.l10))/2.0)))) > 4 AS hit) m)
SELECT scan_id, frame_id FROM k WHERE kept""")
def w1_keyframes(spark, d):
    return frames.keyframes(inputs.walks(spark, d)).select("scan_id", "frame_id")


@query(f"SELECT scan_id, {r('start_x', 'start_y', 'goal_x', 'goal_y')} FROM (SELECT scan_id, arg_min(tx, frame_id) AS start_x, arg_min(ty, frame_id) AS start_y, arg_max(tx, frame_id) AS goal_x, arg_max(ty, frame_id) AS goal_y FROM {WALKS} GROUP BY scan_id)")
def w2_start_and_goal(spark, d):
    return rounded(frames.ends(inputs.walks(spark, d)), "start_x", "start_y", "goal_x", "goal_y")


def _path(spark, d):
    return inputs.walks(spark, d).select("scan_id", F.col("frame_id").alias("seq"), F.col("tx").alias("x"), F.col("ty").alias("y"))


PATH = f"(SELECT scan_id, frame_id AS seq, tx AS x, ty AS y FROM {WALKS})"


@query(f"SELECT scan_id, seq, {r('x', 'y', 'next_x', 'next_y')} FROM (SELECT *, lead(x) OVER w AS next_x, lead(y) OVER w AS next_y FROM {PATH} WINDOW w AS (PARTITION BY scan_id ORDER BY seq))")
def w3_r11_trajectory_segments(spark, d):
    return rounded(frames.segments(_path(spark, d)).drop("length"), "x", "y", "next_x", "next_y")


@query(f"""SELECT scan_id, round(coalesce(sum(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y))), 0), 6) + 0.0 AS path_length_m, CAST(count(*) AS BIGINT) AS n_points FROM
(SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM {PATH} WINDOW w AS (PARTITION BY scan_id ORDER BY seq)) GROUP BY scan_id""")
def a12_path_length(spark, d):
    return rounded(frames.path_length(_path(spark, d)), "path_length_m")


@query(f"SELECT scan_id, CAST(frame_id // 3 AS INT) AS batch_id, CAST(count(*) AS BIGINT) AS n FROM {WALKS} GROUP BY ALL")
def w4_batches(spark, d):
    return frames.batches(inputs.walks(spark, d)).groupBy("scan_id", "batch_id").agg(F.count("*").alias("n"))


KINDS = ("viz/%05d_depth.png", "pointcloud/filtered_cloud.ply", "pointcloud/colored_cloud.ply", "blueprint/floorplan_2d.png", "mesh/clean_mesh.ply", "debug/camera_trajectory.png", "blueprint/wireframe_2d.png", "debug/blueprint_comparison.png", "notes/%05d.txt")


def _files(spark, d):
    """events as files of sessions: every third is a depth image, the rest cycle through the kinds."""
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, KINDS[0]).otherwise(F.element_at(F.array(*map(F.lit, KINDS)), (e % len(KINDS) + 1).cast("int")))
    return inputs.read(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.replace(kind, F.lit("%05d"), F.lpad(e.cast("string"), 7, "0")).alias("path"))


FILES = f"""(SELECT CAST(user_id AS VARCHAR) AS session_id, replace(CASE WHEN event_id % 3 = 0 THEN '{KINDS[0]}' ELSE ({list(KINDS)})[event_id % {len(KINDS)} + 1] END, '%05d', lpad(CAST(event_id AS VARCHAR), 7, '0')) AS path FROM events)"""


@query(f"SELECT session_id, path, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY path) AS k FROM {FILES} WHERE path LIKE 'viz/%') WHERE k <= 6")
def w5_o1_first_images(spark, d):
    return frames.first_images(_files(spark, d).where("path like 'viz/%'"))


@query(f"""SELECT session_id, name, path FROM (
SELECT session_id, 'depth_viz_' || (k - 1) AS name, path FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY path) AS k FROM (SELECT DISTINCT * FROM {FILES} WHERE path LIKE 'viz/%')) WHERE k <= 6
UNION ALL SELECT session_id, 'pointcloud', min(path) FROM {FILES} WHERE path LIKE 'pointcloud/%' GROUP BY session_id
UNION ALL SELECT DISTINCT session_id, CASE path WHEN 'blueprint/floorplan_2d.png' THEN 'floorplan' WHEN 'mesh/clean_mesh.ply' THEN 'mesh' WHEN 'debug/camera_trajectory.png' THEN 'camera_trajectory' WHEN 'blueprint/wireframe_2d.png' THEN 'wireframe' ELSE 'blueprint_comparison' END, path
FROM {FILES} WHERE split_part(path, '/', 1) IN ('blueprint', 'mesh', 'debug'))""")
def s19_manifest(spark, d):
    return scan_files.manifest(_files(spark, d)).select("session_id", F.explode("outputs").alias("name", "path"))


@query(f"""SELECT session_id, CASE WHEN n % 2 = 0 THEN 'two' ELSE 'one' END AS a, 'x' AS b FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS n FROM events GROUP BY user_id)""")
def u5_merged_outputs(spark, d):
    n = inputs.read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.count("*").alias("n"))
    maps = n.select("session_id", F.create_map(F.lit("a"), F.lit("one"), F.lit("b"), F.lit("x")).alias("outputs"), F.when(F.col("n") % 2 == 0, F.create_map(F.lit("a"), F.lit("two"))).otherwise(F.create_map().cast("map<string,string>")).alias("more"))
    m = maps.select("session_id", scan_files.merged_outputs().alias("m"))
    return m.select("session_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def s18_latest_status(spark, d):
    log = inputs.read(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("map<string,string>").alias("outputs"))
    return scan_files.latest_status(log).select("session_id", "status")


@query(f"""SELECT scan_id, CAST(f AS INT) AS animation_frame, CAST(count(*) AS BIGINT) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY scan_id) AS n FROM {PATH}), range(60) t(f)
WHERE k < trunc(least(f / 30.0::DOUBLE, 1.0::DOUBLE) * n) GROUP BY ALL""")
def w6_reveal(spark, d):
    return frames.reveal(_path(spark, d)).groupBy("scan_id", "animation_frame").agg(F.count("*").alias("shown"))


@query(f"SELECT scan_id, CAST(count(*) AS BIGINT) AS n_frames, count(*) >= 3 AS enough FROM {WALKS} GROUP BY scan_id")
def f10_enough_frames(spark, d):
    return frames.enough_frames(inputs.walks(spark, d))


@query("""SELECT event_id, regexp_extract(p, '[^/]*$') AS name, lower(regexp_extract(p, '(\\.[^./]*)$')) AS ext, lpad(CAST(event_id AS VARCHAR), 9, '0') AS number, lower(regexp_extract(p, '(\\.[^./]*)$')) IN ('.mp4', '.webm') AND value / 10 BETWEEN 5 AND 20 AS accepted,
p NOT LIKE '%..%' AS safe FROM (SELECT event_id, value, 's/' || CASE event_id % 3 WHEN 0 THEN 'clip.MP4' WHEN 1 THEN '../x.webm' ELSE 'a.b/noext' END AS p FROM events)""")
def f12_f13_m23_m24_paths(spark, d):
    e = inputs.read(spark, d, "events").select("event_id", "value", F.concat(F.lit("s\\"), F.when(F.col("event_id") % 3 == 0, "clip.MP4").when(F.col("event_id") % 3 == 1, "../x.webm").otherwise("a.b/noext")).alias("p"))
    return e.select("event_id", g.basename("p").alias("name"), g.suffix("p").alias("ext"), g.padded("event_id", 9).alias("number"), (g.suffix("p").isin(".mp4", ".webm") & (F.col("value") / 10).between(5, 20)).alias("accepted"), g.safe_relative("p").alias("safe"))


# ---- clouds

@query(f"SELECT CAST(count(*) AS BIGINT) AS n, {', '.join(f'round({f}({a}), 6) + 0.0 AS {a}_{f}' for a in 'xyz' for f in ('min', 'max'))} FROM {CLOUD}")
def a1_a6_bounds(spark, d):
    out = cloud.bounds(inputs.cloud(spark, d))
    return rounded(out, *(c for c in out.columns if c != "n"))


@query(f"SELECT {r('x', 'y', 'z', digits=9)} FROM {CLOUD} WHERE z > 1.0 - 0.3 AND z < 1.0 + 0.3")
def f3_open_slice(spark, d):
    return rounded(cloud.open_slice(inputs.cloud(spark, d), 1.0, 0.3).select("x", "y", "z"), "x", "y", "z", digits=9)


@query(f"SELECT {r('x', 'y', 'z', digits=9)} FROM {CLOUD}, (SELECT median(z) AS m FROM {CLOUD}) WHERE z > m - 0.2 AND z < m + 0.2")
def f4_a7_adaptive_slice(spark, d):
    return rounded(cloud.adaptive_slice(inputs.cloud(spark, d), 9.0).select("x", "y", "z"), "x", "y", "z", digits=9)


@query(f"""SELECT CAST(floor((x-(x0-0.125))/0.25::DOUBLE) AS BIGINT) AS vx, CAST(floor((y-(y0-0.125))/0.25::DOUBLE) AS BIGINT) AS vy, CAST(floor((z-(z0-0.125))/0.25::DOUBLE) AS BIGINT) AS vz, CAST(count(*) AS BIGINT) AS n_points,
round(avg(x), 9) + 0.0 AS x, round(avg(y), 9) + 0.0 AS y, round(avg(z), 9) + 0.0 AS z FROM {CLOUD}, (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM {CLOUD}) GROUP BY 1, 2, 3""")
def a3_voxels(spark, d):
    return rounded(cloud.voxels(inputs.cloud(spark, d), 0.25), "x", "y", "z", digits=9)


PAIRS = f"(SELECT p.point_id AS point, q.point_id AS other, (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z) AS d2 FROM {IDENTIFIED} p JOIN {IDENTIFIED} q ON p.point_id <> q.point_id)"
KNN = f"(SELECT *, row_number() OVER (PARTITION BY point ORDER BY d2, other) AS k FROM {PAIRS})"


@query(f"SELECT point, other, {r('d2', digits=9)}, CAST(k AS INT) AS rank FROM {KNN} WHERE k <= 20")
def j2_k_nearest(spark, d):
    p = inputs.identified(spark, d)
    return rounded(neighbours.nearest(p, p, 20), "d2", digits=9)


@query(f"SELECT point, other, {r('d2', digits=9)} FROM {PAIRS} WHERE d2 <= 0.05::DOUBLE * 0.05::DOUBLE")
def j3_radius_pairs(spark, d):
    p = inputs.identified(spark, d)
    return rounded(neighbours.within(p, p, 0.05, salts=2), "d2", digits=9)


@query(f"SELECT point, arg_min(other, (d2, other)) AS other FROM {PAIRS} WHERE d2 <= 0.06::DOUBLE * 0.06::DOUBLE GROUP BY point")
def j4_nearest_match(spark, d):
    p = inputs.identified(spark, d)
    return neighbours.match(p, p, 0.06).select("point", "other")


@query(f"SELECT point AS point_id, round(sqrt(min(d2)), 9) + 0.0 AS distance FROM {PAIRS} GROUP BY point")
def j5_nearest_distance(spark, d):
    return rounded(cloud.nearest_distances(inputs.identified(spark, d)), "distance", digits=9)


@query(f"SELECT round(m, 9) + 0.0 AS mean_distance, round(1.5 * m, 9) + 0.0 AS r1, round(3 * m, 9) + 0.0 AS r2, round(6 * m, 9) + 0.0 AS r3 FROM (SELECT avg(s) AS m FROM (SELECT sqrt(min(d2)) AS s FROM {PAIRS} GROUP BY point))")
def a9_pivot_radii(spark, d):
    out = cloud.pivot_radii(inputs.identified(spark, d)).select("mean_distance", *(F.col("radii")[i].alias(f"r{i + 1}") for i in range(3)))
    return rounded(out, *out.columns, digits=9)


@query(f"SELECT point AS point_id FROM (SELECT point, avg(sqrt(d2)) AS m FROM {KNN} WHERE k <= 20 GROUP BY point), (SELECT avg(m) + 1.5 * stddev_samp(m) AS most FROM (SELECT point, avg(sqrt(d2)) AS m FROM {KNN} WHERE k <= 20 GROUP BY point)) WHERE m <= most")
def a4_statistical_inliers(spark, d):
    return cloud.statistical_inliers(inputs.identified(spark, d)).select("point_id")


@query(f"SELECT point AS point_id FROM {PAIRS} WHERE d2 <= 0.1::DOUBLE * 0.1::DOUBLE GROUP BY point HAVING count(*) >= 12")
def a5_radius_inliers(spark, d):
    return cloud.radius_inliers(inputs.identified(spark, d), 0.1).select("point_id")


@query(f"""WITH v AS (SELECT row_number() OVER () AS i, * FROM (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {IDENTIFIED}, (SELECT min(x) - 0.06/2::DOUBLE AS x0, min(y) - 0.06/2::DOUBLE AS y0, min(z) - 0.06/2::DOUBLE AS z0 FROM {IDENTIFIED})
GROUP BY floor((x-x0)/0.06::DOUBLE), floor((y-y0)/0.06::DOUBLE), floor((z-z0)/0.06::DOUBLE))) SELECT {r('p.x', 'p.y', 'p.z')} FROM v p JOIN v q ON p.i <> q.i AND (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z) <= 0.12::DOUBLE * 0.12::DOUBLE GROUP BY p.i, p.x, p.y, p.z HAVING count(*) >= 12""")
def p4_without_ghosts(spark, d):
    return rounded(cloud.without_ghosts(inputs.identified(spark, d), 0.04).select("x", "y", "z"), "x", "y", "z")


COVARIANCE = f"""(SELECT n.point AS point_id, count(*) AS n_used, avg(x*x)-avg(x)*avg(x) AS xx, avg(x*y)-avg(x)*avg(y) AS xy, avg(x*z)-avg(x)*avg(z) AS xz, avg(y*y)-avg(y)*avg(y) AS yy, avg(y*z)-avg(y)*avg(z) AS yz, avg(z*z)-avg(z)*avg(z) AS zz
FROM (SELECT point, other FROM {KNN} WHERE k <= 29 AND d2 <= 0.1::DOUBLE*0.1::DOUBLE UNION ALL SELECT point_id, point_id FROM {IDENTIFIED}) n JOIN {IDENTIFIED} q ON q.point_id = n.other GROUP BY n.point)"""


@query(f"SELECT point_id, n_used, {r('xx', 'xy', 'xz', 'yy', 'yz', 'zz', digits=9)} FROM {COVARIANCE}")
def a15_covariances(spark, d):
    out = cloud.covariances(inputs.identified(spark, d)).select("point_id", "n_used", "xx", "xy", "xz", "yy", "yz", "zz")
    return rounded(out, *out.columns[2:], digits=9)


#: The eigenvector of the least eigenvalue of a symmetric matrix, by the angle form of the cubic.
NORMALS = f"""(SELECT point_id, n_used, ux/l AS nx, uy/l AS ny, uz/l AS nz FROM (SELECT *, sqrt(ux*ux+uy*uy+uz*uz) AS l FROM (
SELECT point_id, n_used, unnest([{{'ux': a1*b2-a2*b1, 'uy': a2*b0-a0*b2, 'uz': a0*b1-a1*b0}}, {{'ux': a1*c2-a2*c1, 'uy': a2*c0-a0*c2, 'uz': a0*c1-a1*c0}}, {{'ux': b1*c2-b2*c1, 'uy': b2*c0-b0*c2, 'uz': b0*c1-b1*c0}}], recursive := true)
FROM (SELECT point_id, n_used, xx-e AS a0, xy AS a1, xz AS a2, xy AS b0, yy-e AS b1, yz AS b2, xz AS c0, yz AS c1, zz-e AS c2
FROM (SELECT *, m + 2*p*cos(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, det/(2*p*p*p))))/3 + 2*pi()/3) AS e FROM (SELECT *, (xx-m)*((yy-m)*(zz-m)-yz*yz) - xy*(xy*(zz-m)-yz*xz) + xz*(xy*yz-(yy-m)*xz) AS det
FROM (SELECT *, sqrt(((xx-m)*(xx-m)+(yy-m)*(yy-m)+(zz-m)*(zz-m)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM (SELECT *, (xx+yy+zz)/3 AS m FROM {COVARIANCE}))))))) QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY l DESC) = 1)"""


@query(f"""SELECT i.point_id, CASE WHEN coalesce(n_used, 1) < 3 THEN 0.0 ELSE round(nx*nx, 5) + 0.0 END AS xx, CASE WHEN coalesce(n_used, 1) < 3 THEN 0.0 ELSE round(nx*ny, 5) + 0.0 END AS xy,
CASE WHEN coalesce(n_used, 1) < 3 THEN 1.0 ELSE round(nz*nz, 5) + 0.0 END AS zz FROM {IDENTIFIED} i LEFT JOIN {NORMALS} n ON n.point_id = i.point_id""")
def a15_normals(spark, d):
    """Normals have a free sign, so products of their parts are compared."""
    n = cloud.normals(inputs.identified(spark, d))
    return rounded(n.select("point_id", *((F.col(f"n{a}") * F.col(f"n{b}")).alias(a + b) for a, b in (("x", "x"), ("x", "y"), ("z", "z")))), "xx", "xy", "zz", digits=5)


@query("SELECT point_id, CAST(CASE WHEN x * (0.5 - x) + y * (0.5 - y) + z * (2.0 - z) < 0 THEN -1 ELSE 1 END AS INT) AS side FROM " + IDENTIFIED)
def p5_face_camera(spark, d):
    p = inputs.identified(spark, d).withColumns({"nx": F.col("x"), "ny": F.col("y"), "nz": F.col("z"), "frame_id": F.lit(0)})
    cameras = spark.createDataFrame([(0, 0.5, 0.5, 2.0)], "frame_id int, tx double, ty double, tz double")
    return cloud.face_camera(p, cameras).select("point_id", F.when((F.col("nx") == F.col("x")) & (F.col("ny") == F.col("y")) & (F.col("nz") == F.col("z")), 1).otherwise(-1).alias("side"))


@query(f"SELECT {r('x', 'y', 'z', digits=9)} FROM {CLOUD} UNION ALL SELECT {r('x', 'y', 'z', digits=9)} FROM {IDENTIFIED}")
def u1_a16_fused_clouds(spark, d):
    return rounded(inputs.cloud(spark, d).select("x", "y", "z").unionByName(inputs.identified(spark, d).select("x", "y", "z")), "x", "y", "z", digits=9)


# ---- planes

PLANE_ROWS = "(SELECT s_suppkey AS plane_id, s_suppkey % 7 - 3.0::DOUBLE AS a, s_suppkey % 5 - 2.0::DOUBLE AS b, s_suppkey % 23 + 0.5::DOUBLE AS c, s_acctbal / 1000 AS d FROM supplier)"


def _planes(spark, d):
    k = F.col("s_suppkey")
    return inputs.read(spark, d, "supplier").select(k.alias("plane_id"), (k % 7 - 3.0).alias("a"), (k % 5 - 2.0).alias("b"), (k % 23 + 0.5).alias("c"), (F.col("s_acctbal") / 1000).alias("d"))


@query(f"""SELECT plane_id, round(angle, 6) + 0.0 AS angle, CASE WHEN angle < 15 THEN 'floor/ceiling' WHEN angle > 75 THEN 'wall' ELSE 'sloped' END AS type, round(abs(d) / sqrt(a*a+b*b+c*c), 6) + 0.0 AS distance
FROM (SELECT *, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, abs(c / sqrt(a*a+b*b+c*c)))))) AS angle FROM {PLANE_ROWS})""")
def m11_m12_m13_plane_classes(spark, d):
    return rounded(planes.classify(_planes(spark, d)).select("plane_id", "angle", "type", g.plane_distance("a", "b", "c", "d").alias("distance")), "angle", "distance")


@query(f"SELECT round(coalesce((SELECT min(abs(d) / sqrt(a*a+b*b+c*c)) FROM {PLANE_ROWS} WHERE c / sqrt(a*a+b*b+c*c) > 0.8), (SELECT min(z) FROM {CLOUD})), 6) + 0.0 AS floor_height")
def p2_o5_floor_height(spark, d):
    return rounded(planes.floor_height(_planes(spark, d), inputs.cloud(spark, d)), "floor_height")


@query(f"SELECT CAST(k AS INT) AS plane_id, CAST((SELECT count(*) FROM {CLOUD} WHERE abs(0.6*x + 0*y + 0.8*z + -(k / 4.0::DOUBLE)) < 0.05) AS BIGINT) AS n FROM range(12) t(k)")
def j11_plane_inliers(spark, d):
    import numpy as np

    found = planes.count_inliers(inputs.cloud(spark, d), np.asarray([(0.6, 0.0, 0.8, -k / 4) for k in range(12)]), 0.05)
    return spark.createDataFrame([(k, int(n)) for k, n in enumerate(found)], "plane_id int, n long")


def _detected(rounds: int) -> str:
    """Plane detection in SQL: the rounds one after another, each over the points that the one before left."""
    parts = [f"p0 AS MATERIALIZED (SELECT * FROM {SCANS})"]
    for k in range(rounds):
        parts.append(f"""s{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY md5(concat_ws(':', scan_id, point_id, 42, {k})), point_id) - 1 AS i FROM p{k} WHERE scan_id IN (SELECT scan_id FROM p{k} GROUP BY scan_id HAVING count(*) >= 500)) WHERE i < 3000),
t{k} AS (SELECT scan_id, i // 3 AS k, {', '.join(f'max({a}) FILTER (i % 3 = {j}) AS {a}{j}' for j in range(3) for a in 'xyz')} FROM s{k} GROUP BY 1, 2 HAVING count(*) = 3),
u{k} AS (SELECT scan_id, k, x0, y0, z0, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS a, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS b, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS c FROM t{k}),
v{k} AS (SELECT scan_id, k, x0, y0, z0, CASE WHEN c < 0 THEN -a ELSE a END / sqrt(a*a+b*b+c*c) AS a, CASE WHEN c < 0 THEN -b ELSE b END / sqrt(a*a+b*b+c*c) AS b, abs(c) / sqrt(a*a+b*b+c*c) AS c FROM u{k} WHERE sqrt(a*a+b*b+c*c) > 1e-12),
w{k} AS MATERIALIZED (SELECT scan_id, k, a, b, c, -(a*x0+b*y0+c*z0) AS d FROM v{k}),
b{k} AS MATERIALIZED (SELECT scan_id, {k} AS plane_id, a, b, c, d, n FROM (SELECT w.scan_id, k, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, count(*) AS n FROM w{k} w JOIN p{k} p ON p.scan_id = w.scan_id AND abs(a*x+b*y+c*z+d) < 0.05 GROUP BY w.scan_id, k HAVING count(*) >= 500)
    QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, k) = 1),
p{k + 1} AS MATERIALIZED (SELECT p.* FROM p{k} p JOIN b{k} b ON p.scan_id = b.scan_id AND NOT abs(a*x+b*y+c*z+d) < 0.05)""")
    return "WITH " + ", ".join(parts)


PLANE_ROUNDS = 10
FOUND = " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(PLANE_ROUNDS))


@query(_detected(PLANE_ROUNDS) + f""" SELECT scan_id, CAST(plane_id AS INT) AS plane_id, {r('a', 'b', 'c', 'd')}, CAST(n AS BIGINT) AS num_points, round(angle, 4) + 0.0 AS angle, CASE WHEN angle < 15 THEN 'floor/ceiling' WHEN angle > 75 THEN 'wall' ELSE 'sloped' END AS type
FROM (SELECT *, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, abs(c / sqrt(a*a+b*b+c*c)))))) AS angle FROM ({FOUND}))""")
def p1_o4_u2_planes_of_scans(spark, d):
    """The planes of all scans in one job, by their largest sets of points."""
    found = planes.detect_scans(inputs.scans(spark, d))[0]
    return rounded(rounded(found, "a", "b", "c", "d"), "angle", digits=4)


def _off() -> str:
    gone = " AND ".join(f"NOT EXISTS (SELECT 1 FROM q{k} WHERE q{k}.point_id = p0.point_id)" for k in range(PLANE_ROUNDS))
    held = ", ".join(f"q{k} AS (SELECT point_id FROM p{k} p JOIN b{k} b ON p.scan_id = b.scan_id AND abs(a*x+b*y+c*z+d) < 0.05)" for k in range(PLANE_ROUNDS))
    return f", {held} SELECT scan_id, point_id FROM p0 WHERE {gone}"


@query(_detected(PLANE_ROUNDS) + _off())
def f6_u3_points_off_planes(spark, d):
    """What is on no plane of its scan: the cloud without the members of all planes."""
    points = inputs.scans(spark, d)
    members = planes.detect_scans(points)[1]
    return points.join(members, ["scan_id", "point_id"], "left_anti").select("scan_id", "point_id")


def _shifted(spark, d):
    """Five pairs: the identified cloud with normals, and the same a little turned and shifted, more for each pair."""
    target = durable(cloud.normals(inputs.identified(spark, d), radius=0.3), "target")
    pairs = inputs.read(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("pair_id"))
    move = (F.col("pair_id") + 1) * 0.001
    moving = inputs.identified(spark, d).crossJoin(F.broadcast(pairs))  # five regions
    return moving.withColumns({"x": F.col("x") + move, "y": F.col("y") - move / 2}), target.crossJoin(F.broadcast(pairs))


@query()
def p3_registration(spark, d):
    """The poses of five pairs in one job; each is recomputed pair by pair in a test."""
    moving, target = _shifted(spark, d)
    return planes.register_pairs(moving, target, 0.05)


@query()
def p5_spanning_orientation(spark, d):
    """Normals that agree along the spanning forest of the ten nearest; a test builds the forest edge by edge."""
    p = inputs.identified(spark, d)
    near = durable(neighbours.nearest(p, p, SCAN.normal_neighbours - 1), "near")
    found = durable(cloud.normals(p, radius=0.3, near=near), "normals")
    return rounded(orientation.orient(found, near.where("rank <= 10")), "nx", "ny", "nz")


# ---- meshes

def _field(spark, d):
    """part as a height field of 40 columns: a vertex for each part, two triangles for each with parts to the right and below."""
    k = F.col("p_partkey")
    part = inputs.read(spark, d, "part")
    vertices = part.select(k.alias("vertex_id"), F.floor(k / 40).cast("double").alias("x"), (k % 40).cast("double").alias("y"), (F.col("p_size") % 5 * g.real(0.25)).alias("z"), F.col("p_retailprice").alias("density"))
    corner = part.where(k % 40 < 39).select(k.alias("p"))
    for step in (1, 40, 41):
        corner = corner.join(part.select((k - step).alias("p")).hint("merge"), "p", "left_semi")
    p = F.col("p")
    two = F.explode(F.array(F.struct((p * 2).alias("face_id"), p.alias("v0"), (p + 40).alias("v1"), (p + 41).alias("v2")), F.struct((p * 2 + 1).alias("face_id"), p.alias("v0"), (p + 41).alias("v1"), (p + 1).alias("v2"))))
    return vertices, corner.select(two.alias("t")).select("t.*")


VERTICES = "(SELECT p_partkey AS vertex_id, (p_partkey // 40) * 1.0::DOUBLE AS x, (p_partkey % 40) * 1.0::DOUBLE AS y, (p_size % 5) * 0.25::DOUBLE AS z, p_retailprice AS density FROM part)"
TRIANGLES = """(SELECT p * 2 + i AS face_id, p AS v0, p + CASE WHEN i = 1 THEN 41 ELSE 40 END AS v1, p + CASE WHEN i = 1 THEN 1 ELSE 41 END AS v2 FROM (SELECT p_partkey AS p FROM part WHERE p_partkey % 40 < 39
AND p_partkey + 1 IN (SELECT p_partkey FROM part) AND p_partkey + 40 IN (SELECT p_partkey FROM part) AND p_partkey + 41 IN (SELECT p_partkey FROM part)), range(2) t(i))"""
FACES = f"""(SELECT face_id, v0, v1, v2, wx/sqrt(wx*wx+wy*wy+wz*wz) AS nx, wy/sqrt(wx*wx+wy*wy+wz*wz) AS ny, wz/sqrt(wx*wx+wy*wy+wz*wz) AS nz, sqrt(wx*wx+wy*wy+wz*wz)/2 AS area FROM (SELECT face_id, v0, v1, v2,
(b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS wx, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS wy, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS wz
FROM {TRIANGLES} t JOIN {VERTICES} a ON a.vertex_id = v0 JOIN {VERTICES} b ON b.vertex_id = v1 JOIN {VERTICES} c ON c.vertex_id = v2))"""
EDGES = f"(SELECT least(p, q) AS lo, greatest(p, q) AS hi, face_id FROM (SELECT v0 AS p, v1 AS q, face_id FROM {TRIANGLES} UNION ALL SELECT v1, v2, face_id FROM {TRIANGLES} UNION ALL SELECT v0, v2, face_id FROM {TRIANGLES}))"
EDGE_FACES = f"""(SELECT lo, hi, CAST(n AS BIGINT) AS n_faces, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, p.nx*q.nx+p.ny*q.ny+p.nz*q.nz)))) AS angle FROM (SELECT lo, hi, count(*) AS n, min(face_id) AS f, max(face_id) AS l FROM {EDGES} GROUP BY lo, hi)
JOIN {FACES} p ON p.face_id = f JOIN {FACES} q ON q.face_id = l)"""


@query(f"SELECT face_id, {r('nx', 'ny', 'nz', 'area')} FROM {FACES}")
def m18_j7_face_normals(spark, d):
    return rounded(mesh.faces(*_field(spark, d)).select("face_id", "nx", "ny", "nz", "area"), "nx", "ny", "nz", "area")


@query(f"SELECT lo, hi, n_faces, round(angle, 4) + 0.0 AS angle FROM {EDGE_FACES}")
def a10_m19_o2_edge_angles(spark, d):
    return rounded(mesh.edge_faces(*_field(spark, d)), "angle", digits=4)


@query(f"SELECT lo, hi, n_faces FROM {EDGE_FACES} WHERE n_faces = 1 OR (n_faces = 2 AND angle > 30)")
def g7_feature_edges(spark, d):
    return mesh.feature_edges(*_field(spark, d)).select("lo", "hi", "n_faces")


TRIMMED = f"(SELECT vertex_id FROM {VERTICES} WHERE density >= (SELECT quantile_cont(density, 0.01) FROM {VERTICES}))"


@query(f"SELECT face_id FROM {TRIANGLES} WHERE v0 IN (SELECT vertex_id FROM {TRIMMED}) AND v1 IN (SELECT vertex_id FROM {TRIMMED}) AND v2 IN (SELECT vertex_id FROM {TRIMMED})")
def g3_f7_density_trim(spark, d):
    return mesh.trim(*_field(spark, d))[1].select("face_id")


@query(f"""WITH e AS (SELECT DISTINCT lo, hi FROM {EDGES}), l AS (SELECT lo AS i, hi AS o FROM e UNION ALL SELECT hi, lo FROM e), v0 AS (SELECT vertex_id AS i, x, y, z FROM {VERTICES}),
v1 AS (SELECT v.i, (v.x+sum(w.x))/(1+count(*)) AS x, (v.y+sum(w.y))/(1+count(*)) AS y, (v.z+sum(w.z))/(1+count(*)) AS z FROM v0 v JOIN l ON l.i = v.i JOIN v0 w ON w.i = l.o GROUP BY v.i, v.x, v.y, v.z),
v2 AS (SELECT v.i, (v.x+sum(w.x))/(1+count(*)) AS x, (v.y+sum(w.y))/(1+count(*)) AS y, (v.z+sum(w.z))/(1+count(*)) AS z FROM v1 v JOIN l ON l.i = v.i JOIN v1 w ON w.i = l.o GROUP BY v.i, v.x, v.y, v.z),
v3 AS (SELECT v.i, (v.x+sum(w.x))/(1+count(*)) AS x, (v.y+sum(w.y))/(1+count(*)) AS y, (v.z+sum(w.z))/(1+count(*)) AS z FROM v2 v JOIN l ON l.i = v.i JOIN v2 w ON w.i = l.o GROUP BY v.i, v.x, v.y, v.z)
SELECT i AS vertex_id, {r('x', 'y', 'z')} FROM v3""")
def g4_smoothing(spark, d):
    return rounded(mesh.smooth(*_field(spark, d)), "x", "y", "z")


@query(f"""SELECT vertex_id, {r('nx', 'ny', 'nz')} FROM (SELECT vertex_id, x/sqrt(x*x+y*y+z*z) AS nx, y/sqrt(x*x+y*y+z*z) AS ny, z/sqrt(x*x+y*y+z*z) AS nz
FROM (SELECT vertex_id, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM (SELECT unnest([v0, v1, v2]) AS vertex_id, nx, ny, nz FROM {FACES}) GROUP BY vertex_id))""")
def g5_vertex_normals(spark, d):
    return rounded(mesh.vertex_normals(*_field(spark, d)), "nx", "ny", "nz")


@query("""WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS vertex_id, l_quantity AS x, l_discount AS y FROM lineitem), p AS (SELECT x, y, min(vertex_id) AS k FROM v GROUP BY x, y), n AS (SELECT DISTINCT v.vertex_id, p.k FROM v JOIN p ON p.x = v.x AND p.y = v.y),
t AS (SELECT o_orderkey AS face_id, o_orderkey * 10 + 1 AS v0, o_orderkey * 10 + 2 AS v1, o_orderkey * 10 + 3 AS v2 FROM orders), m AS (SELECT face_id, a.k AS a, b.k AS b, c.k AS c FROM t JOIN n a ON a.vertex_id = v0 JOIN n b ON b.vertex_id = v1 JOIN n c ON c.vertex_id = v2)
SELECT min(face_id) AS face_id, list_sort([a, b, c])[1] AS c0, list_sort([a, b, c])[2] AS c1, list_sort([a, b, c])[3] AS c2 FROM m WHERE a <> b AND b <> c AND a <> c GROUP BY list_sort([a, b, c])""")
def g6_u4_mesh_cleanup(spark, d):
    v = inputs.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("vertex_id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.lit(0.0).alias("z")).distinct()
    o = F.col("o_orderkey")
    t = inputs.read(spark, d, "orders").select(o.alias("face_id"), *((o * 10 + i + 1).alias(f"v{i}") for i in range(3)))
    corners = F.array_sort(F.array("v0", "v1", "v2"))
    return mesh.clean(v, t)[1].select("face_id", *(corners[i].alias(f"c{i}") for i in range(3)))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n_vertices, {', '.join(f'max({a})-min({a}) AS {a}_size, round(avg({a}), 6) + 0.0 AS {a}_mean' for a in 'xyz')}, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z))/2 AS half_range FROM {VERTICES}")
def a11_r12_mesh_extents(spark, d):
    return rounded(mesh.extents(_field(spark, d)[0]), "x_mean", "y_mean", "z_mean")


@query()
def r12_wireframe_counts(spark, d):
    return pipelines.wireframe(*_field(spark, d))[1]


# ---- grids, rasters and paths

def _occupied(source: str, height: float, half: float, margin: int) -> str:
    """The occupancy grid in SQL: occupied cells and the grid's facts."""
    return f"""WITH s AS (SELECT x, y FROM {source} WHERE z BETWEEN {height}::DOUBLE - {half}::DOUBLE AND {height}::DOUBLE + {half}::DOUBLE),
i AS (SELECT min(x) AS x0, min(y) AS y0, greatest(1, CAST(ceil((max(x)-min(x))/0.1::DOUBLE) AS INT)) AS nx, greatest(1, CAST(ceil((max(y)-min(y))/0.1::DOUBLE) AS INT)) AS ny FROM s),
c AS (SELECT DISTINCT greatest(0, least(nx-1, CAST(trunc((x-x0)/0.1::DOUBLE) AS INT))) AS gx, greatest(0, least(ny-1, CAST(trunc((y-y0)/0.1::DOUBLE) AS INT))) AS gy FROM s, i),
o AS (SELECT DISTINCT CAST(gx + a.k AS INT) AS gx, CAST(gy + b.k AS INT) AS gy FROM c, range(-{margin}, {margin + 1}) a(k), range(-{margin}, {margin + 1}) b(k), i WHERE gx + a.k >= 0 AND gx + a.k < nx AND gy + b.k >= 0 AND gy + b.k < ny)"""


@query(_occupied(CLOUD, 1.0, 0.3, 2) + " SELECT gx, gy FROM o")
def r7_f5_a14_r8_occupancy(spark, d):
    return raster.occupancy(inputs.cloud(spark, d))[0]


@query(f"SELECT part, {r('x', 'y', 'z', digits=9)} FROM {ROOM_SQL}")
def s21_m21_room(spark, d):
    return rounded(rooms.room(spark), "x", "y", "z", digits=9)


def _splat(level: str, scale: int) -> str:
    """The floor plan of the points of `level` in SQL: facts, discs, and the closed mask."""
    return f"""WITH s AS ({level}), m AS (SELECT min(x)-0.5 AS x0, max(y)+0.5 AS y1, CAST(trunc((max(x)+0.5-(min(x)-0.5))*{scale}) AS INT) AS w, CAST(trunc((max(y)+0.5-(min(y)-0.5))*{scale}) AS INT) AS h FROM s),
p AS (SELECT DISTINCT CAST(trunc((x-x0)*{scale}) AS INT) AS px, CAST(trunc((y1-y)*{scale}) AS INT) AS py FROM s, m), disc AS (SELECT a.k AS dx, b.k AS dy FROM range(-2, 3) a(k), range(-2, 3) b(k) WHERE a.k*a.k+b.k*b.k <= 4),
q AS (SELECT DISTINCT CAST(px+dx AS INT) AS px, CAST(py+dy AS INT) AS py FROM p, disc, m WHERE px >= 0 AND px < w AND py >= 0 AND py < h AND px+dx >= 0 AND px+dx < w AND py+dy >= 0 AND py+dy < h),
box AS (SELECT a.k AS dx, b.k AS dy FROM range(-2, 3) a(k), range(-2, 3) b(k)),
dil AS (SELECT DISTINCT CAST(px+dx AS INT) AS px, CAST(py+dy AS INT) AS py FROM q, box, m WHERE px+dx >= 0 AND px+dx < w AND py+dy >= 0 AND py+dy < h),
ero AS (SELECT px+dx AS px, py+dy AS py FROM dil, box, m WHERE px+dx >= 0 AND px+dx < w AND py+dy >= 0 AND py+dy < h GROUP BY px+dx, py+dy HAVING count(*) = any_value((least(px+dx+2, w-1)-greatest(px+dx-2, 0)+1)*(least(py+dy+2, h-1)-greatest(py+dy-2, 0)+1)))"""


SPLAT = _splat(f"SELECT x, y FROM {CLOUD} WHERE z > 0.9 AND z < 1.1", 20)
FLOOR_LEVEL = f"""SELECT x, y FROM {CLOUD}, (SELECT lo, hi, middle, (SELECT count(*) FROM {CLOUD} WHERE z > lo AND z < hi) >= 100 AS enough FROM (SELECT h + 1.2::DOUBLE - 0.1::DOUBLE AS lo, h + 1.2::DOUBLE + 0.1::DOUBLE AS hi, (SELECT median(z) FROM {CLOUD}) AS middle
FROM (SELECT coalesce((SELECT min(abs(d) / sqrt(a*a+b*b+c*c)) FROM {PLANE_ROWS} WHERE c / sqrt(a*a+b*b+c*c) > 0.8), (SELECT min(z) FROM {CLOUD})) AS h))) WHERE CASE WHEN enough THEN z > lo AND z < hi ELSE z > middle - 0.2::DOUBLE AND z < middle + 0.2::DOUBLE END"""


@query(_splat(FLOOR_LEVEL, 100) + " SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py FROM ero")
def r1_floor_plan(spark, d):
    """From the planes' floor height to the closed mask, by the pipeline itself."""
    return pipelines.floor_plan(inputs.cloud(spark, d), _planes(spark, d)).pixels


#: Planes of two of three scans; the third's floor is its lowest point.
SCAN_PLANES = f"(SELECT *, CAST(plane_id % 2 AS VARCHAR) AS scan_id FROM {PLANE_ROWS})"
SCAN_LEVELS = f"""c AS MATERIALIZED (SELECT * FROM {SCANS}), h AS (SELECT scan_id, coalesce(p.h, low) + 1.2::DOUBLE AS h, middle FROM (SELECT scan_id, min(z) AS low, median(z) AS middle FROM c GROUP BY scan_id)
LEFT JOIN (SELECT scan_id, min(abs(d) / sqrt(a*a+b*b+c*c)) AS h FROM {SCAN_PLANES} WHERE c / sqrt(a*a+b*b+c*c) > 0.8 GROUP BY scan_id) p USING (scan_id)),
e AS (SELECT scan_id, h, middle, (SELECT count(*) FROM c WHERE c.scan_id = h.scan_id AND z > h - 0.1::DOUBLE AND z < h + 0.1::DOUBLE) >= 100 AS enough FROM h),
s AS MATERIALIZED (SELECT scan_id, x, y FROM c JOIN e USING (scan_id) WHERE CASE WHEN enough THEN z > h - 0.1::DOUBLE AND z < h + 0.1::DOUBLE ELSE z > middle - 0.2::DOUBLE AND z < middle + 0.2::DOUBLE END),
m AS MATERIALIZED (SELECT scan_id, min(x)-0.5 AS x0, max(y)+0.5 AS y1, CAST(trunc((max(x)+0.5-(min(x)-0.5))*20) AS INT) AS w, CAST(trunc((max(y)+0.5-(min(y)-0.5))*20) AS INT) AS h FROM s GROUP BY scan_id),
p AS (SELECT DISTINCT scan_id, w, h, CAST(trunc((x-x0)*20) AS INT) AS px, CAST(trunc((y1-y)*20) AS INT) AS py FROM s JOIN m USING (scan_id)), box AS (SELECT a.k AS dx, b.k AS dy FROM range(-2, 3) a(k), range(-2, 3) b(k)),
q AS (SELECT DISTINCT scan_id, w, h, px+dx AS px, py+dy AS py FROM p, box WHERE dx*dx+dy*dy <= 4 AND px >= 0 AND px < w AND py >= 0 AND py < h AND px+dx >= 0 AND px+dx < w AND py+dy >= 0 AND py+dy < h),
dil AS (SELECT DISTINCT scan_id, w, h, px+dx AS px, py+dy AS py FROM q, box WHERE px+dx >= 0 AND px+dx < w AND py+dy >= 0 AND py+dy < h),
ero AS MATERIALIZED (SELECT scan_id, CAST(px+dx AS INT) AS px, CAST(py+dy AS INT) AS py FROM dil, box WHERE px+dx >= 0 AND px+dx < w AND py+dy >= 0 AND py+dy < h GROUP BY scan_id, px+dx, py+dy HAVING count(*) = any_value((least(px+dx+2, w-1)-greatest(px+dx-2, 0)+1)*(least(py+dy+2, h-1)-greatest(py+dy-2, 0)+1)))"""


def _scan_plans(spark, d):
    from ..config import FloorConfig

    found = _planes(spark, d).withColumn("scan_id", (F.col("plane_id") % 2).cast("string"))
    return pipelines.floor_plan(inputs.scans(spark, d), found, FloorConfig(pixels_per_metre=20), by=["scan_id"])


@query(f"WITH {SCAN_LEVELS} SELECT scan_id, px, py FROM ero")
def r1_floor_plans_of_scans(spark, d):
    """The closed masks of three scans in one job, each above its own floor."""
    return _scan_plans(spark, d).pixels


@query(f"WITH {SCAN_LEVELS} SELECT scan_id, px, py FROM ero a WHERE (SELECT count(*) FROM ero b WHERE a.scan_id = b.scan_id AND abs(a.px-b.px)+abs(a.py-b.py) = 1) < 4")
def r4_boundaries_of_scans(spark, d):
    return _scan_plans(spark, d).outline


def _plan(spark, d):
    level = cloud.open_slice(inputs.cloud(spark, d), 1.0, 0.1)
    meta = raster.blueprint_meta(level, resolution=20)
    return level, meta


@query(SPLAT + " SELECT px, py FROM q")
def r2_m14_f9_disc_splat(spark, d):
    return raster.splat(*_plan(spark, d))


@query(SPLAT + " SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py FROM ero")
def r3_j9_closed_plan(spark, d):
    level, meta = _plan(spark, d)
    return raster.close(raster.splat(level, meta), meta)


@query(SPLAT + " SELECT px, py FROM q a WHERE (SELECT count(*) FROM q b WHERE abs(a.px-b.px)+abs(a.py-b.py) = 1) < 4")
def r4_mask_boundary(spark, d):
    return raster.boundary(raster.splat(*_plan(spark, d)))


SPOTS = "(SELECT DISTINCT CAST((o_custkey * 31 + o_orderkey // 7) % 997 AS INT) AS px, CAST(o_orderkey % 991 AS INT) AS py FROM orders)"


def _spots(spark, d):
    """All orders as set pixels of a wide mask."""
    return inputs.read(spark, d, "orders").select(F.expr("cast((o_custkey * 31 + o_orderkey div 7) % 997 as int)").alias("px"), (F.col("o_orderkey") % 991).cast("int").alias("py")).distinct()


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, py::BIGINT * 2147483648 + px AS id FROM {SPOTS}), near AS MATERIALIZED (SELECT a.id AS i, b.id AS o FROM s a, range(-1, 2) dx(k), range(-1, 2) dy(k), s b WHERE b.px = a.px + dx.k AND b.py = a.py + dy.k),
c(id, comp) USING KEY (id) AS (SELECT id, id FROM s UNION SELECT n.i, min(b.comp) FROM c b JOIN near n ON n.o = b.id JOIN recurring.c a ON a.id = n.i WHERE b.comp < a.comp GROUP BY n.i) SELECT px, py, comp FROM c JOIN s USING (id)""")
def r5_components(spark, d):
    return raster.components(_spots(spark, d)).select("px", "py", "comp")


#: Sides of set pixels with the region on the right hand, each with the side that goes on from its end.
SIDES = f"""s AS MATERIALIZED (SELECT DISTINCT px::BIGINT AS px, py::BIGINT AS py FROM q), b AS MATERIALIZED (
SELECT px AS x, py AS y, px + 1 AS tx, py AS ty, 0 AS d FROM s ANTI JOIN (SELECT px, py + 1 AS py FROM s) o USING (px, py) UNION ALL SELECT px + 1, py, px + 1, py + 1, 1 FROM s ANTI JOIN (SELECT px - 1 AS px, py FROM s) o USING (px, py)
UNION ALL SELECT px + 1, py + 1, px, py + 1, 2 FROM s ANTI JOIN (SELECT px, py - 1 AS py FROM s) o USING (px, py) UNION ALL SELECT px, py + 1, px, py, 3 FROM s ANTI JOIN (SELECT px + 1 AS px, py FROM s) o USING (px, py)),
e AS MATERIALIZED (SELECT a.*, (a.y * 2147483648 + a.x) * 4 + a.d AS id, (n.y * 2147483648 + n.x) * 4 + n.d AS nid, n.d AS nd FROM b a JOIN b n ON n.x = a.tx AND n.y = a.ty QUALIFY row_number() OVER (PARTITION BY a.x, a.y, a.d ORDER BY (n.d = (a.d + 3) % 4) DESC) = 1),
w(ring, id, k) AS (SELECT id, nid, 1 FROM e UNION ALL SELECT ring, e.nid, k + 1 FROM w JOIN e ON e.id = w.id WHERE w.id > ring),
r AS MATERIALIZED (SELECT ring, k AS n FROM w WHERE id = ring),
v AS (SELECT r.ring, w.id, w.k % r.n AS seq FROM r JOIN w USING (ring)),
z AS (SELECT ring, sum(x * ty - tx * y) AS area FROM v JOIN e USING (id) GROUP BY ring)"""


@query(SPLAT.replace("WITH s AS", "WITH RECURSIVE s_ AS", 1).replace("FROM s)", "FROM s_)").replace("FROM s, m)", "FROM s_, m)") + f", {SIDES} SELECT v.ring, CAST(v.seq AS BIGINT) AS seq, e.x, e.y, area < 0 AS inner FROM v JOIN e USING (id) JOIN e l ON l.nid = e.id JOIN z USING (ring) WHERE l.d <> e.d")
def r5_r6_outlines(spark, d):
    """The corners of all outlines of the floor plan's mask in order, holes too."""
    return raster.outlines(raster.splat(*_plan(spark, d)))


def _sobel(weights, sign: str) -> str:
    return " + ".join(f"{w} * coalesce({sign}{i}{j}.level, 0)" for j in range(3) for i, w in enumerate(weights[j]) if w)


GREY = "(SELECT px, py, least(255, count(*) * 60) AS level FROM (SELECT CAST(l_orderkey % 160 AS INT) AS px, CAST(l_partkey % 120 AS INT) AS py FROM lineitem WHERE l_quantity < 20) GROUP BY px, py)"


def _grey(spark, d):
    l = inputs.read(spark, d, "lineitem").where("l_quantity < 20")
    cells = l.select((F.col("l_orderkey") % 160).cast("int").alias("px"), (F.col("l_partkey") % 120).cast("int").alias("py"))
    return cells.groupBy("px", "py").agg(F.least(F.lit(255), F.count("*") * 60).cast("int").alias("level"))


@query(f"""WITH RECURSIVE g AS MATERIALIZED (SELECT * FROM {GREY}), a AS (SELECT CAST(x.k AS INT) AS px, CAST(y.k AS INT) AS py FROM range(160) x(k), range(120) y(k)),
k AS MATERIALIZED (SELECT a.px, a.py, {' + '.join(f'{w} * coalesce(g{i}{j}.level, 0)' for j, row in enumerate(raster.SOBEL_X) for i, w in enumerate(row) if w)} AS gx, {' + '.join(f'{w} * coalesce(g{i}{j}.level, 0)' for j, row in enumerate(raster.SOBEL_Y) for i, w in enumerate(row) if w)} AS gy FROM a
{' '.join(f'LEFT JOIN g g{i}{j} ON g{i}{j}.px = greatest(0, least(159, a.px + {i - 1})) AND g{i}{j}.py = greatest(0, least(119, a.py + {j - 1}))' for i in range(3) for j in range(3) if (i, j) != (1, 1))}),
m AS MATERIALIZED (SELECT *, abs(gx) + abs(gy) AS size FROM k),
t AS MATERIALIZED (SELECT m.px, m.py, m.size FROM m {' '.join(f'LEFT JOIN m m{i}{j} ON m{i}{j}.px = m.px + {i - 1} AND m{i}{j}.py = m.py + {j - 1}' for i in range(3) for j in range(3) if (i, j) != (1, 1))} WHERE m.size > 50 AND
    CASE WHEN abs(m.gy) * 32768 < abs(m.gx) * {raster.TANGENT} THEN m.size > coalesce(m01.size, 0) AND m.size >= coalesce(m21.size, 0) WHEN abs(m.gy) * 32768 > abs(m.gx) * {raster.TANGENT} + abs(m.gx) * 65536 THEN m.size > coalesce(m10.size, 0) AND m.size >= coalesce(m12.size, 0)
    WHEN m.gx * m.gy >= 0 THEN m.size > coalesce(m00.size, 0) AND m.size > coalesce(m22.size, 0) ELSE m.size > coalesce(m20.size, 0) AND m.size > coalesce(m02.size, 0) END),
c(px, py) AS (SELECT px, py FROM t WHERE size > 150 UNION SELECT t.px, t.py FROM c JOIN t ON t.px BETWEEN c.px - 1 AND c.px + 1 AND t.py BETWEEN c.py - 1 AND c.py + 1) SELECT px, py FROM c""")
def r4_edge_image(spark, d):
    """Thin edges of a grey image: how many lineitems fall on each pixel."""
    return raster.edge_image(_grey(spark, d), 160, 120)


#: The free cells of three scans' grids, without a margin; a scan starts from all free cells of its first column.
SCAN_GRIDS = f"""s AS (SELECT scan_id, x, y FROM {SCANS} WHERE z BETWEEN 1.0::DOUBLE - 0.3::DOUBLE AND 1.0::DOUBLE + 0.3::DOUBLE AND point_id % 3 = 0),
i AS MATERIALIZED (SELECT scan_id, min(x) AS x0, min(y) AS y0, greatest(1, CAST(ceil((max(x)-min(x))/0.1::DOUBLE) AS INT)) AS nx, greatest(1, CAST(ceil((max(y)-min(y))/0.1::DOUBLE) AS INT)) AS ny FROM s GROUP BY scan_id),
o AS MATERIALIZED (SELECT DISTINCT s.scan_id, greatest(0, least(nx-1, CAST(trunc((x-x0)/0.1::DOUBLE) AS INT))) AS gx, greatest(0, least(ny-1, CAST(trunc((y-y0)/0.1::DOUBLE) AS INT))) AS gy FROM s JOIN i ON i.scan_id = s.scan_id),
f AS MATERIALIZED (SELECT * FROM (SELECT i.scan_id, CAST(a.k AS INT) AS gx, CAST(b.k AS INT) AS gy FROM i, range(1000) a(k), range(1000) b(k) WHERE a.k < nx AND b.k < ny) ANTI JOIN o USING (scan_id, gx, gy))"""
SCAN_COSTS = """reach(scan_id, gx, gy, cost) USING KEY (scan_id, gx, gy) AS (SELECT scan_id, gx, gy, 0.0::DOUBLE FROM f WHERE gx = 0 UNION SELECT n.scan_id, n.gx, n.gy, min(n.cost) FROM
(SELECT f.scan_id, f.gx, f.gy, c.cost + sqrt((f.gx-c.gx)*(f.gx-c.gx)+(f.gy-c.gy)*(f.gy-c.gy)) AS cost FROM reach c, range(-1, 2) dx(k), range(-1, 2) dy(k), f WHERE f.scan_id = c.scan_id AND f.gx = c.gx + dx.k AND f.gy = c.gy + dy.k AND (dx.k <> 0 OR dy.k <> 0)) n
LEFT JOIN recurring.reach o ON o.scan_id = n.scan_id AND o.gx = n.gx AND o.gy = n.gy WHERE o.cost IS NULL OR n.cost < o.cost - 1e-9 GROUP BY n.scan_id, n.gx, n.gy)"""
SCAN_FIELD = """p AS MATERIALIZED (SELECT r.scan_id, r.gx, r.gy, any_value(r.cost) AS cost, min(ROW(round(b.cost + sqrt((b.gx-r.gx)*(b.gx-r.gx)+(b.gy-r.gy)*(b.gy-r.gy)), 6), b.gx, b.gy)::STRUCT(c DOUBLE, x INT, y INT)) AS b FROM reach r LEFT JOIN (SELECT b.*, b.gx + dx.k AS ax, b.gy + dy.k AS ay FROM reach b, range(-1, 2) dx(k), range(-1, 2) dy(k) WHERE dx.k <> 0 OR dy.k <> 0) b
ON b.scan_id = r.scan_id AND b.ax = r.gx AND b.ay = r.gy GROUP BY r.scan_id, r.gx, r.gy)"""


def _scan_grids(spark, d):
    points = inputs.scans(spark, d).where("point_id % 3 = 0")
    return raster.occupancy(points, margin=0, by=["scan_id"])


def _scan_field(spark, d):
    free = durable(raster.free_cells(*_scan_grids(spark, d), by=["scan_id"]), "free")
    return planning.cost_fields(free, free.where("gx = 0"))


@query(f"WITH {SCAN_GRIDS} SELECT i.scan_id, CAST(count(o.gx) AS BIGINT) AS n_occupied, CAST(any_value(nx) * any_value(ny) AS BIGINT) AS n_cells, round(count(o.gx) * 100.0 / (any_value(nx) * any_value(ny)), 6) + 0.0 AS percent FROM i LEFT JOIN o USING (scan_id) GROUP BY i.scan_id")
def a13_occupancy_ratio(spark, d):
    return rounded(raster.occupancy_ratio(*_scan_grids(spark, d), by=["scan_id"]), "percent")


@query(f"WITH {SCAN_GRIDS} SELECT scan_id, gx, gy, round(gx * 0.1::DOUBLE + x0, 6) + 0.0 AS x, round(gy * 0.1::DOUBLE + y0, 6) + 0.0 AS y FROM f JOIN i USING (scan_id)")
def r9_f8_m16_free_cells(spark, d):
    occ, info = _scan_grids(spark, d)
    cells = raster.free_cells(occ, info, by=["scan_id"]).join(info, "scan_id")
    return rounded(cells.select("scan_id", "gx", "gy", *(g.from_cell(f"g{a}", f"{a}0", F.col("resolution")).alias(a) for a in "xy")), "x", "y")


@query(f"WITH RECURSIVE {SCAN_GRIDS}, {SCAN_COSTS}, {SCAN_FIELD} SELECT scan_id, gx, gy, round(cost, 6) + 0.0 AS cost, CASE WHEN cost > 0 THEN b.x END AS from_x, CASE WHEN cost > 0 THEN b.y END AS from_y FROM p")
def n1_j8_u6_cost_field(spark, d):
    """The cost fields of three scans' grids in one job, each from its first column."""
    return rounded(_scan_field(spark, d), "cost")


@query(f"""WITH RECURSIVE {SCAN_GRIDS}, {SCAN_COSTS}, {SCAN_FIELD}, t AS (SELECT scan_id, max((gx, gy)) AS p FROM p GROUP BY scan_id),
w(scan_id, goal_x, goal_y, gx, gy, back) AS (SELECT p.scan_id, gx, gy, gx, gy, 0 FROM p JOIN t ON t.scan_id = p.scan_id AND (gx, gy) = t.p UNION ALL SELECT w.scan_id, goal_x, goal_y, p.b.x, p.b.y, back + 1 FROM w JOIN p ON p.scan_id = w.scan_id AND p.gx = w.gx AND p.gy = w.gy WHERE p.cost > 0)
SELECT scan_id, goal_x, goal_y, CAST(max(back) OVER (PARTITION BY scan_id) - back AS BIGINT) AS seq, gx, gy FROM w""")
def n2_paths_of_scans(spark, d):
    """The cheapest paths of three scans, from the first column to the last cell that is reached."""
    field = _scan_field(spark, d)
    goals = field.groupBy("scan_id").agg(F.max(F.struct("gx", "gy")).alias("p")).select("scan_id", "p.*")
    return planning.field_paths(field, goals)


WALLED = "f AS MATERIALIZED (SELECT CAST(i // 12 AS INT) AS gx, CAST(i % 12 AS INT) AS gy FROM range(144) t(i) WHERE NOT (i // 12 = 6 AND i % 12 < 10))"


def _planned(spark, d, points=None):
    """Three scans' points (the third of them that SCAN_GRIDS takes, where none are given), a path asked for from each
    grid's first free cell to its last, and the grids, without a margin."""
    from ..config import GridConfig

    points = inputs.scans(spark, d).where("point_id % 3 = 0") if points is None else points
    config = GridConfig(margin=0)
    occ, info = made = pipelines.grids(points, config)
    ends = raster.free_cells(occ, info, by=["scan_id"]).groupBy("scan_id").agg(F.min(F.struct("gx", "gy")).alias("a"), F.max(F.struct("gx", "gy")).alias("b")).join(info, "scan_id")
    place = lambda end, a: F.col(f"{a}0") + (F.col(f"{end}.g{a}") + 0.5) * F.col("resolution")
    ends = durable(ends.select("scan_id", place("a", "x").alias("start_x"), place("a", "y").alias("start_y"), place("b", "x").alias("goal_x"), place("b", "y").alias("goal_y")), "ends")
    return points, ends, config, made


SCAN_ENDS = "m AS (SELECT scan_id, arg_min(gx, (gx, gy)) AS sx, arg_min(gy, (gx, gy)) AS sy, arg_max(gx, (gx, gy)) AS tx, arg_max(gy, (gx, gy)) AS ty FROM f GROUP BY scan_id)"


@query(f"WITH RECURSIVE {SCAN_GRIDS}, {SCAN_ENDS}, " + SCAN_COSTS.replace("FROM f WHERE gx = 0 UNION", "FROM f JOIN m USING (scan_id) WHERE gx = sx AND gy = sy UNION") + """ SELECT m.scan_id, CASE WHEN cost IS NULL THEN 'no_path' ELSE 'ok' END AS status, cost IS NOT NULL AS success, round(cost, 6) + 0.0 AS path_cost_cells,
(SELECT CAST(count(*) AS BIGINT) FROM reach r WHERE r.scan_id = m.scan_id AND (g.cost IS NULL OR r.cost + sqrt((r.gx-tx)*(r.gx-tx)+(r.gy-ty)*(r.gy-ty)) <= g.cost + 1e-9)) AS nodes_explored FROM m LEFT JOIN reach g ON g.scan_id = m.scan_id AND g.gx = tx AND g.gy = ty""")
def n1_n2_n3_n5_a17_planned_scans(spark, d):
    """Occupancy, path and statistics of three scans in one job, by the pipeline itself."""
    return rounded(pipelines.plan_scan(*_planned(spark, d)).statistics.select("scan_id", "status", "success", "path_cost_cells", "nodes_explored"), "path_cost_cells")


@query(f"""WITH {WALLED}, e AS (SELECT event_id, (user_id % 12) + 0.5 AS x1, (event_id % 12) + 0.5 AS y1, ((user_id + event_id) % 12) + 0.5 AS x2, ((event_id * 5) % 12) + 0.5 AS y2 FROM events), s AS (SELECT *, CAST(trunc(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) / 0.5) AS INT) + 1 AS n FROM e),
p AS (SELECT event_id, CAST(trunc(x1 + k / n::DOUBLE * (x2-x1)) AS INT) AS gx, CAST(trunc(y1 + k / n::DOUBLE * (y2-y1)) AS INT) AS gy FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM s))
SELECT event_id AS segment_id, bool_and(f.gx IS NOT NULL) AS clear FROM p LEFT JOIN f ON f.gx = p.gx AND f.gy = p.gy GROUP BY event_id""")
def j10_clear_segments(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    s = inputs.read(spark, d, "events").select(e.alias("segment_id"), (u % 12 + 0.5).alias("x1"), (e % 12 + 0.5).alias("y1"), ((u + e) % 12 + 0.5).alias("x2"), ((e * 5) % 12 + 0.5).alias("y2"))
    info = spark.createDataFrame([(1.0, 0.0, 0.0)], "resolution double, x0 double, y0 double")
    return planning.clear_segments(s, rooms.walled_grid(spark), info)


@query(f"SELECT arg_min(point_id, (sqrt((x-0.1)*(x-0.1)+(y-0.1)*(y-0.1)), point_id)) AS node_id, round(min(sqrt((x-0.1)*(x-0.1)+(y-0.1)*(y-0.1))), 9) + 0.0 AS distance FROM {IDENTIFIED}")
def j6_m17_nearest_node(spark, d):
    return rounded(planning.nearest_node(inputs.identified(spark, d).withColumnRenamed("point_id", "node_id"), 0.1, 0.1), "distance", digits=9)


@query()
def n4_n6_r13_demonstration(spark, d):
    """Cheapest paths and random trees of three scans side by side; trees are checked by their properties in tests."""
    points, ends, config, made = _planned(spark, d)
    return pipelines.demonstration(points, ends, config, made=made)


@query()
def r10_path_overlay(spark, d):
    """The paths of three scans, whose grids hold all of their points, drawn on one floor plan."""
    points, ends, config, made = _planned(spark, d, inputs.scans(spark, d))
    paths = pipelines.plan_scan(points, ends, config, made).paths.where("status = 'ok'")
    return planning.overlay_pixels(paths, raster.blueprint_meta(cloud.closed_slice(points, 1.0, 0.3)))


@query(f"SELECT q.frame_id, q.u, q.v, round((q.u * 4 % 256) / 255.0::DOUBLE, 6) + 0.0 AS r, round((q.v * 5 % 256) / 255.0::DOUBLE, 6) + 0.0 AS g, round((q.u + q.v) / 255.0::DOUBLE, 6) + 0.0 AS b FROM {PIXELS} q WHERE depth < 8")
def m3_colour_lookup(spark, d):
    seen = inputs.pixels(spark, d).where("depth < 8").select("frame_id", "u", "v")
    image = spark.range(25 * 64 * 48).select(F.expr("id div 3072").cast("int").alias("frame_id"), F.expr("(id div 48) % 64").cast("int").alias("u"), (F.col("id") % 48).cast("int").alias("v"))
    image = image.withColumns({"r": F.col("u") * 4 % 256, "g": F.col("v") * 5 % 256, "b": F.col("u") + F.col("v")})
    return rounded(frames.with_colour(seen, image), "r", "g", "b")


@query()
def w7_aligned_frames(spark, d):
    p = inputs.identified(spark, d)
    shifted = p.withColumns({"x": F.col("x") + 0.01, "y": F.col("y") - 0.01})
    both = p.withColumn("frame_id", F.lit(0)).unionByName(shifted.withColumn("frame_id", F.lit(1)))
    from ..config import ScanConfig

    return rounded(pipelines.align(both, ScanConfig(normal_radius=0.3, icp_distance=0.05), rounds=3), "x", "y", "z")


@query()
def p6_fused_scan(spark, d):
    pixels = inputs.pixels(spark, d).withColumn("scan_id", F.lit("s"))
    poses = inputs.poses(spark, d).withColumn("scan_id", F.lit("s"))
    return rounded(pipelines.fuse(pixels, poses, inputs_config()).select("x", "y", "z"), "x", "y", "z")


def inputs_config():
    from ..config import ScanConfig

    return ScanConfig(voxel=0.5, outlier_neighbours=8)


# ---- streams

def _arriving(df: DataFrame, name: str, files: int, key: str, each: int) -> DataFrame:
    """df as a stream whose rows arrive in files dealt by a key, so out of order, `each` files to a micro-batch."""
    path = _fresh(df.sparkSession, name)
    df.repartition(files, key).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


@query(SQL["w1_keyframes"])
def w1_streamed_keyframes(spark, d):
    """Keyframes of all scans, whose frames arrive out of order over several micro-batches."""
    arriving = _arriving(inputs.walks(spark, d), "arriving", 6, "frame_id", 2)
    return streams.appended(streams.keyframes(arriving), "streamed-keyframes").select("scan_id", F.col("frame_id").cast("int").alias("frame_id"))


def _streamed_cloud(spark, d):
    """The cloud as a stream, and as it is for the facts that a stream has to be told."""
    whole = inputs.cloud(spark, d).select("x", "y", "z")
    return _arriving(whole, "arriving", 6, "x", 2), whole


@query(SQL["a3_voxels"])
def a3_streamed_voxels(spark, d):
    """Voxel means kept while points arrive, after the last micro-batch."""
    arriving, whole = _streamed_cloud(spark, d)
    origin = durable(whole.agg(*(F.min(a).alias(f"{a}0") for a in "xyz")), "origin")
    return rounded(streams.latest(streams.voxel_means(arriving, origin, 0.25), ["vx", "vy", "vz"], "streamed-voxels"), "x", "y", "z", digits=9)


@query(f"""WITH i AS (SELECT min(x) AS x0, min(y) AS y0, greatest(1, CAST(ceil((max(x)-min(x))/0.1::DOUBLE) AS INT)) AS nx, greatest(1, CAST(ceil((max(y)-min(y))/0.1::DOUBLE) AS INT)) AS ny FROM {CLOUD})
SELECT DISTINCT greatest(0, least(nx-1, CAST(trunc((x-x0)/0.1::DOUBLE) AS INT))) AS gx, greatest(0, least(ny-1, CAST(trunc((y-y0)/0.1::DOUBLE) AS INT))) AS gy FROM {CLOUD}, i""")
def a14_streamed_cells(spark, d):
    """Grid cells in the order in which points first fall into them; each once, over several micro-batches."""
    arriving, whole = _streamed_cloud(spark, d)
    return streams.appended(streams.occupied_cells(arriving, durable(raster.grid_info(whole), "grid")), "streamed-cells")


# ---- files

def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""SELECT CAST(frame_id AS INT) AS frame_id, 'images/' || lpad(CAST(frame_id AS VARCHAR), 5, '0') || '.jpg' AS file_path, CASE WHEN frame_id % 5 <> 0 THEN 'conf/' || lpad(CAST(frame_id AS VARCHAR), 5, '0') || '.npy' END AS confidence_path, r00, r01, r10, r11, {r('tx', 'ty', 'tz')}, fx, fy, cx, cy FROM {POSES}""")
def s8_s9_transforms_file(spark, d):
    path = _fresh(spark, "transforms")
    scan_files.write_transforms(inputs.poses(spark, d).withColumn("has_conf", F.col("frame_id") % 5 != 0), path, 64, 48)
    out = scan_files.read_transforms(spark, path).select("frame_id", "file_path", "confidence_path", "r00", "r01", "r10", "r11", "tx", "ty", "tz", "fx", "fy", "cx", "cy")
    return rounded(out, "tx", "ty", "tz")


@query(f"SELECT {r('x', 'y', 'z', digits=9)} FROM {IDENTIFIED}")
def s11_s12_ply_file(spark, d):
    path = _fresh(spark, "cloud.ply")
    scan_files.write_ply(inputs.identified(spark, d), path)
    return rounded(scan_files.first_cloud(spark, [path + "-none", path]), "x", "y", "z", digits=9)


@query(f"SELECT t.face_id, {r('a.z', digits=6)} FROM {TRIANGLES} t JOIN {VERTICES} a ON a.vertex_id = t.v0")
def s13_mesh_file(spark, d):
    path = _fresh(spark, "mesh")
    scan_files.write_mesh(*_field(spark, d), path)
    v, t = scan_files.read_mesh(spark, path)
    return rounded(t.join(v.select(F.col("vertex_id").alias("v0"), "z").hint("merge"), "v0").select("face_id", "z"), "z")


@query(f"SELECT frame_id, u, v, {r('depth', 'conf')} FROM {PIXELS} WHERE frame_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def s6_s7_depth_files(spark, d):
    """The pixels of the keyframes (nation's in three regions), read from files of which other frames' are pruned."""
    path = _fresh(spark, "depth")
    scan_files.write_depth(inputs.pixels(spark, d).withColumn("scan_id", F.lit("s")), path)
    kept = inputs.read(spark, d, "nation").where("n_regionkey < 3").select(F.lit("s").alias("scan_id"), F.col("n_nationkey").cast("int").alias("frame_id"))
    return rounded(scan_files.read_depth(spark, path, kept).select("frame_id", "u", "v", "depth", "conf"), "depth", "conf")


@query(f"""SELECT d.frame_id, d.u, d.v, {r('d.depth', 'c.conf')} FROM (SELECT frame_id, u, v, min(depth) AS depth FROM {PIXELS} GROUP BY ALL) d LEFT JOIN (SELECT frame_id, u, v, max(conf) AS conf FROM {PIXELS} WHERE conf IS NOT NULL GROUP BY ALL) c
ON c.frame_id = d.frame_id AND c.u = d.u AND c.v = d.v WHERE depth > 0 AND depth < 8 AND (conf IS NULL OR conf > 0.5)""")
def j1_f1_missing_confidence(spark, d):
    """Depth maps joined to the confidence maps that exist; a frame without one keeps its pixels."""
    p = inputs.pixels(spark, d)
    depth = p.groupBy("frame_id", "u", "v").agg(F.min("depth").alias("depth"))
    conf = p.where("conf is not null").groupBy("frame_id", "u", "v").agg(F.max("conf").alias("conf"))
    return rounded(frames.valid_pixels(scan_files.with_confidence(depth, conf, ["frame_id", "u", "v"])), "depth", "conf")


# ---- many scans in one job, images, the hook for models

MANY = "(SELECT CAST(user_id AS VARCHAR) AS scan_id, value / 100::DOUBLE AS x, (event_id % 97) / 10.0::DOUBLE AS y, (event_id % 5) / 4.0::DOUBLE AS z FROM events)"


def _many(spark, d):
    e = F.col("event_id")
    return inputs.read(spark, d, "events").select(F.col("user_id").cast("string").alias("scan_id"), (F.col("value") / g.real(100)).alias("x"), ((e % 97) / g.real(10)).alias("y"), ((e % 5) / g.real(4)).alias("z"))


@query(f"""WITH s AS (SELECT scan_id, x, y FROM {MANY} WHERE z BETWEEN 1.0::DOUBLE - 0.3::DOUBLE AND 1.0::DOUBLE + 0.3::DOUBLE),
i AS (SELECT scan_id, min(x) AS x0, min(y) AS y0, greatest(1, CAST(ceil((max(x)-min(x))/0.1::DOUBLE) AS INT)) AS nx, greatest(1, CAST(ceil((max(y)-min(y))/0.1::DOUBLE) AS INT)) AS ny FROM s GROUP BY scan_id),
c AS (SELECT DISTINCT s.scan_id, greatest(0, least(nx-1, CAST(trunc((x-x0)/0.1::DOUBLE) AS INT))) AS gx, greatest(0, least(ny-1, CAST(trunc((y-y0)/0.1::DOUBLE) AS INT))) AS gy FROM s JOIN i ON i.scan_id = s.scan_id)
SELECT DISTINCT c.scan_id, CAST(gx + a.k AS INT) AS gx, CAST(gy + b.k AS INT) AS gy FROM c JOIN i ON i.scan_id = c.scan_id, range(-2, 3) a(k), range(-2, 3) b(k) WHERE gx + a.k >= 0 AND gx + a.k < nx AND gy + b.k >= 0 AND gy + b.k < ny""")
def r7_r8_many_scans(spark, d):
    """The occupancy grids of all users' events at once, each with its own origin and size."""
    return raster.occupancy(_many(spark, d), by=["scan_id"])[0]


def _axis(name: str, have: int, want: int) -> str:
    return f"(SELECT t, k, w FROM (SELECT t, low AS k, 1 - (place - low) AS w FROM (SELECT t, place, CAST(floor(place) AS INT) AS low FROM (SELECT CAST(i AS INT) AS t, least(greatest((i + 0.5::DOUBLE) * ({have}::DOUBLE / {want}) - 0.5, 0.0), {have} - 1.0::DOUBLE) AS place FROM range({want}) r(i))) UNION ALL SELECT t, least(low + 1, {have - 1}), place - low FROM (SELECT t, place, CAST(floor(place) AS INT) AS low FROM (SELECT CAST(i AS INT) AS t, least(greatest((i + 0.5::DOUBLE) * ({have}::DOUBLE / {want}) - 0.5, 0.0), {have} - 1.0::DOUBLE) AS place FROM range({want}) r(i)))) WHERE w > 0) {name}"


@query(f"SELECT frame_id, a.t AS u, b.t AS v, round(sum(depth * (a.w * b.w)) / sum(a.w * b.w), 6) + 0.0 AS depth FROM (SELECT frame_id, u, v, min(depth) AS depth FROM {PIXELS} GROUP BY ALL) p JOIN {_axis('a', 64, 40)} ON a.k = p.u JOIN {_axis('b', 48, 100)} ON b.k = p.v GROUP BY ALL")
def m20_resize(spark, d):
    depth = inputs.pixels(spark, d).groupBy("frame_id", "u", "v").agg(F.min("depth").alias("depth"))
    return rounded(images.resize(depth, (64, 48), (40, 100), ("depth",), ("frame_id",)), "depth")


IMAGE = "(SELECT DISTINCT CAST(l_returnflag AS VARCHAR) AS scan_id, CAST(l_suppkey % 25 AS INT) AS frame_id, CAST(l_partkey % 64 AS INT) AS u, CAST(l_orderkey % 48 AS INT) AS v FROM lineitem)"


@query(f"""SELECT scan_id, frame_id, CAST(a.k AS INT) AS u, CAST(b.k AS INT) AS v, round(CASE WHEN i.u IS NULL THEN 0 ELSE a.k * 4 % 256 END / 32.0::DOUBLE, 6) + 0.0 AS depth, round(CASE WHEN i.u IS NULL THEN 0 ELSE b.k * 5 % 256 END / 255.0::DOUBLE, 6) + 0.0 AS conf
FROM (SELECT scan_id, frame_id, max(u) AS w, max(v) AS h FROM {IMAGE} GROUP BY ALL) m JOIN range(64) a(k) ON a.k <= w JOIN range(48) b(k) ON b.k <= h LEFT JOIN {IMAGE} i USING (scan_id, frame_id) WHERE (i.u = a.k AND i.v = b.k)
UNION ALL SELECT m.scan_id, m.frame_id, CAST(a.k AS INT), CAST(b.k AS INT), 0.0, 0.0 FROM (SELECT scan_id, frame_id, max(u) AS w, max(v) AS h FROM {IMAGE} GROUP BY ALL) m JOIN range(64) a(k) ON a.k <= w JOIN range(48) b(k) ON b.k <= h
ANTI JOIN {IMAGE} i ON i.scan_id = m.scan_id AND i.frame_id = m.frame_id AND i.u = a.k AND i.v = b.k""")
def s5_inference_hook(spark, d):
    """A stand-in model whose depth is the red and whose confidence the green of an image; scans share frame numbers."""
    l = inputs.read(spark, d, "lineitem")
    image = l.select(F.col("l_returnflag").alias("scan_id"), (F.col("l_suppkey") % 25).cast("int").alias("frame_id"), (F.col("l_partkey") % 64).cast("int").alias("u"), (F.col("l_orderkey") % 48).cast("int").alias("v")).distinct()
    image = image.withColumns({"r": F.col("u") * 4 % 256, "g": F.col("v") * 5 % 256, "b": F.lit(0)})
    return rounded(images.infer(image, lambda rgb: {"depth": rgb[:, :, 0] / 32.0, "conf": rgb[:, :, 1] / 255.0}), "depth", "conf")


@query(f"SELECT plane_id AS id, {r('a', 'c', 'd')}, CASE WHEN angle < 15 THEN 'floor/ceiling' WHEN angle > 75 THEN 'wall' ELSE 'sloped' END AS type FROM (SELECT *, degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, abs(c / sqrt(a*a+b*b+c*c)))))) AS angle FROM {PLANE_ROWS})")
def s14_planes_file(spark, d):
    path = _fresh(spark, "planes")
    scan_files.write_json(scan_files.planes_document(planes.classify(_planes(spark, d)).withColumn("num_points", F.lit(1))), path)
    p = scan_files.read_json(spark, path, scan_files.PLANES).select(F.explode("planes").alias("p"))
    return rounded(p.select(F.col("p.id").cast("long").alias("id"), F.col("p.normal")[0].alias("a"), F.col("p.normal")[2].alias("c"), F.col("p.distance").alias("d"), "p.type"), "a", "c", "d")


@query(f"""SELECT CAST(20 AS INT) AS resolution, {r('x_min', 'x_max', 'y_min', 'y_max')}, CAST(trunc((x_max-x_min)*20) AS INT) AS img_width, CAST(trunc((y_max-y_min)*20) AS INT) AS img_height FROM (SELECT min(x)-0.5 AS x_min, max(x)+0.5 AS x_max, min(y)-0.5 AS y_min, max(y)+0.5 AS y_max FROM {CLOUD} WHERE z > 0.9 AND z < 1.1)""")
def s15_blueprint_meta_file(spark, d):
    path = _fresh(spark, "meta")
    scan_files.write_json(_plan(spark, d)[1], path)
    return rounded(scan_files.read_json(spark, path, scan_files.META), "x_min", "x_max", "y_min", "y_max")


@query(f"WITH RECURSIVE {SCAN_GRIDS}, {SCAN_ENDS}, " + SCAN_COSTS.replace("FROM f WHERE gx = 0 UNION", "FROM f JOIN m USING (scan_id) WHERE gx = sx AND gy = sy UNION") + """ SELECT m.scan_id, 'A*' AS algorithm, cost IS NOT NULL AS success, round(x0, 6) + 0.0 AS x0, CAST(nx AS INT) AS nx, CAST(ny AS INT) AS ny FROM m JOIN i USING (scan_id) LEFT JOIN reach g ON g.scan_id = m.scan_id AND g.gx = tx AND g.gy = ty""")
def s16_path_files(spark, d):
    """A document for each scan with its own grid, written and read again."""
    planned = pipelines.plan_scan(*_planned(spark, d))
    path = _fresh(spark, "path")
    scan_files.write_json(scan_files.path_document(planned.paths, planned.statistics, planned.info), path)
    schema = "scan_id string, algorithm string, path array<array<double>>, statistics struct<success:boolean>, grid_info struct<origin:array<double>, size:array<int>>"
    back = scan_files.read_json(spark, path, schema, lines=True).select("scan_id", "algorithm", "statistics.success", F.col("grid_info.origin")[0].alias("x0"), F.col("grid_info.size")[0].alias("nx"), F.col("grid_info.size")[1].alias("ny"))
    return rounded(back, "x0")
