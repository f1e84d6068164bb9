"""Files of a scan: frame metadata as JSON, depth maps, ASCII PLY, planes, floor-plan facts, paths, status.

Everything is read and written by Spark's own readers and committers, so it works in any store Spark knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..iterate import durable

FRAME = "struct<file_path:string,transform_matrix:array<array<double>>,intrinsic_matrix:array<array<double>>,depth_path:string,confidence_path:string>"
TRANSFORMS = f"camera_model string, width int, height int, frames array<{FRAME}>"
PLANES = "planes array<struct<id:int,type:string,normal:array<double>,distance:double,equation:array<double>,num_points:long>>"
META = "resolution int, x_min double, x_max double, y_min double, y_max double, img_width int, img_height int"
STATUS = "session_id string, seq long, status string, detail string, outputs map<string,string>"


def transforms(poses: DataFrame, width: int, height: int) -> DataFrame:
    """The metadata document of one scan, from poses with intrinsics (one row, frames in order)."""
    row = lambda i: F.array(*(F.col(f"r{i}{j}") for j in range(3)), F.col(("tx", "ty", "tz")[i]))
    matrix = F.array(row(0), row(1), row(2), F.array(*map(g.real, (0, 0, 0, 1))))
    k = F.array(F.array(F.col("fx"), g.real(0), F.col("cx")), F.array(g.real(0), F.col("fy"), F.col("cy")), F.array(*map(g.real, (0, 0, 1))))
    name = g.padded("frame_id")
    frame = F.struct(
        F.concat(F.lit("images/"), name, F.lit(".jpg")).alias("file_path"), matrix.alias("transform_matrix"), k.alias("intrinsic_matrix"),
        F.concat(F.lit("depth/"), name, F.lit(".npy")).alias("depth_path"),
        F.when(F.col("has_conf"), F.concat(F.lit("conf/"), name, F.lit(".npy"))).alias("confidence_path"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_id", frame.alias("f")))), lambda x: x["f"])
    return poses.agg(F.lit("PINHOLE").alias("camera_model"), F.lit(width).alias("width"), F.lit(height).alias("height"), ordered.alias("frames"))


def write_transforms(poses: DataFrame, path: str, width: int, height: int) -> None:
    document = transforms(poses, width, height)
    document.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """A row for each frame: frame_id, files, pose and intrinsics as flat columns."""
    rows = spark.read.schema(TRANSFORMS).option("multiLine", True).json(path).select("camera_model", "width", "height", F.posexplode("frames").alias("frame_id", "f"))
    m, k = F.col("f.transform_matrix"), F.col("f.intrinsic_matrix")
    pose = [m[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)] + [m[i][3].alias(t) for i, t in enumerate(("tx", "ty", "tz"))]
    inner = [k[0][0].alias("fx"), k[1][1].alias("fy"), k[0][2].alias("cx"), k[1][2].alias("cy")]
    return rows.select("camera_model", "width", "height", "frame_id", "f.file_path", "f.depth_path", "f.confidence_path", *pose, *inner)


def write_depth(pixels: DataFrame, path: str) -> None:
    """Depth and confidence pixels, a folder for each scan and frame, so frame filters prune files."""
    pixels.write.mode("overwrite").partitionBy("scan_id", "frame_id").parquet(path)


def read_depth(spark: SparkSession, path: str, keyframes: DataFrame | None = None) -> DataFrame:
    """Depth pixels; with keyframes(scan_id, frame_id) only theirs (dynamic partition pruning)."""
    pixels = spark.read.parquet(path)
    return pixels if keyframes is None else pixels.join(keyframes.select("scan_id", "frame_id"), ["scan_id", "frame_id"], "left_semi")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, u, v, value) of each pixel of two-dimensional .npy files."""
    import io

    import numpy as np
    import pandas as pd

    def decode(parts):
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
                v, u = np.indices(a.shape)
                yield pd.DataFrame({"path": name, "u": u.ravel().astype("int32"), "v": v.ravel().astype("int32"), "value": a.ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, u int, v int, value double")


def with_confidence(depth: DataFrame, conf: DataFrame, on: list[str]) -> DataFrame:
    """Depth pixels with the confidences of the frames that have them, null elsewhere."""
    return depth.join(conf, on, "left")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df sorted by some columns, with `place` 0, 1, 2, ... in that order: counted part by part, so no task holds all rows.

    Where all of a part's rows are is fixed by writing them first."""
    sorted_parts = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("id", 33)
    counts = sorted_parts.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each part
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return sorted_parts.withColumn("part", part).join(before, "part").withColumn("place", F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).drop("id", "part", "before")


def write_ply(points: DataFrame, path: str, key: str = "point_id", triangles: DataFrame | None = None) -> None:
    """ASCII PLY: the parts in the order of their names are one file, its header first, then the points by key.

    With triangles(face_id, v0, v1, v2) their faces follow, each naming its corners by their places in the file."""
    fields = [c for c in points.columns if c != key]
    at = numbered(points.select(key, *fields), key)
    header = ["ply", "format ascii 1.0", f"element vertex {points.count()}", *(f"property double {c}" for c in fields)]
    line = F.concat_ws(" ", *(F.col(c).cast("double").cast("string") for c in fields))
    body = at.select(F.lit(1).alias("part"), F.col("place").alias("k"), line.alias("value"))
    if triangles is not None:
        header += [f"element face {triangles.count()}", "property list uchar int vertex_indices"]
        corners = triangles.select("face_id", "v0", "v1", "v2")
        for c in ("v0", "v1", "v2"):
            corners = corners.join(at.select(F.col(key).alias(c), F.col("place").alias(f"{c}_place")), c)
        body = body.unionByName(corners.select(F.lit(2).alias("part"), F.col("face_id").cast("long").alias("k"), F.concat_ws(" ", F.lit("3"), *(F.col(f"v{i}_place").cast("string") for i in range(3))).alias("value")))
    head = points.sparkSession.createDataFrame(list(enumerate([*header, "end_header"])), "k long, value string").select(F.lit(0).alias("part"), "k", "value")
    head.unionByName(body).repartitionByRange("part", "k").sortWithinPartitions("part", "k").select("value").write.mode("overwrite").text(path)


_WHOLE_NUMBERS = {"char", "uchar", "short", "ushort", "int", "uint", "int8", "uint8", "int16", "uint16", "int32", "uint32"}


def ply_header(spark: SparkSession, path: str) -> list[tuple[str, int, list[tuple[str, str, bool]]]]:
    """(element, rows, properties) in order; a property is (name, type of its numbers, whether it is a list). Any number of them."""
    words = "^(ply|format|comment|obj_info|element|property|end_header)( |$)"
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    out: list[tuple[str, int, list[tuple[str, str, bool]]]] = []
    for r in lines.where(F.col("value").rlike(words)).orderBy("file", "block", "id").collect():  # the header's lines
        word = r["value"].split()
        if word[0] == "format" and word[1] != "ascii":
            raise ValueError(f"{path} is a PLY of format {word[1]}; only ascii is read")
        if word[0] == "element":
            out.append((word[1], int(word[2]), []))
        elif word[0] == "property":
            out[-1][2].append((word[-1], word[-2], word[1] == "list"))
        elif word[0] == "end_header":
            break
    return out


def read_ply(spark: SparkSession, path: str, element: str = "vertex") -> DataFrame:
    """The rows of an element of an ASCII PLY, columns as its header names them: numbers are double, lists are arrays.

    Lines are numbered block by block (a row for each block is counted), so elements are told apart by their places,
    whatever their lines look like; `place` is the row's place in its element. An element that the header lacks, or
    one of no rows, has no rows."""
    header = ply_header(spark, path)
    first = 0
    for name, rows, properties in header:
        if name == element:
            break
        first += rows
    else:
        rows, properties = 0, []
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    body = lines.where(~F.col("value").rlike("^(ply|format|comment|obj_info|element|property|end_header)( |$)") & (F.trim("value") != ""))
    # the header and blank lines stand before or after a block's other lines, never between them
    counts = body.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    before = counts.select("file", "block", "least", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = body.join(before, ["file", "block"]).select("value", (F.col("before") + F.col("id") - F.col("least") - first).alias("place"))
    own = at.where((F.col("place") >= 0) & (F.col("place") < rows)).withColumn("parts", F.split(F.trim("value"), r"\s+"))
    columns, k = [], F.lit(1)
    for name, kind, is_list in properties:
        if is_list:
            n = F.element_at("parts", k).cast("int")
            item = "bigint" if kind in _WHOLE_NUMBERS else "double"
            columns.append(F.slice("parts", k + 1, n).cast(f"array<{item}>").alias(name))
            k = k + 1 + n
        else:
            columns.append(F.element_at("parts", k).cast("double").alias(name))
            k = k + 1
    return own.select(*columns, "place")


def write_mesh(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    triangles.write.mode("overwrite").parquet(f"{path}/triangles")


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/triangles")


def first_cloud(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several clouds that exists: coloured, filtered, raw."""
    for p in paths:
        try:
            return read_ply(spark, p).drop("place")
        except Exception as e:  # Spark names a missing path only in the message's class
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"none of {paths}")


def planes_document(planes: DataFrame) -> DataFrame:
    """The planes of one scan as one document."""
    plane = F.struct(F.col("plane_id").alias("id"), "type", F.array("a", "b", "c").alias("normal"), F.col("d").alias("distance"), F.array("a", "b", "c", "d").alias("equation"), "num_points")
    return planes.agg(F.array_sort(F.collect_list(plane)).alias("planes"))


def write_json(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """The documents of JSON files: one of any layout for each file, or, as write_json writes several, one for each line."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def path_document(paths: DataFrame, statistics: DataFrame, info: DataFrame) -> DataFrame:
    """Each scan's path with its statistics and grid facts as one document. Where info has a scan_id each scan has its own
    grid; without one all share the single row of info."""
    steps = paths.where("status = 'ok'").groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("path"))
    own = ["scan_id"] if "scan_id" in info.columns else []
    grid = info.select(*own, F.struct("resolution", F.array("x0", "y0").alias("origin"), F.array("nx", "ny").alias("size")).alias("grid_info"))
    stats = F.struct("nodes_explored", "path_length_grid", F.col("path_cost_cells").alias("path_cost"), "algorithm", "success", F.col("path_length_m").alias("path_length_meters"))
    told = statistics.join(steps, "scan_id", "left")
    return (told.join(grid, "scan_id") if own else told.crossJoin(F.broadcast(grid))).select(
        "scan_id", "algorithm", F.element_at("path", 1).alias("start"), F.element_at("path", -1).alias("goal"), F.coalesce("path", F.array().cast("array<array<double>>")).alias("path"), stats.alias("statistics"), "grid_info")


def latest_status(log: DataFrame) -> DataFrame:
    """The last status of each session; a status is a row that is appended, never rewritten."""
    return log.groupBy("session_id").agg(F.max_by(F.struct("status", "detail", "outputs"), "seq").alias("s")).select("session_id", "s.*")


#: Names of outputs by their file.
OUTPUTS = {
    "blueprint/floorplan_2d.png": "floorplan",
    "blueprint/wireframe_2d.png": "wireframe",
    "debug/camera_trajectory.png": "camera_trajectory",
    "debug/blueprint_comparison.png": "blueprint_comparison",
    "mesh/clean_mesh.ply": "mesh",
    "pointcloud/colored_cloud.ply": "pointcloud",
    "pointcloud/filtered_cloud.ply": "pointcloud",
}


def manifest(files: DataFrame, most_images: int = 6) -> DataFrame:
    """(session_id, outputs): the named outputs of each session's files(session_id, path).

    Depth images are numbered from 0 by path, at most most_images; the coloured cloud goes before the filtered."""
    w = Window.partitionBy("session_id").orderBy("path")
    image = files.where(F.col("path").rlike(r"^viz/[^/]*_depth\.png$")).distinct().withColumn("k", F.row_number().over(w) - 1).where(F.col("k") < most_images)
    named = image.select("session_id", F.concat(F.lit("depth_viz_"), F.col("k").cast("string")).alias("name"), "path")
    name = F.lit(None).cast("string")
    for path, known in OUTPUTS.items():
        name = F.when(F.col("path") == path, known).otherwise(name)
    rest = files.withColumn("name", name).where("name is not null").groupBy("session_id", "name").agg(F.min("path").alias("path"))
    return named.unionByName(rest).groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "path")))).alias("outputs"))


def merged_outputs(first: str = "outputs", over: str = "more") -> Column:
    """Two output maps as one; the second wins where both have a name."""
    kept = F.map_filter(F.col(first), lambda k, v: ~F.map_contains_key(F.col(over), k))
    return F.map_concat(kept, F.col(over))
