"""Generated inputs: the furnished room, a triangulated height field, a cube and a walled grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Fixed values of the room: part, then (from, to, how many) along x, y and z. A pair of equal ends is one plane.
ROOM = (
    ("floor", (0.0, 10.0, 200), (0.0, 8.0, 160), (0.0, 0.0, 1)),
    ("wall_south", (0.0, 10.0, 100), (0.0, 0.0, 1), (0.0, 2.5, 30)),
    ("wall_north", (0.0, 10.0, 100), (8.0, 8.0, 1), (0.0, 2.5, 30)),
    ("wall_west", (0.0, 0.0, 1), (0.0, 8.0, 80), (0.0, 2.5, 30)),
    ("wall_east", (10.0, 10.0, 1), (0.0, 8.0, 80), (0.0, 2.5, 30)),
    ("block_a", (3.0, 4.0, 20), (3.0, 5.0, 40), (0.0, 1.5, 20)),
    ("block_b", (7.0, 8.0, 20), (1.0, 2.0, 20), (0.0, 1.5, 20)),
)
#: Start and goal in the room, metres.
ROOM_START, ROOM_GOAL = (1.0, 1.0), (9.0, 7.0)


def lattice(spark: SparkSession, part: str, x: tuple, y: tuple, z: tuple) -> DataFrame:
    """All places of a lattice, from one range of numbers."""
    n = x[2] * y[2] * z[2]
    at = {"x": F.expr(f"id div {y[2] * z[2]}"), "y": F.expr(f"(id div {z[2]}) % {y[2]}"), "z": F.expr(f"id % {z[2]}")}
    place = lambda i, a: g.spaced(i, *a) if a[2] > 1 else g.real(a[0])
    return spark.range(n).select(F.lit(part).alias("part"), *(place(at[k], a).alias(k) for k, a in (("x", x), ("y", y), ("z", z))))


def room(spark: SparkSession, sigma: float = 0.0, seed: int = 42) -> DataFrame:
    """The room's points; with sigma the floor is uneven (heights then depend on the partitioning)."""
    out = None
    for part in ROOM:
        some = lattice(spark, *part)
        if part[0] == "floor" and sigma:
            some = some.withColumn("z", F.col("z") + g.noise(seed, sigma))
        out = some if out is None else out.unionByName(some)
    return out


def height_field(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """n x n vertices with a stepped height, and two triangles for each square between them."""
    i, j = F.expr(f"id div {n}"), F.expr(f"id % {n}")
    vertices = spark.range(n * n).select(F.col("id").alias("vertex_id"), (i * 1.0).alias("x"), (j * 1.0).alias("y"), (((i * 7 + j * 13) % 5) * 0.25).alias("z"), ((i * 31 + j * 17) % 101 * 1.0).alias("density"))
    m = n - 1
    corner = F.expr(f"((id div 2) div {m}) * {n} + (id div 2) % {m}")
    odd = F.col("id") % 2 == 1
    triangles = spark.range(2 * m * m).select(F.col("id").alias("face_id"), corner.alias("v0"), (corner + F.when(odd, n + 1).otherwise(n)).alias("v1"), (corner + F.when(odd, 1).otherwise(n + 1)).alias("v2"))
    return vertices, triangles


#: The cube's outward triangles over corners numbered x + 2 y + 4 z.
CUBE = ((0, 3, 1), (0, 2, 3), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 7, 3), (2, 6, 7), (0, 6, 2), (0, 4, 6), (1, 3, 7), (1, 7, 5))


def cube(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    vertices = [(k, float(k % 2), float(k // 2 % 2), float(k // 4)) for k in range(8)]
    return spark.createDataFrame(vertices, "vertex_id long, x double, y double, z double"), spark.createDataFrame([(i, *t) for i, t in enumerate(CUBE)], "face_id long, v0 long, v1 long, v2 long")


def walled_grid(spark: SparkSession, n: int = 12) -> DataFrame:
    """Free cells of an n x n grid with a wall in its middle column but for the last two rows."""
    cells = spark.range(n * n).select(F.expr(f"id div {n}").cast("int").alias("gx"), (F.col("id") % n).cast("int").alias("gy"))
    return cells.where(~((F.col("gx") == n // 2) & (F.col("gy") < n - 2)))
