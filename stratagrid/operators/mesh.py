"""Triangle meshes as two relations: vertices(vertex_id, x, y, z) and triangles(face_id, v0, v1, v2).

Both grow with the mesh, but few columns of them are small files, so Spark would broadcast tables of a million rows and
more to every executor; joins of the two ask to be merged instead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MESH
from ..functions import geometry as g
from ..iterate import durable
from .quantiles import quantile

CORNERS = ("v0", "v1", "v2")


def faces(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles with their unit normals; a degenerate one has none (null)."""
    out = triangles
    for c in CORNERS:
        out = out.join(vertices.select(F.col("vertex_id").alias(c), *(F.col(a).alias(f"{c}_{a}") for a in "xyz")).hint("merge"), c)
    n = g.cross([F.col(f"v1_{a}") - F.col(f"v0_{a}") for a in "xyz"], [F.col(f"v2_{a}") - F.col(f"v0_{a}") for a in "xyz"])
    out = out.withColumns(dict(zip(("wx", "wy", "wz"), n))).withColumn("w", g.norm("wx", "wy", "wz"))
    return out.select("face_id", *CORNERS, *(F.try_divide(f"w{a}", "w").alias(f"n{a}") for a in "xyz"), (F.col("w") / 2).alias("area"))


def edges(triangles: DataFrame, *kept: str) -> DataFrame:
    """(lo, hi, face_id, kept...): the three edges of each triangle, the smaller vertex first."""
    pairs = [F.struct(F.least(F.col(a), F.col(b)).alias("lo"), F.greatest(F.col(a), F.col(b)).alias("hi")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v0", "v2"))]
    return triangles.select("face_id", *kept, F.explode(F.array(*pairs)).alias("e")).select("e.lo", "e.hi", "face_id", *kept)


def edge_faces(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Each edge with its number of faces and the angle between the normals of its first and last face."""
    both = edges(faces(vertices, triangles).withColumn("n", F.struct("nx", "ny", "nz")), "n")
    grouped = both.groupBy("lo", "hi").agg(F.count("*").alias("n_faces"), F.min_by("n", "face_id").alias("p"), F.max_by("n", "face_id").alias("q"))
    cosine = g.dot([F.col(f"p.n{a}") for a in "xyz"], [F.col(f"q.n{a}") for a in "xyz"])
    return grouped.select("lo", "hi", "n_faces", g.angle_of_cosine(cosine).alias("angle"))


def feature_edges(vertices: DataFrame, triangles: DataFrame, least_angle: float = MESH.edge_angle) -> DataFrame:
    """Visible edges: those of one face, and those of two whose normals differ by more than the angle.
    Edges of three faces or more are left out."""
    kept = edge_faces(vertices, triangles).where((F.col("n_faces") == 1) | ((F.col("n_faces") == 2) & (F.col("angle") > least_angle)))
    for end in ("lo", "hi"):
        kept = kept.join(vertices.select(F.col("vertex_id").alias(end), *(F.col(a).alias(f"{end}_{a}") for a in "xyz")).hint("merge"), end)
    return kept


def trim(vertices: DataFrame, triangles: DataFrame, density: str = "density", share: float = MESH.density_quantile) -> tuple[DataFrame, DataFrame]:
    """Vertices at or above the density's quantile, and the triangles that keep all three corners."""
    limit = durable(quantile(vertices, density, share), "density")  # one row
    kept = vertices.crossJoin(F.broadcast(limit)).where(F.col(density) >= F.col("quantile")).drop("quantile")
    return kept, with_vertices(triangles, kept)


def with_vertices(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    for c in CORNERS:
        triangles = triangles.join(vertices.select(F.col("vertex_id").alias(c)).hint("merge"), c, "left_semi")
    return triangles


def smooth(vertices: DataFrame, triangles: DataFrame, rounds: int = MESH.smoothing_rounds) -> DataFrame:
    """Each vertex moves to the mean of itself and its neighbours, round after round; each round is a written table."""
    e = edges(triangles).select("lo", "hi").distinct()
    links = durable(e.union(e.select("hi", "lo")).toDF("vertex_id", "other"), "links")
    for _ in range(rounds):
        ends = vertices.select(F.col("vertex_id").alias("other"), *(F.col(a).alias(f"o{a}") for a in "xyz"))
        sums = links.join(ends.hint("merge"), "other").groupBy("vertex_id").agg(F.count("*").alias("degree"), *(F.sum(f"o{a}").alias(f"s{a}") for a in "xyz"))
        moved = vertices.select("vertex_id", *"xyz").join(sums.hint("merge"), "vertex_id", "left")
        vertices = moved.select("vertex_id", *(((F.col(a) + F.coalesce(f"s{a}", g.real(0))) / (1 + F.coalesce("degree", F.lit(0)))).alias(a) for a in "xyz"))
        vertices = durable(vertices, "smoothed")
    return vertices


def vertex_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """The unit sum of the unit normals of a vertex's faces."""
    own = faces(vertices, triangles).select(F.explode(F.array(*CORNERS)).alias("vertex_id"), "nx", "ny", "nz")
    sums = own.groupBy("vertex_id").agg(*(F.sum(f"n{a}").alias(f"s{a}") for a in "xyz"))
    return sums.select("vertex_id", *(F.try_divide(F.col(f"s{a}"), g.norm("sx", "sy", "sz")).alias(f"n{a}") for a in "xyz"))


def clean(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without vertices that repeat a place, repeated and degenerate triangles, and vertices of no triangle.

    Of vertices at one place the smallest id stays, of triangles with the same corners the smallest face."""
    place = vertices.groupBy("x", "y", "z").agg(F.min("vertex_id").alias("keep"))
    names = vertices.join(place.hint("merge"), ["x", "y", "z"]).select("vertex_id", "keep")
    for c in CORNERS:
        triangles = triangles.join(names.select(F.col("vertex_id").alias(c), F.col("keep").alias(f"{c}_keep")).hint("merge"), c).drop(c).withColumnRenamed(f"{c}_keep", c)
    proper = triangles.where("v0 <> v1 and v1 <> v2 and v0 <> v2")
    same = F.array_sort(F.array(*CORNERS))
    single = proper.groupBy(same.alias("corners")).agg(F.min(F.struct("face_id", *CORNERS)).alias("t")).select("t.*")
    used = single.select(F.explode(F.array(*CORNERS)).alias("vertex_id")).distinct()
    kept = vertices.join(place.select(F.col("keep").alias("vertex_id")).hint("merge"), "vertex_id", "left_semi").join(used.hint("merge"), "vertex_id", "left_semi")
    return kept, single


def extents(vertices: DataFrame) -> DataFrame:
    """Room size, centre and the half range that a cubic view needs."""
    size = {a: F.max(a) - F.min(a) for a in "xyz"}
    out = vertices.agg(*(v.alias(f"{a}_size") for a, v in size.items()), *(F.avg(a).alias(f"{a}_mean") for a in "xyz"), F.count("*").alias("n_vertices"))
    return out.withColumn("half_range", F.greatest("x_size", "y_size", "z_size") / 2.0)
