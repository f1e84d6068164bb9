"""Point-cloud operators: bounds, slices, voxels, outliers, normals and their orientation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FLOOR, SCAN
from ..functions import geometry as g
from ..iterate import durable
from . import neighbours
from .quantiles import quantile

AXES = ("x", "y", "z")


def bounds(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    lows = [F.min(a).alias(f"{a}_min") for a in AXES]
    return points.groupBy(*(by or [])).agg(*lows, *(F.max(a).alias(f"{a}_max") for a in AXES), F.count("*").alias("n"))


def closed_slice(points: DataFrame, height: float, half: float) -> DataFrame:
    return points.where(~F.isnan("z") & F.col("z").between(height - half, height + half))


def open_slice(points: DataFrame, height: float, half: float) -> DataFrame:
    return points.where(~F.isnan("z") & (F.col("z") > height - half) & (F.col("z") < height + half))


def adaptive_slice(points: DataFrame, height: float | Column = FLOOR.height, half: float = FLOOR.half_height, least: int = FLOOR.least_points, wide: float = FLOOR.fallback_half_height, by: tuple[str, ...] = ()) -> DataFrame:
    """The open slice; with fewer than `least` points in it, the points around the median height.

    With by, each of many scans decides for itself, and height may be a column. The median is taken of scans that need
    it, exactly and without gathering their points. A scan without points has none in its slice."""
    z, by = F.col("z"), list(by)
    height = F.lit(height) if isinstance(height, (int, float)) else height
    inside = ~F.isnan("z") & (z > height - half) & (z < height + half)
    facts = durable(points.groupBy(*by).agg(F.count(F.when(inside, 1)).alias("n_inside")), "slices")
    thin = facts.where(F.col("n_inside") < least)
    if not thin.take(1):
        return points.where(inside)
    few = points.join(thin.select(*by), by, "left_semi") if by else points
    middle = durable(quantile(few, "z", 0.5, tuple(by)), "medians")
    near = ~F.isnan("z") & (z > F.col("quantile") - wide) & (z < F.col("quantile") + wide)
    if not by:  # one row
        return points.crossJoin(F.broadcast(middle)).where(near).drop("quantile")
    told = points.join(middle, by, "left")
    return told.where(F.when(F.col("quantile").isNull(), inside).otherwise(near)).drop("quantile")


def voxels(points: DataFrame, size: float, values: tuple[str, ...] = ("x", "y", "z"), by: tuple[str, ...] = ()) -> DataFrame:
    """The mean of each voxel's points. Voxels start half a voxel below the least coordinate."""
    low = points.groupBy(*by).agg(*(F.min(a).alias(f"{a}0") for a in AXES))
    joined = points.join(F.broadcast(low), list(by)) if by else points.crossJoin(F.broadcast(low))
    cells = {f"v{a}": F.floor((F.col(a) - (F.col(f"{a}0") - g.real(size / 2))) / g.real(size)) for a in AXES}
    return joined.withColumns(cells).groupBy(*by, *cells).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n_points"))


def mean_distances(points: DataFrame, k: int = SCAN.outlier_neighbours, key: str = "point_id") -> DataFrame:
    """Each point's mean distance to its k nearest other points."""
    near = neighbours.nearest(points, points, k, key)
    return near.groupBy(F.col("point").alias(key)).agg(F.avg(F.sqrt("d2")).alias("mean_distance"))


def statistical_inliers(points: DataFrame, k: int = SCAN.outlier_neighbours, ratio: float = SCAN.outlier_ratio, key: str = "point_id") -> DataFrame:
    """Points whose mean neighbour distance is at most mean + ratio * sample deviation of all of them."""
    own = durable(mean_distances(points, k, key), "mean-distances")
    limit = own.agg((F.avg("mean_distance") + ratio * F.stddev_samp("mean_distance")).alias("most"))
    kept = own.crossJoin(F.broadcast(limit)).where(F.col("most").isNull() | (F.col("mean_distance") <= F.col("most")))
    return points.join(kept.select(key), key, "left_semi")


def neighbour_counts(points: DataFrame, radius: float, key: str = "point_id") -> DataFrame:
    found = neighbours.within(points, points, radius, key).groupBy(F.col("point").alias(key)).agg(F.count("*").alias("n"))
    return points.select(key).join(found, key, "left").withColumn("n_neighbours", F.coalesce("n", F.lit(0))).drop("n")


def radius_inliers(points: DataFrame, radius: float, least: int = SCAN.radius_neighbours, key: str = "point_id") -> DataFrame:
    """Points with at least `least` other points within the radius."""
    kept = neighbour_counts(points, radius, key).where(F.col("n_neighbours") >= least)
    return points.join(kept.select(key), key, "left_semi")


def without_ghosts(points: DataFrame, base_voxel: float = SCAN.voxel) -> DataFrame:
    """Duplicate geometry removed: voxels of 1.5 base voxels, then the radius test at 3 base voxels."""
    thin = voxels(points, 1.5 * base_voxel).withColumn("point_id", F.xxhash64("vx", "vy", "vz"))
    return radius_inliers(thin, 3 * base_voxel)


def nearest_distances(points: DataFrame, key: str = "point_id") -> DataFrame:
    """Each point's distance to its nearest other point."""
    return neighbours.nearest(points, points, 1, key).select(F.col("point").alias(key), F.sqrt("d2").alias("distance"))


def pivot_radii(points: DataFrame, key: str = "point_id") -> DataFrame:
    """Radii for ball pivoting: 1.5, 3 and 6 times the mean distance of nearest neighbours."""
    mean = nearest_distances(points, key).agg(F.avg("distance").alias("mean_distance"))
    return mean.withColumn("radii", F.array(*(F.col("mean_distance") * k for k in (1.5, 3.0, 6.0))))


def covariances(points: DataFrame, radius: float = SCAN.normal_radius, most: int = SCAN.normal_neighbours, key: str = "point_id", near: DataFrame | None = None) -> DataFrame:
    """Covariance of each point and its (at most `most`) neighbours within the radius.

    near may hold the result of nearest() for most - 1 others or more, so that a search made for something else serves."""
    if near is None:
        near = neighbours.nearest(points, points, most - 1, key, widest=radius)
    else:
        near = near.where((F.col("rank") <= most - 1) & (F.col("d2") <= g.real(radius * radius)))
    near = near.select(F.col("point").alias(key), F.col("other").alias("n"))
    near = near.unionByName(points.select(key, F.col(key).alias("n")))
    named = points.select(F.col(key).alias("n"), *AXES)
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    sums = near.join(named, "n").groupBy(key).agg(F.count("*").alias("n_used"), *(F.avg(a).alias(f"m{a}") for a in AXES), *(F.avg(F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in pairs))
    return sums.withColumns({f"{a}{b}": F.col(f"{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}") for a, b in pairs})


def normals(points: DataFrame, radius: float = SCAN.normal_radius, most: int = SCAN.normal_neighbours, key: str = "point_id", near: DataFrame | None = None) -> DataFrame:
    """Unit normals: the direction in which a point's neighbourhood is thinnest, turned up (nz >= 0).

    Fewer than three points give (0, 0, 1). Eigenvectors are taken batch by batch in numpy. near as in covariances()."""

    @F.pandas_udf("struct<nx:double,ny:double,nz:double>")
    def thinnest(n: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3)
        v = np.linalg.eigh(m)[1][:, :, 0]
        v[n.to_numpy() < 3] = (0, 0, 1)
        v[v[:, 2] < 0] *= -1
        return pd.DataFrame(v, columns=["nx", "ny", "nz"])

    found = covariances(points, radius, most, key, near)
    return points.join(found.select(key, thinnest("n_used", "xx", "xy", "xz", "yy", "yz", "zz").alias("v")).select(key, "v.*"), key)


def face_camera(points: DataFrame, cameras: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Normals turned to the camera that saw the point (cameras: frame, tx, ty, tz).

    The library call this stands for spreads one orientation along a spanning tree of neighbours; this
    rule needs no global order and gives outward normals for what a camera sees."""
    joined = points.join(cameras.select(frame, "tx", "ty", "tz"), frame)
    away = F.col("nx") * (F.col("tx") - F.col("x")) + F.col("ny") * (F.col("ty") - F.col("y")) + F.col("nz") * (F.col("tz") - F.col("z")) < 0
    sign = F.when(away, g.real(-1)).otherwise(g.real(1))
    return joined.withColumns({n: F.col(n) * sign for n in ("nx", "ny", "nz")}).drop("tx", "ty", "tz")
