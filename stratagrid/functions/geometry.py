"""Scalar column expressions of the scan pipeline; all stay inside whole-stage code generation.

Casts to int cut towards zero; NaN never passes a filter; divisions by zero give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def real(x: float) -> Column:
    """A double literal (a bare decimal literal would be a DECIMAL in SQL)."""
    return F.lit(float(x))


def norm(*parts: Column | str) -> Column:
    total = None
    for p in parts:
        total = col(p) * col(p) if total is None else total + col(p) * col(p)
    return F.sqrt(total)


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def back_project(u: str, v: str, d: str, fx: str, fy: str, cx: str, cy: str) -> dict[str, Column]:
    """Camera coordinates of a depth pixel (pinhole model); null where a focal length is 0."""
    d_ = col(d)
    return {
        "x": F.try_divide((col(u) - col(cx)) * d_, col(fx)),
        "y": F.try_divide((col(v) - col(cy)) * d_, col(fy)),
        "z": d_ * 1.0,
    }


POSE = tuple(f"r{i}{j}" for i in range(3) for j in range(3)) + ("tx", "ty", "tz")


def transform(x: str, y: str, z: str, pose: tuple[str, ...] = POSE) -> dict[str, Column]:
    """A point moved by a rotation and translation, given as twelve columns."""
    p = [col(x), col(y), col(z)]
    r, t = pose[:9], pose[9:]
    return {n: dot([col(c) for c in r[3 * i : 3 * i + 3]], p) + col(t[i]) for i, n in enumerate("xyz")}


def invert_pose(pose: tuple[str, ...] = POSE) -> dict[str, Column]:
    """The inverse of a rigid pose: the transposed rotation R', and -R't."""
    r, t = pose[:9], [col(c) for c in pose[9:]]
    out = {f"r{i}{j}": col(r[3 * j + i]) for i in range(3) for j in range(3)}
    for i, n in enumerate(("tx", "ty", "tz")):
        out[n] = -dot([col(r[3 * j + i]) for j in range(3)], t)
    return out


def angle_of_cosine(c: Column) -> Column:
    """Degrees; the cosine is first held to [-1, 1]."""
    return F.degrees(F.acos(F.greatest(real(-1), F.least(real(1), c))))


def rotation_angle(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two rotations: the trace of b a' is the sum of elementwise products."""
    trace = None
    for x, y in zip(a, b):
        trace = x * y if trace is None else trace + x * y
    return angle_of_cosine((trace - 1.0) / 2.0)


def clip_depth(d: Column | str, most: float) -> Column:
    d = col(d)
    return F.when(~F.isnan(d), F.greatest(real(0), F.least(real(most), d)))


def valid_depth(d: Column | str, conf: Column | str, most: float, least_conf: float) -> Column:
    """0 < depth < most and, where the frame has confidences and least_conf > 0, confidence above it."""
    d, conf = col(d), col(conf)
    ok = ~F.isnan(d) & (d > 0) & (d < most)
    if least_conf > 0:
        ok &= conf.isNull() | (~F.isnan(conf) & (conf > least_conf))
    return ok


def alpha(conf: Column | str) -> Column:
    """Confidence as 0 to 255."""
    return F.least(real(255), F.greatest(real(0), col(conf) * 255.0)).cast("int")


def sampling_interval(video_fps: Column | str, target: int) -> Column:
    """Every how many frames one is kept: at least 1."""
    return F.greatest(F.lit(1), (col(video_fps) / real(target)).cast("int"))


def plane_angle(nz: Column | str) -> Column:
    """Degrees between a plane's unit normal and the vertical."""
    return angle_of_cosine(F.abs(col(nz)))


def plane_class(angle: Column | str) -> Column:
    a = col(angle)
    return F.when(a < 15, "floor/ceiling").when(a > 75, "wall").otherwise("sloped")


def plane_distance(a: str, b: str, c: str, d: str) -> Column:
    """Distance of a plane from the origin."""
    return F.try_divide(F.abs(col(d)), norm(a, b, c))


def to_cell(x: Column | str, x0: Column | str, resolution: Column | float) -> Column:
    """Grid index of a coordinate; cut towards zero."""
    r = real(resolution) if isinstance(resolution, (int, float)) else resolution
    return ((col(x) - col(x0)) / r).cast("int")


def from_cell(g: Column | str, x0: Column | str, resolution: Column | float) -> Column:
    """Coordinate of a cell's corner."""
    r = real(resolution) if isinstance(resolution, (int, float)) else resolution
    return col(g) * r + col(x0)


def to_pixel(x: str, y: str, x_min: str, y_max: str, resolution: str) -> dict[str, Column]:
    """Floor-plan pixel; rows count from the top."""
    return {"px": ((col(x) - col(x_min)) * col(resolution)).cast("int"), "py": ((col(y_max) - col(y)) * col(resolution)).cast("int")}


def spaced(i: Column | str, a: float, b: float, n: int) -> Column:
    """The i-th of n evenly spaced values from a to b."""
    return real(a) + col(i) * (real(b) - real(a)) / real(n - 1)


def noise(seed: int, sigma: float) -> Column:
    """Gaussian noise; repeatable for one partitioning only."""
    return F.randn(seed) * sigma


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def basename(path: Column | str) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def suffix(path: Column | str) -> Column:
    """Lower-case extension with its dot, or the empty string."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def slashes(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def relative(path: Column | str, root: str) -> Column:
    p, r = slashes(path), root.rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(r)), F.substring(p, len(r) + 1, 1 << 20)).otherwise(p)


def safe_relative(path: Column | str) -> Column:
    """Neither absolute nor with a step to a parent folder."""
    p = slashes(path)
    return ~F.startswith(p, F.lit("/")) & ~F.array_contains(F.split(p, "/"), "..")


def padded(i: Column | str, width: int = 5) -> Column:
    return F.lpad(col(i).cast("string"), width, "0")
