"""Planes: classes, the floor, extraction by random samples, and point-to-plane registration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PLANES
from ..functions import geometry as g
from ..iterate import durable
from . import neighbours


def classify(planes: DataFrame) -> DataFrame:
    """angle and type of planes(a, b, c, d); the normal is brought to unit length first."""
    nz = F.try_divide(F.col("c"), g.norm("a", "b", "c"))
    return planes.withColumn("angle", g.plane_angle(nz)).withColumn("type", g.plane_class("angle"))


def floor_height(planes: DataFrame, points: DataFrame, signed: bool = False, by: list[str] | None = None) -> DataFrame:
    """A row (for each scan with points): the floor's height. Of planes whose normal points up (nz > 0.8) the nearest to the origin;
    without one, the lowest point. The distance has no sign unless `signed`, which gives -d / c."""
    length = g.norm("a", "b", "c")
    up = planes.where(F.col("c") / length > 0.8).withColumn("dist", g.plane_distance("a", "b", "c", "d"))
    height = -F.col("d") / F.col("c") if signed else F.col("dist")
    best = up.groupBy(*(by or [])).agg(F.min(F.struct("dist", "plane_id", height.alias("h"))).alias("best"))
    low = points.groupBy(*(by or [])).agg(F.min("z").alias("low"))
    if by:
        return low.join(best, by, "left").select(*by, F.coalesce("best.h", "low").alias("floor_height"))
    return best.crossJoin(F.broadcast(low)).select(F.coalesce("best.h", "low").alias("floor_height"))


def signed_distance(plane: tuple[float, float, float, float]) -> Column:
    a, b, c, d = map(g.real, plane)
    return a * F.col("x") + b * F.col("y") + c * F.col("z") + d


def count_inliers(points: DataFrame, planes: np.ndarray, distance: float) -> np.ndarray:
    """How many points lie within the distance of each candidate: one pass over the points for all of them.

    Candidates change every round, so as expressions each round would compile code of its own; here each
    Arrow batch is a few array operations, and a task sends one count for each candidate."""
    import pyarrow as pa

    a, b, c, offset = np.ascontiguousarray(planes.T)

    def count(batches):
        total = np.zeros(len(offset), dtype=np.int64)
        for batch in batches:
            x, y, z = (batch.column(n).to_numpy()[:, None] for n in ("x", "y", "z"))
            for s in range(0, len(x), 256):
                k = slice(s, s + 256)  # summed in the order of the expression, so that limits fall alike
                total += (np.abs(a * x[k] + b * y[k] + c * z[k] + offset) < distance).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["candidate", "n"])

    own = points.select(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "z"))).where("x is not null and y is not null and z is not null")
    out = np.zeros(len(offset), dtype=np.int64)
    for r in own.mapInArrow(count, "candidate int, n long").groupBy("candidate").agg(F.sum("n").alias("n")).collect():
        out[r["candidate"]] = r["n"]
    return out


#: Points of a scan that one task counts for all candidates.
CHUNK = 50_000
_PLANE = ("a", "b", "c", "d")


def candidate_planes(points: DataFrame, sizes: DataFrame, number: int, turn: int, seed: int, key: str, by: str) -> DataFrame:
    """(by, candidate, a, b, c, d): unit planes with c >= 0 through three points each of a scan; degenerate ones are left out.

    The points are the 3 * number of a scan whose id has the smallest digest with seed and turn, three after three. Only
    points whose digest is below the share that holds so many of the scan's n (sizes(by, n)) are ranked; a scan in which
    too few are, as with repeated ids, ranks all of its points."""
    name = F.md5(F.concat_ws(":", F.col(by).cast("string"), F.col(key).cast("string"), F.lit(seed), F.lit(turn)).cast("binary"))
    wanted = 3 * number
    share = (wanted + 12 * wanted**0.5 + 60) / F.col("n")
    named = points.join(sizes.select(by, "n"), by).select(by, key, "x", "y", "z", "n", name.alias("name"))
    low = durable(named.where(F.conv(F.substring("name", 1, 15), 16, 10).cast("double") < share * 2.0**60), "drawn")
    counts = low.groupBy(by).agg(F.count("*").alias("held"))
    short = sizes.join(counts, by, "left").where(F.coalesce("held", F.lit(0)) < F.least("n", F.lit(wanted))).select(by)
    if short.take(1):
        low = low.join(short, by, "left_anti").select(*low.columns).unionByName(named.join(short, by, "left_semi").select(*low.columns))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("name", key))
    drawn = low.drop("n").withColumn("k", rank).where(F.col("k") <= wanted).withColumn("k", F.col("k") - 1)
    corners = [F.max(F.when(F.col("k") % 3 == j, F.col(a))).alias(f"{a}{j}") for j in range(3) for a in "xyz"]
    triples = drawn.groupBy(by, F.floor(F.col("k") / 3).cast("int").alias("candidate")).agg(F.count("*").alias("n"), *corners).where("n = 3")
    p, q = ([F.col(f"{a}{j}") - F.col(f"{a}0") for a in "xyz"] for j in (1, 2))
    normal = dict(zip("abc", g.cross(p, q), strict=True))
    sized = triples.select(by, "candidate", "x0", "y0", "z0", *(v.alias(k) for k, v in normal.items())).withColumn("size", g.norm("a", "b", "c")).where("size > 1e-12")
    unit = sized.withColumns({k: F.col(k) / F.col("size") for k in "abc"})
    unit = unit.withColumns({k: F.when(F.col("c") < 0, -F.col(k)).otherwise(F.col(k)) for k in "abc"})
    return unit.select(by, "candidate", "a", "b", "c", (-(F.col("a") * F.col("x0") + F.col("b") * F.col("y0") + F.col("c") * F.col("z0"))).alias("d"))


def _inside(distance: float) -> Column:
    return F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d")) < distance


#: Points of a box that are tested one by one, and parts that a larger box is divided into.
BOX, PARTS = 128, 4


def _near_each_other(places: np.ndarray) -> np.ndarray:
    """The order of places(n, 3) along a curve that fills their cube, so that slices lie close together."""
    with np.errstate(invalid="ignore", over="ignore"):
        low = places.min(axis=0)
        share = np.nan_to_num((places - low) / ((places.max(axis=0) - low).max() or 1.0), nan=0.0, posinf=1.0)
    cell = (np.clip(share, 0, 1) * 1023).astype(np.int64)
    code = np.zeros(len(cell), dtype=np.int64)
    for bit in range(10):
        for axis in range(3):
            code |= (cell[:, axis] >> bit & 1) << (3 * bit + axis)
    return np.argsort(code, kind="stable")


def count_within(x: np.ndarray, y: np.ndarray, z: np.ndarray, planes: list[np.ndarray], distance: float) -> np.ndarray:
    """How many points lie within the distance of each of the planes (a, b, c, d), exactly.

    A box of points that a plane misses or holds whole, with room for rounding, is counted at once; else it is divided,
    and points of the last boxes are tested themselves."""
    a, b, c, d = planes
    order = _near_each_other(np.stack([x, y, z], axis=1))
    x, y, z = x[order], y[order], z[order]
    total = np.zeros(len(d), dtype=np.int64)
    slack = 1e-12 * (np.abs(a) * np.abs(x).max() + np.abs(b) * np.abs(y).max() + np.abs(c) * np.abs(z).max() + np.abs(d) + 1)
    todo = [(0, len(x), np.arange(len(d)))]
    while todo:
        first, last, who = todo.pop()
        k = slice(first, last)
        if last - first > BOX:
            with np.errstate(invalid="ignore"):
                ends = [(v[k].min(), v[k].max()) for v in (x, y, z)]
                (mx, hx), (my, hy), (mz, hz) = (((low + high) / 2, (high - low) / 2) for low, high in ends)
                far = np.abs(a[who] * mx + b[who] * my + c[who] * mz + d[who])
                reach = np.abs(a[who]) * hx + np.abs(b[who]) * hy + np.abs(c[who]) * hz + slack[who]
                whole, missed = far + reach < distance, far - reach >= distance
            total[who[whole]] += last - first
            who = who[~whole & ~missed]
            if len(who):
                cuts = np.linspace(first, last, PARTS + 1).astype(int)
                todo += [(p, q, who) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
        else:  # summed in the order of the expression, so that limits fall alike
            total[who] += (np.abs(a[who] * x[k, None] + b[who] * y[k, None] + c[who] * z[k, None] + d[who]) < distance).sum(axis=0)
    return total


def best_planes(points: DataFrame, candidates: DataFrame, sizes: DataFrame, distance: float, key: str, by: str) -> DataFrame:
    """(by, a, b, c, d, num_points) of each scan's candidate with most points within the distance, of equal ones the first.

    points and candidates meet in parts of a scan (sizes says into how many), so a large scan is many tasks'; each
    passes on a number for each candidate."""
    import pyarrow as pa

    kind = points.schema[by].dataType.simpleString()

    def count(own: pa.Table, asked: pa.Table) -> pa.Table:
        total = np.zeros(asked.num_rows, dtype=np.int64)
        if own.num_rows and asked.num_rows:
            total = count_within(*(own.column(n).to_numpy() for n in "xyz"), [asked.column(n).to_numpy() for n in _PLANE], distance)
        return pa.table({by: asked.column(by), "candidate": asked.column("candidate"), "n": pa.array(total)})

    part = F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part")
    dealt = points.join(sizes.select(by, "parts"), by).select(by, part, *(F.col(a).cast("double").alias(a) for a in "xyz"))
    asked = candidates.join(sizes.select(by, "parts"), by).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    counted = dealt.groupBy(by, "part").cogroup(asked.groupBy(by, "part")).applyInArrow(count, f"{by} {kind}, candidate int, n long")
    best = counted.groupBy(by, "candidate").agg(F.sum("n").alias("n")).groupBy(by).agg(F.max(F.struct("n", (-F.col("candidate")).alias("first"))).alias("m"))
    best = best.select(by, F.col("m.n").alias("num_points"), (-F.col("m.first")).alias("candidate"))
    return candidates.join(best, [by, "candidate"]).drop("candidate")


def detect_scans(points: DataFrame, distance: float = PLANES.distance, candidates: int = PLANES.iterations, least: int = PLANES.least_points, most: int = PLANES.most_planes, seed: int = 42, key: str = "point_id", by: str = "scan_id") -> tuple[DataFrame, DataFrame]:
    """Planes of all scans of points(by, key, x, y, z), one after another in each: every plane takes its points from those left.

    All scans lose their points together, so there are at most `most` rounds, and scans with too few points left or no
    plane of at least `least` points leave. Samples are drawn by digest, so a run repeats exactly. Returns
    planes(by, plane_id, a, b, c, d, num_points, angle, type) and members(by, plane_id, key). Points without a place are left out."""
    own = points.select(by, key, *(F.col(a).cast("double").alias(a) for a in "xyz")).where(" and ".join(f"{a} is not null and not isnan({a})" for a in "xyz"))
    left, found, members = durable(own, "remaining"), None, None
    for plane_id in range(most):
        sizes = durable(left.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(by, "n", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")), "sizes")
        drawn = durable(candidate_planes(left, sizes, candidates, plane_id, seed, key, by), "candidates")
        best = durable(best_planes(left, drawn, sizes, distance, key, by).where(F.col("num_points") >= least), "planes")
        if not best.take(1):
            break
        row = best.withColumn("plane_id", F.lit(plane_id)).select(by, "plane_id", *_PLANE, "num_points")
        told = durable(left.join(best.select(by, *_PLANE), by).withColumn("inside", _inside(distance)).drop(*_PLANE), "told")
        held = told.where("inside").select(by, F.lit(plane_id).alias("plane_id"), key)
        found, members = (row, held) if found is None else (found.unionByName(row), members.unionByName(held))
        left = told.where("not inside").drop("inside")
    if found is None:
        found = left.limit(0).select(by, F.lit(0).alias("plane_id"), *(g.real(0).alias(p) for p in _PLANE), F.lit(0).cast("long").alias("num_points"))
        members = left.limit(0).select(by, F.lit(0).alias("plane_id"), key)
    return classify(found), members


def detect(points: DataFrame, distance: float = PLANES.distance, candidates: int = PLANES.iterations, least: int = PLANES.least_points, most: int = PLANES.most_planes, seed: int = 42, key: str = "point_id") -> tuple[DataFrame, DataFrame]:
    """The planes and members of one scan, as detect_scans finds them."""
    planes, members = detect_scans(points.withColumn("scan_id", F.lit("scan")), distance, candidates, least, most, seed, key)
    return planes.drop("scan_id"), members.drop("scan_id")


_ENTRIES = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]


def _steps(sums):
    """Batches of normal equations, a row for each pair, to the pose that each of them asks for next."""
    import pyarrow as pa

    upper = [(i, j) for i in range(6) for j in range(i, 6)]
    for batch in sums:
        value = {n: batch.column(n).to_numpy() for n in batch.schema.names if n != "pair_id"}
        out = {n: [] for n in _ENTRIES} | {"settled": []}
        for k in range(batch.num_rows):
            pose = np.eye(4)
            pose[:3, :3] = np.asarray([value[n][k] for n in _ENTRIES[:9]]).reshape(3, 3)
            pose[:3, 3] = [value[n][k] for n in _ENTRIES[9:]]
            settled = not value["n"][k]
            if not settled:
                a = np.zeros((6, 6))
                for i, j in upper:
                    a[i, j] = a[j, i] = value[f"a{i}{j}"][k]
                w = np.linalg.lstsq(a, np.asarray([value[f"b{i}"][k] for i in range(6)]), rcond=1e-9)[0]
                step = np.eye(4)
                step[:3, :3], step[:3, 3] = rotation(w[:3]), w[3:]
                pose, settled = step @ pose, np.abs(w).max() < 1e-7
            for n, v in zip(_ENTRIES, [*pose[:3, :3].ravel(), *pose[:3, 3]], strict=True):
                out[n].append(float(v))
            out["settled"].append(bool(settled))
        yield pa.RecordBatch.from_arrays([batch.column("pair_id"), *(pa.array(v) for v in out.values())], names=["pair_id", *out])


def register_pairs(moving: DataFrame, target: DataFrame, distance: float, rounds: int = 10, key: str = "point_id") -> DataFrame:
    """Point-to-plane registration of many pairs at once: (pair_id, r00 ... r22, tx, ty, tz), the pose that brings each pair's
    moving(pair_id, key, x, y, z) onto its target(pair_id, key, x, y, z, nx, ny, nz).

    Each round matches points to their nearest neighbours within the distance, sums the normal equations by pair (27
    sums, partly summed before they are moved) and solves them where they are, a row for each pair. A pair leaves when its
    pose no longer moves or nothing matches; a pair without a match keeps the identity. Nothing reaches the driver."""
    kind = moving.schema["pair_id"].dataType.simpleString()
    start = {n: g.real(1.0 if n in ("r00", "r11", "r22") else 0.0) for n in _ENTRIES}
    open_pairs = durable(moving.select("pair_id").distinct().withColumns(start), "poses")
    named = target.select("pair_id", F.col(key).alias("other"), *(F.col(c).alias(f"t_{c}") for c in ("x", "y", "z", "nx", "ny", "nz")))
    settled = None
    rungs = neighbours.ladder(target, distance, key, ("pair_id",))
    for _ in range(rounds):
        now = moving.join(open_pairs, "pair_id")
        now = durable(now.withColumns(g.transform("x", "y", "z")).select("pair_id", key, "x", "y", "z"), "moved")
        near = neighbours.match(now, rungs, distance, key, by=("pair_id",), apart=False).withColumnRenamed("point", key)
        pairs = near.join(now.hint("merge"), ["pair_id", key]).join(named.hint("merge"), ["pair_id", "other"])
        p, n = [F.col(a) for a in "xyz"], [F.col(f"t_n{a}") for a in "xyz"]
        row = [*g.cross(p, n), *n]
        gap = g.dot([F.col(f"t_{a}") - F.col(a) for a in "xyz"], n)
        sums = {f"a{i}{j}": row[i] * row[j] for i in range(6) for j in range(i, 6)} | {f"b{i}": row[i] * gap for i in range(6)}
        summed = pairs.groupBy("pair_id").agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in sums.items()))
        asked = open_pairs.join(summed, "pair_id", "left").select("pair_id", *_ENTRIES, *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("n", *sums)))
        schema = f"pair_id {kind}, " + ", ".join(f"{n} double" for n in _ENTRIES) + ", settled boolean"
        poses = durable(asked.mapInArrow(_steps, schema), "poses")
        rest = poses.where("settled").drop("settled")
        settled = rest if settled is None else settled.unionByName(rest)
        open_pairs = poses.where("not settled").drop("settled")
        if not open_pairs.take(1):
            break
    return open_pairs if settled is None else settled.unionByName(open_pairs)


def register(moving: DataFrame, target: DataFrame, distance: float, rounds: int = 10, key: str = "point_id") -> np.ndarray:
    """The 4x4 transform of one pair, as register_pairs finds it; no point gives the identity."""
    pose = np.eye(4)
    found = register_pairs(moving.withColumn("pair_id", F.lit(0)), target.withColumn("pair_id", F.lit(0)), distance, rounds, key).first()
    if found:
        pose[:3, :3] = np.asarray([found[n] for n in _ENTRIES[:9]]).reshape(3, 3)
        pose[:3, 3] = [found[n] for n in _ENTRIES[9:]]
    return pose


def rotation(v: np.ndarray) -> np.ndarray:
    """The rotation by a vector's length about its direction."""
    angle = np.linalg.norm(v)
    if angle < 1e-15:
        return np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / angle
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k
