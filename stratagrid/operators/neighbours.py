"""Neighbourhood joins by cells: an equi-join on cell ids instead of a distance join over all pairs.

A point meets only points of its own and the 26 cells around it. Cells are as wide as the radius, so no
neighbour is missed. `salts` splits what stands in one cell over several tasks (the other side is copied
that often), for clouds with very dense cells. The k nearest are found in cells of several levels, which follow the
density of the cloud.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..iterate import durable

AXES = ("x", "y", "z")


def with_cell(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({f"c{a}": F.floor(F.col(a) / g.real(size)) for a in AXES})


def within(points: DataFrame, others: DataFrame, radius: float, key: str = "point_id", salts: int = 1, by: tuple[str, ...] = (), apart: bool = True) -> DataFrame:
    """Pairs (by..., point, other, d2) at most radius apart. With by, points meet others of the same group only. A point never
    meets its own id, unless points and others are clouds apart whose ids mean nothing to each other (apart=False)."""
    shifts = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    left = with_cell(points.select(*by, F.col(key).alias("p"), *AXES), radius)
    for a in AXES:
        left = left.withColumn(f"s{a}", shifts).withColumn(f"c{a}", F.col(f"c{a}") + F.col(f"s{a}")).drop(f"s{a}")
    right = with_cell(others.select(*by, F.col(key).alias("q"), *(F.col(a).alias(f"o{a}") for a in AXES), *AXES), radius).drop(*AXES)
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0))
    right = right.withColumn("salt", F.pmod(F.xxhash64("q"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0))
    d2 = sum(((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in AXES[1:]), (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")))
    pairs = left.join(right.hint("merge"), [*by, "cx", "cy", "cz", "salt"]).withColumn("d2", d2)
    near = pairs.where(F.col("d2") <= radius * radius)
    return (near.where(F.col("p") != F.col("q")) if apart else near).select(*by, F.col("p").alias("point"), F.col("q").alias("other"), "d2")


#: Times that a cell can be halved each way, and how many of them one round looks at.
DEEPEST, STEP = 30, 5
#: Points of which one task looks up the cells; each meets dozens of them.
EACH = 5000
#: A cell that holds more than this share of the points is met by broadcast; there are at most as many a level.
HOT_SHARE = 1000
_BOX = [f"{e}_{a}" for e in ("low", "high") for a in AXES]
_CORNER = ["cx", "cy", "cz"]
_CELL = ["level", *_CORNER]


@dataclass(frozen=True)
class Tree:
    """Cells of a cloud at several levels: a cell is divided in eight as long as it holds more than k points at several places.

    leaves(q, ox, oy, oz, level, cx, cy, cz) are the points in the undivided cells. cells(level, cx, cy, cz, n, box, leaf,
    at, parts) are all cells with the bounds of their points; at is the deepest cell with the same points, and parts
    are the cells that one is divided into. low and size place level 0."""

    leaves: DataFrame
    cells: DataFrame
    low: tuple[float, float, float]
    size: float
    depth: int
    leaf_levels: list[int]
    n: int


def _index(place: Column, low: float, size: float) -> Column:
    """The number of the deepest cell along an axis; what lies outside counts to the outermost."""
    share = F.least(F.greatest((place - low) / size, g.real(0)), g.real(1))
    return F.least(F.floor(share * float(1 << DEEPEST)), F.lit((1 << DEEPEST) - 1)).cast("long")


def _cell(index: str) -> Column:
    """The number of the cell of a row's level that holds a deepest cell."""
    return F.expr(f"shiftright({index}, {DEEPEST} - level)")


def _met(rows: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """rows joined to cells, where very many rows may name one cell: the cells that hold more than a thousandth of the
    n points are broadcast (a thousand a level at most), and only rows of the others are moved."""
    hot = F.broadcast(cells.where(F.col("n") > n / HOT_SHARE))
    return rows.join(hot, _CELL).unionByName(rows.join(hot.select(*_CELL), _CELL, "left_anti").join(cells.where(F.col("n") <= n / HOT_SHARE), _CELL))


def tree(others: DataFrame, k: int, key: str = "point_id") -> Tree | None:
    """The cells of others(key, x, y, z), None without a point. Of points at one place the k + 1 smallest ids are enough
    for any search for k; points without a place are left out."""
    own = others.select(F.col(key).alias("q"), *(F.col(a).cast("double").alias(f"o{a}") for a in AXES)).where(" and ".join(f"o{a} is not null and not isnan(o{a})" for a in AXES))
    place = [f"o{a}" for a in AXES]
    single = own.withColumn("same", F.row_number().over(Window.partitionBy(*place).orderBy("q"))).where(F.col("same") <= k + 1).drop("same")
    live = durable(single, "places")
    facts = live.agg(F.count("*").alias("n"), *(f(f"o{a}").alias(f"{e}_{a}") for e, f in (("low", F.min), ("high", F.max)) for a in AXES)).first()
    if not facts["n"]:
        return None
    low = tuple(facts[f"low_{a}"] for a in AXES)
    size = max(facts[f"high_{a}"] - facts[f"low_{a}"] for a in AXES) or 1.0
    index = [f"i{a}" for a in AXES]
    live = live.withColumns({f"i{a}": _index(F.col(f"o{a}"), low[i], size) for i, a in enumerate(AXES)})
    start, cells, leaves, leaf_levels = 0, None, None, set()
    several = " or ".join(f"low_{a} < high_{a}" for a in AXES)
    while True:
        end = min(start + STEP, DEEPEST + 1)
        here = live.withColumn("level", F.explode(F.sequence(F.lit(start), F.lit(end - 1)))).withColumns({f"c{a}": _cell(f"i{a}") for a in AXES})
        counted = here.groupBy(*_CELL).agg(F.count("*").alias("n"), F.min("q").alias("least"), *(F.min(f"o{a}").alias(f"low_{a}") for a in AXES), *(F.max(f"o{a}").alias(f"high_{a}") for a in AXES))
        counted = durable(counted.withColumn("leaf", F.expr(f"n <= {k} or level = {DEEPEST} or not ({several})")), "cells")
        # the cells below an undivided one don't exist
        divided = counted.where("not leaf").select((F.col("level") + 1).alias("level"), *(F.col(c).alias(f"p{c}") for c in _CORNER))
        inner = counted.where(F.col("level") > start).withColumns({f"p{c}": F.shiftright(c, 1) for c in _CORNER})
        real = counted.where(F.col("level") == start).unionByName(inner.join(divided, ["level", *(f"p{c}" for c in _CORNER)], "left_semi").select(*counted.columns))
        cells = real if cells is None else cells.unionByName(real)
        told = _met(here, counted.select(*_CELL, "n", "leaf"), facts["n"]).where("leaf").groupBy("q").agg(F.min("level").alias("level"))
        told = durable(live.join(told, "q", "left"), "points")
        leaves_here = told.where("level is not null").withColumns({f"c{a}": _cell(f"i{a}") for a in AXES}).select("q", *place, *_CELL)
        leaves = leaves_here if leaves is None else leaves.unionByName(leaves_here)
        leaf_levels |= {r["level"] for r in told.where("level is not null").select("level").distinct().collect()}  # STEP rows at most
        live = told.where("level is null").select("q", *place, *index)
        start = end
        if not live.take(1):
            break
    # one chain of cells with the same points: they share their number and their least id, and the deepest stands for all
    bottom = cells.groupBy("least", "n", *_BOX).agg(F.max(F.struct(*_CELL, "leaf")).alias("at"))
    cells = durable(cells.join(bottom, ["least", "n", *_BOX]).drop("leaf"), "chains").select("*", F.col("at.leaf").alias("leaf"))
    up = cells.where("level > 0").select((F.col("level") - 1).alias("level"), *(F.shiftright(c, 1).alias(c) for c in _CORNER), F.struct("at", F.col("n").alias("n"), *_BOX).alias("part"))
    parts = up.groupBy(*_CELL).agg(F.collect_list("part").alias("parts"))  # eight at most
    return Tree(leaves, durable(cells.join(parts, _CELL, "left"), "tree"), low, size, max(leaf_levels), sorted(leaf_levels), facts["n"])


def _near2(box: str = "") -> Column:
    """The squared distance to the nearest place in a box, in the order of within()'s sum."""
    gap = [F.greatest(F.col(f"{box}low_{a}") - F.col(a), F.col(a) - F.col(f"{box}high_{a}"), g.real(0)) for a in AXES]
    return gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]


def _far2(box: str = "") -> Column:
    gap = [F.greatest(F.abs(F.col(f"{box}low_{a}") - F.col(a)), F.abs(F.col(a) - F.col(f"{box}high_{a}"))) for a in AXES]
    return gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]


def nearest(points: DataFrame, others: DataFrame, k: int, key: str = "point_id", widest: float | None = None) -> DataFrame:
    """The k nearest others of each point (point, other, d2, rank), at most `widest` apart if given; equal distances by id.

    A point never meets its own id; points without a place are left out. The others are divided into cells of at most k
    points. Each point starts with a distance within which its own cells show more than k others, takes the cells that
    reach so far, narrows the distance by their counts and bounds, and divides those that can be divided, until
    none can; then it meets the points of what is left. So what a point meets follows k and not how dense
    the cloud is anywhere: a cell with a third of all points is divided like any other."""
    t = tree(others, k, key)
    out = "point long, other long, d2 double, rank int"
    if t is None:
        kind = points.schema[key].dataType
        return points.sparkSession.createDataFrame([], out).select(F.col("point").cast(kind).alias("point"), F.col("other").cast(kind).alias("other"), "d2", "rank")
    p = points.select(F.col(key).alias("p"), *(F.col(a).cast("double").alias(a) for a in AXES)).where(" and ".join(f"{a} is not null and not isnan({a})" for a in AXES))
    index = {f"i{a}": _index(F.col(a), t.low[i], t.size) for i, a in enumerate(AXES)}
    levels = F.explode(F.sequence(F.lit(0), F.lit(t.depth))).alias("level")
    asked = p.withColumns(index).select("*", levels).withColumns({f"c{a}": _cell(f"i{a}") for a in AXES}).drop(*index)
    own = _met(asked, t.cells.where(F.col("n") > k).select(*_CELL, "n", *_BOX), t.n).groupBy("p").agg(F.min(_far2()).alias("r2"))
    # a cloud of k points or fewer is met whole
    known = p.join(own, "p", "left") if t.n > k else p.withColumn("r2", F.lit(None).cast("double"))
    reach2 = F.coalesce("r2", F.lit(float("inf")))
    if widest is not None:
        reach2 = F.least(reach2, g.real(widest * widest))
    # few bytes that become many rows: left to Spark's sizes, one task would look for all of them
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, t.n // EACH)
    known = known.repartition(tasks, "p").withColumn("r2", reach2).withColumn("r", F.sqrt("r2") * (1 + 1e-9))
    # the level whose cells are at least half as wide as the distance, so that few of them reach across it
    finest = F.when(F.col("r") > 0, F.floor(F.log2(g.real(2 * t.size) / F.col("r")))).otherwise(t.depth)
    known = known.withColumn("m", F.greatest(F.least(finest, F.lit(t.depth)), F.lit(0)).cast("int"))
    above = F.array(*(F.lit(j) for j in t.leaf_levels))
    looks = known.withColumn("level", F.explode(F.concat(F.filter(above, lambda j: j < F.col("m")), F.array("m"))))
    for i, a in enumerate(AXES):
        ends = {"first": _index(F.col(a) - F.col("r"), t.low[i], t.size), "last": _index(F.col(a) + F.col("r"), t.low[i], t.size)}
        looks = looks.withColumns(ends).withColumn(f"c{a}", F.explode(F.sequence(_cell("first"), _cell("last")))).drop("first", "last")
    # coarser cells count only where they are not divided
    found = _met(looks, t.cells.select(*_CELL, "n", "leaf", "at", *_BOX), t.n).where((F.col("level") == F.col("m")) | (F.col("leaf") & (F.col("at.level") == F.col("level"))))
    front = found.select("p", *AXES, "r2", "at", "n", _near2().alias("near2"), _far2().alias("far2")).where("near2 <= r2")
    reached = Window.partitionBy("p")
    while True:
        # places up to far2 that hold more than k points, the point itself perhaps among them, bound the distance
        sure = F.sum("n").over(reached.orderBy("far2").rowsBetween(Window.unboundedPreceding, 0))
        bound = F.min(F.when(F.col("sure") > k, F.col("far2"))).over(reached)
        front = front.withColumn("sure", sure).withColumn("r2", F.least("r2", bound)).drop("sure").where("near2 <= r2")
        front = durable(front, "front")
        wide = front.where("not at.leaf")
        if not wide.take(1):
            break
        parts = t.cells.where("not leaf and at.level = level").select(*_CELL, "n", "parts")
        met = _met(wide.select("p", *AXES, "r2", *(F.col(f"at.{c}").alias(c) for c in _CELL)), parts, t.n).select("p", *AXES, "r2", F.explode("parts").alias("part"))
        met = met.select("p", *AXES, "r2", "part.*").select("p", *AXES, "r2", "at", "n", _near2().alias("near2"), _far2().alias("far2")).where("near2 <= r2")
        front = front.where("at.leaf").unionByName(met)
    d2 = sum(((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in AXES[1:]), (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")))
    pairs = front.select("p", *AXES, "r2", *(F.col(f"at.{c}").alias(c) for c in _CELL)).join(t.leaves, _CELL).where(F.col("p") != F.col("q")).withColumn("d2", d2).where("d2 <= r2")
    rank = F.row_number().over(Window.partitionBy("p").orderBy("d2", "q"))
    return pairs.select(F.col("p"), "q", "d2").withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("p").alias("point"), F.col("q").alias("other"), "d2", "rank")


@dataclass(frozen=True)
class Ladder:
    """What match() looks at: others without copies that can't be nearest, and how often the radius is halved at first."""

    others: DataFrame
    steps: int


def ladder(others: DataFrame, radius: float, key: str = "point_id", by: tuple[str, ...] = ()) -> Ladder:
    """Of others at one place (of a group) the two smallest ids stay, as a point may be the smallest itself; the radius is
    halved until a cell that is in use would hold about one of them."""
    rank = F.row_number().over(Window.partitionBy(*by, *AXES).orderBy(key))
    single = durable(others.select(*by, key, *AXES).withColumn("same", rank).where("same <= 2").drop("same"), "places")
    cells = with_cell(single, radius).groupBy(*by, "cx", "cy", "cz").agg(F.count("*").alias("n"))
    share = cells.agg(F.avg("n").alias("share")).first()["share"] or 1.0
    return Ladder(single, min(DEEPEST, max(0, ceil(log2(share) / 3))))


def match(points: DataFrame, others: DataFrame | Ladder, radius: float, key: str = "point_id", by: tuple[str, ...] = (), apart: bool = True) -> DataFrame:
    """The nearest other of each point within the radius (of its group), of equal ones the smallest id; points without one
    have no row.

    A point first looks within a small part of the radius, where few others are however dense the cloud is, and those that
    found none look twice as far, up to the radius; so what a point meets doesn't grow with the square of the density.
    others may be a ladder() of the same radius, key and groups, made once for several calls."""
    rungs = others if isinstance(others, Ladder) else ladder(others, radius, key, by)
    left, found = points.select(*by, key, *AXES), None
    for step in range(rungs.steps, -1, -1):
        best = within(left, rungs.others, radius / 2**step, key, by=by, apart=apart).groupBy(*by, "point").agg(F.min(F.struct("d2", "other")).alias("b"))
        here = best.select(*by, "point", F.col("b.other").alias("other"), F.col("b.d2").alias("d2"))
        here = durable(here, "matched") if step else here
        found = here if found is None else found.unionByName(here)
        if step:
            left = durable(left.join(here.select(*by, F.col("point").alias(key)).hint("merge"), [*by, key], "left_anti"), "unmatched")
    return found
