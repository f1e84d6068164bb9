"""Path planning on occupancy grids: cost fields by relaxation of tiles, paths by pointer doubling, and random trees."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..iterate import durable
from .raster import offsets, spread

#: The eight neighbours and the cost of a step to each.
STEPS = [(dx, dy, math.hypot(dx, dy)) for dx, dy in offsets(1, lambda dx, dy: dx or dy)]


#: Cells along a side of the tiles that are relaxed as wholes.
TILE = 64


def _relaxed(by: list[str]):
    """A function that takes a tile's cells (by..., gx, gy, cost, offer) to their least costs, and to whether they fell.

    Rows that offer a cost count only where the tile has that cell; steps inside the tile are repeated until nothing falls."""
    import pyarrow as pa

    def relax(t: pa.Table) -> pa.Table:
        x, y, cost, offer = (t.column(n).to_numpy() for n in ("gx", "gy", "cost", "offer"))
        x0, y0, cost = x.min() - 1, y.min() - 1, np.where(np.isnan(cost), np.inf, cost)
        at = x - x0, y - y0
        w, h = (int(p.max()) for p in at)
        before = np.full((w + 2, h + 2), np.inf)  # with a rim of cells that nothing reaches
        free = np.zeros(before.shape, dtype=bool)
        now = before.copy()
        for grid, rows in ((before, ~offer), (now, slice(None))):
            np.minimum.at(grid, tuple(p[rows] for p in at), cost[rows])
        free[tuple(p[~offer] for p in at)] = True
        now[~free] = np.inf
        moves = (now < before - 1e-9).any()
        while moves:
            least = now.copy()
            for dx, dy, c in STEPS:
                inner = least[1:-1, 1:-1]
                np.minimum(inner, now[1 + dx : w + 1 + dx, 1 + dy : h + 1 + dy] + c, out=inner)
            least[~free] = np.inf
            moves, now = (least < now - 1e-9).any(), least
        px, py = np.nonzero(free)
        cost = now[px, py]
        out = {c: pa.repeat(t.column(c)[0], len(px)) for c in by} | {"gx": pa.array(px + x0, t.schema.field("gx").type), "gy": pa.array(py + y0, t.schema.field("gy").type)}
        return pa.table(out | {"cost": pa.array(cost, mask=np.isinf(cost)), "fell": pa.array(cost < before[px, py] - 1e-9)})

    return relax


def cost_fields(free: DataFrame, starts: DataFrame, by: tuple[str, ...] = ("scan_id",), side: int = TILE) -> DataFrame:
    """(by..., gx, gy, cost, from_x, from_y): the least cost from a scan's start to each of its free cells that it reaches, and
    the cell before. starts(by..., gx, gy) are cells; one that isn't free reaches nothing, several of a scan are one source.

    Grids are cut into tiles of side x side cells. In each round every tile relaxes its cells until nothing falls in it, and
    cells that fell offer their costs across the tile's border; the loop ends when nothing is offered. So rounds follow
    the tiles that a path crosses, and no task holds more than a tile. Of cells before with one cost the least by gx,
    then gy, counts; a start has none."""
    by = list(by)
    key = [*by, "gx", "gy"]
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), g.real(c).alias("c")) for dx, dy, c in STEPS))
    free = free.select(*key).dropna()

    def spread_costs(cells: DataFrame, moves, *more) -> DataFrame:
        return cells.withColumn("s", F.explode(moves)).select(*by, (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"), (F.col("cost") + F.col("s.c")).alias("cost"), *more)

    def tile(a: str, shift=0):
        return F.floor((F.col(a) + shift) / side)

    schema = ", ".join(f"`{c}` {free.schema[c].dataType.simpleString()}" for c in key) + ", cost double, fell boolean"
    cells = free.withColumn("cost", F.lit(None).cast("double"))
    offers = starts.select(*key).dropna().distinct().withColumn("cost", g.real(0))
    crossing = F.filter(steps, lambda s: (tile("gx", s["dx"]) != tile("gx")) | (tile("gy", s["dy"]) != tile("gy")))
    while True:
        rows = cells.withColumn("offer", F.lit(False)).unionByName(offers.withColumn("offer", F.lit(True)))
        told = durable(rows.groupBy(*by, tile("gx").alias("tile_x"), tile("gy").alias("tile_y")).applyInArrow(_relaxed(by), schema), "costs")
        cells, offers = told.drop("fell"), spread_costs(told.where("fell"), crossing)
        if offers.isEmpty():
            break
    known = cells.where("cost is not null")
    # sums differ in their last digits by the way taken; costs this close are one
    before = spread_costs(known, steps, F.col("gx").alias("from_x"), F.col("gy").alias("from_y")).groupBy(*key).agg(
        F.min(F.struct(F.round("cost", 6).alias("cost"), "from_x", "from_y")).alias("b"))
    told = known.join(before, key, "left")
    moved = F.col("cost") > 0
    return durable(told.select(*key, "cost", F.when(moved, F.col("b.from_x")).alias("from_x"), F.when(moved, F.col("b.from_y")).alias("from_y")), "fields")


def field_paths(fields: DataFrame, goals: DataFrame, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """(by..., goal_x, goal_y, seq, gx, gy): the cells from the start to each goal(by..., gx, gy) that fields reaches, seq from 0.

    Each cell's pointer to the cell before doubles its reach in every round, and the levels are written; then a path's
    known cells are joined to them from the longest reach down, doubling again. So a path of n cells takes
    about 2 log2(n) jobs, however many paths there are, and no path is walked by one task."""
    by = list(by)
    key = [*by, "gx", "gy"]
    levels = [fields.where("from_x is not null").select(*key, F.col("from_x").alias("to_x"), F.col("from_y").alias("to_y"))]
    while True:
        last = levels[-1]
        ahead = last.select(*by, F.col("gx").alias("to_x"), F.col("gy").alias("to_y"), F.col("to_x").alias("then_x"), F.col("to_y").alias("then_y"))
        further = durable(last.join(ahead, [*by, "to_x", "to_y"]).select(*key, F.col("then_x").alias("to_x"), F.col("then_y").alias("to_y")), "pointers")
        if not further.take(1):
            break
        levels.append(further)
    asked = goals.select(*key).distinct().join(fields.select(*key), key, "left_semi")
    found = durable(asked.select(*by, F.col("gx").alias("goal_x"), F.col("gy").alias("goal_y"), "gx", "gy", F.lit(0).cast("long").alias("back")), "steps")
    for k in range(len(levels) - 1, -1, -1):
        further = found.join(levels[k], key).select(*by, "goal_x", "goal_y", F.col("to_x").alias("gx"), F.col("to_y").alias("gy"), (F.col("back") + (1 << k)).alias("back"))
        found = durable(found.unionByName(further), "steps")
    length = found.groupBy(*by, "goal_x", "goal_y").agg(F.max("back").alias("most"))
    return found.join(length, [*by, "goal_x", "goal_y"]).select(*by, "goal_x", "goal_y", (F.col("most") - F.col("back")).alias("seq"), "gx", "gy")


def cost_field(free: DataFrame, start: tuple[int, int], side: int = TILE) -> DataFrame:
    """(gx, gy, cost): the cost field of one grid from one cell."""
    at = free.sparkSession.createDataFrame([start], "gx int, gy int")
    return cost_fields(free, at, (), side).select("gx", "gy", "cost")


def plan_paths(free: DataFrame, requests: DataFrame) -> DataFrame:
    """The cheapest paths of requests(scan_id, sx, sy, tx, ty) over free(scan_id, gx, gy), a row for each cell:
    (scan_id, sx, sy, tx, ty, status, seq, gx, gy, nodes_explored, path_length_grid, path_cost_cells).

    status is ok, no_path, or blocked where start or goal is not free; the latter two give one row without a cell. All
    requests are planned in one job, by the cost field of each start and pointers that double; repeated
    ones once. nodes_explored counts the cells that a best-first search to the goal has to settle: those whose cost and
    straight way to the goal are no more than the path's cost, or all that are reached where there is no path."""
    start, goal = ["scan_id", "sx", "sy"], ["tx", "ty"]
    asked = durable(requests.select(*start, *goal).distinct(), "asked")
    starts = asked.select(*start).distinct()
    grids = free.select("scan_id", "gx", "gy").join(starts, "scan_id")  # a copy of a scan's grid for each start
    fields = cost_fields(grids, starts.select(*start, F.col("sx").alias("gx"), F.col("sy").alias("gy")), tuple(start))
    steps = field_paths(fields, asked.select(*start, F.col("tx").alias("gx"), F.col("ty").alias("gy")), tuple(start)).withColumnsRenamed({"goal_x": "tx", "goal_y": "ty"})
    ends = [free.select("scan_id", F.col("gx").alias(x), F.col("gy").alias(y), F.lit(True).alias(f"{x}_free")) for x, y in (("sx", "sy"), ("tx", "ty"))]
    told = asked.join(ends[0], start, "left").join(ends[1], ["scan_id", *goal], "left")
    reached = fields.select(*start, F.col("gx").alias("tx"), F.col("gy").alias("ty"), F.col("cost").alias("path_cost_cells"))
    told = told.join(reached, [*start, *goal], "left")
    open_ends = F.col("sx_free").isNotNull() & F.col("tx_free").isNotNull()
    told = told.withColumn("status", F.when(~open_ends, "blocked").when(F.col("path_cost_cells").isNull(), "no_path").otherwise("ok")).drop("sx_free", "tx_free")
    told = durable(told, "told")
    within = F.col("path_cost_cells").isNull() | (F.col("cost") + F.hypot(F.col("gx") - F.col("tx"), F.col("gy") - F.col("ty")) <= F.col("path_cost_cells") + 1e-9)
    seen = fields.select(*start, "gx", "gy", "cost").join(told.where("status <> 'blocked'"), start).where(within).groupBy(*start, *goal).agg(F.count("*").alias("n"))
    length = steps.groupBy(*start, *goal).agg(F.count("*").alias("path_length_grid"))
    told = told.join(seen, [*start, *goal], "left").join(length, [*start, *goal], "left").join(steps, [*start, *goal], "left")
    return told.select(*start, *goal, "status", F.col("seq").cast("int").alias("seq"), F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), F.coalesce("n", F.lit(0)).alias("nodes_explored"), F.coalesce("path_length_grid", F.lit(0)).alias("path_length_grid"), "path_cost_cells")


def path_statistics(paths: DataFrame, resolution: float) -> DataFrame:
    """One row for each scan: success, nodes, cells, cost in cells and length in metres."""
    from .frames import path_length

    world = paths.where("status = 'ok'").select("scan_id", "seq", (F.col("gx") * resolution).alias("x"), (F.col("gy") * resolution).alias("y"))
    stats = paths.groupBy("scan_id").agg(F.first("status").alias("status"), F.max("nodes_explored").alias("nodes_explored"), F.max("path_length_grid").alias("path_length_grid"), F.max("path_cost_cells").alias("path_cost_cells"))
    return stats.join(path_length(world), "scan_id", "left").select(F.lit("A*").alias("algorithm"), "*", (F.col("status") == "ok").alias("success"))


def clear_segments(segments: DataFrame, free: DataFrame, info: DataFrame, key: str = "segment_id") -> DataFrame:
    """Which segments (x1, y1, x2, y2) stay on free cells, sampled every half cell."""
    s = segments.crossJoin(F.broadcast(info.select("resolution", "x0", "y0")))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    s = s.withColumn("steps", (length / (F.col("resolution") * 0.5)).cast("int") + 1)
    at = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps")))).withColumn("t", F.col("i") / F.col("steps"))
    xy = {a: F.col(f"{a}1") + F.col("t") * (F.col(f"{a}2") - F.col(f"{a}1")) for a in "xy"}
    cells = at.select(key, g.to_cell(xy["x"], "x0", F.col("resolution")).alias("gx"), g.to_cell(xy["y"], "y0", F.col("resolution")).alias("gy")).distinct()
    known = cells.join(free.select("gx", "gy", F.lit(True).alias("ok")), ["gx", "gy"], "left")
    return known.groupBy(key).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("clear"))


def nearest_node(nodes: DataFrame, x: float, y: float) -> DataFrame:
    """The tree node nearest to a place; of equals the smallest id."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return nodes.agg(F.min(F.struct(d.alias("distance"), "node_id")).alias("n")).select("n.node_id", "n.distance")


TREE = "scan_id string, seed int, success boolean, iterations long, nodes_in_tree long, seq int, x double, y double"


def random_trees(free: DataFrame, requests: DataFrame, seeds: int = 4, iterations: int = 5000, step: float = 0.5, goal_share: float = 0.1) -> DataFrame:
    """RRT from start to goal, many seeds side by side; the waypoints of each seed's path.

    requests(scan_id, resolution, x0, y0, nx, ny, x1, y1, x2, y2) in metres. A seed without a path gives
    one row without a waypoint. A sample equal to a node is skipped, so no node is its own parent."""
    asked = requests.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    space = free.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))

    def grow(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows, cells = [], set(zip(b["gx"].tolist(), b["gy"].tolist()))
        for r in a.itertuples(index=False):
            rng = np.random.default_rng(int(r.seed))

            def open_(p, q):
                n = int(math.dist(p, q) / (r.resolution * 0.5)) + 1
                return all((int((p[0] + k / n * (q[0] - p[0]) - r.x0) / r.resolution), int((p[1] + k / n * (q[1] - p[1]) - r.y0) / r.resolution)) in cells for k in range(n + 1))

            nodes, parent, goal, path = np.array([[r.x1, r.y1]]), [-1], (r.x2, r.y2), []
            done = 0
            for done in range(1, iterations + 1):
                to = goal if rng.random() < goal_share else (r.x0 + rng.random() * r.nx * r.resolution, r.y0 + rng.random() * r.ny * r.resolution)
                k = int(((nodes - to) ** 2).sum(axis=1).argmin())
                at, far = tuple(nodes[k]), math.dist(nodes[k], to)
                if far == 0:
                    continue
                new = to if far <= step else (at[0] + step * (to[0] - at[0]) / far, at[1] + step * (to[1] - at[1]) / far)
                if not open_(at, new):
                    continue
                nodes, _ = np.vstack([nodes, new]), parent.append(k)
                if math.dist(new, goal) <= step and open_(new, goal):
                    path, k = ([] if new == goal else [goal]), len(parent) - 1
                    while k >= 0:
                        path.append(tuple(nodes[k]))
                        k = parent[k]
                    break
            rows += [(r.scan_id, r.seed, True, done, len(parent), i, *p) for i, p in enumerate(reversed(path))] or [(r.scan_id, r.seed, False, done, len(parent), None, None, None)]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in TREE.split(", ")]).astype({"seq": "Int32"})

    return asked.groupBy("scan_id", "seed").cogroup(space.groupBy("scan_id", "seed")).applyInPandas(grow, TREE)


def overlay_pixels(path: DataFrame, meta: DataFrame) -> DataFrame:
    """Waypoints on the floor plan's raster, and the pixels of the lines between them."""
    from .frames import segments

    at = path.crossJoin(F.broadcast(meta)).withColumns(g.to_pixel("x", "y", "x_min", "y_max", "resolution"))
    lines = segments(at.select("scan_id", "seq", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))).where("next_x is not null")
    n = F.greatest(F.abs(F.col("next_x") - F.col("x")), F.abs(F.col("next_y") - F.col("y"))).cast("int")
    dots = lines.withColumn("n", F.greatest(n, F.lit(1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    place = lambda a: F.round(F.col(a) + F.col("i") / F.col("n") * (F.col(f"next_{a}") - F.col(a))).cast("int")
    return dots.select("scan_id", place("x").alias("px"), place("y").alias("py")).distinct()
