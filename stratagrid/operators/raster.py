"""Grids and rasters as sparse relations of set cells, with one row of facts beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FLOOR, GRID
from ..functions import geometry as g
from ..iterate import durable
from . import cloud


def offsets(reach: int, keep=lambda dx, dy: True) -> list[tuple[int, int]]:
    return [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if keep(dx, dy)]


def spread(cells: DataFrame, shifts: list[tuple[int, int]], x: str = "gx", y: str = "gy") -> DataFrame:
    """Every cell moved by every shift (repeated cells stay)."""
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in shifts))
    return cells.withColumn("s", F.explode(steps)).withColumns({x: F.col(x) + F.col("s.dx"), y: F.col(y) + F.col("s.dy")}).drop("s")


def beside(rows: DataFrame, info: DataFrame, by: list[str] | None, *names: str) -> DataFrame:
    """rows with facts of their grid: joined by scan where there are many, else the single row beside each."""
    facts = info.select(*(by or []), *names) if names else info
    return rows.join(facts, by) if by else rows.crossJoin(F.broadcast(facts))


def grid_info(points: DataFrame, resolution: float = GRID.resolution, by: list[str] | None = None) -> DataFrame:
    """A row (for each scan): origin and size of the grid over the points, at least one cell each way."""
    b = cloud.bounds(points, by)
    cells = {n: F.greatest(F.lit(1), F.ceil((F.col(f"{a}_max") - F.col(f"{a}_min")) / g.real(resolution)).cast("int")) for n, a in (("nx", "x"), ("ny", "y"))}
    return b.where("n > 0").select(*(by or []), g.real(resolution).alias("resolution"), F.col("x_min").alias("x0"), F.col("y_min").alias("y0"), *(v.alias(n) for n, v in cells.items()))


def cells_of(points: DataFrame, info: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The cell of each point; coordinates beyond the last cell count for it."""
    x, y = (F.greatest(F.lit(0), F.least(F.col(n) - 1, g.to_cell(a, f"{a}0", F.col("resolution")))) for a, n in (("x", "nx"), ("y", "ny")))
    return beside(points, info, by).select(*(by or []), x.alias("gx"), y.alias("gy"))


def occupied(points: DataFrame, info: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct cells that hold points."""
    return cells_of(points, info, by).distinct()


def inflate(cells: DataFrame, info: DataFrame, margin: int = GRID.margin, by: list[str] | None = None) -> DataFrame:
    """Cells within `margin` of a set one, each way, inside the grid."""
    near = spread(cells, offsets(margin)).distinct()
    return beside(near, info, by, "nx", "ny").where("gx >= 0 and gx < nx and gy >= 0 and gy < ny").drop("nx", "ny")


def occupancy(points: DataFrame, resolution: float = GRID.resolution, height: float = GRID.height, half: float = GRID.half_height, margin: int = GRID.margin, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Occupancy grid of a cloud's height slice: (inflated occupied cells, grid facts).

    by: the columns that tell scans apart; each then has a grid of its own, all in one job."""
    level = cloud.closed_slice(points, height, half)
    info = durable(grid_info(level, resolution, by), "grid")  # a row a scan, else the points are read again wherever it is used
    return inflate(occupied(level, info, by), info, margin, by), info


def free_cells(occ: DataFrame, info: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All cells of the grid that are not occupied."""
    own = by or []
    every = info.select(*own, F.explode(F.sequence(F.lit(0), F.col("nx") * F.col("ny") - 1)).alias("i"), "ny").select(*own, F.expr("i div ny").cast("int").alias("gx"), (F.col("i") % F.col("ny")).cast("int").alias("gy"))
    return every.join(occ, [*own, "gx", "gy"], "left_anti")


def occupancy_ratio(occ: DataFrame, info: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n_occupied, n_cells, percent) of each grid; one without an occupied cell has 0."""
    own = by or []
    n = occ.groupBy(*own).agg(F.count("*").alias("n"))
    both = info.join(n, own, "left") if own else info.crossJoin(F.broadcast(n))
    found, cells = F.coalesce("n", F.lit(0)), F.col("nx") * F.col("ny")
    return both.select(*own, found.alias("n_occupied"), cells.cast("long").alias("n_cells"), (found * 100.0 / cells).alias("percent"))


def blueprint_meta(points: DataFrame, padding: float = FLOOR.padding, resolution: int = FLOOR.pixels_per_metre, by: list[str] | None = None) -> DataFrame:
    """A row (for each scan): the floor plan's limits and size in pixels."""
    b = cloud.bounds(points, by).where("n > 0")
    limits = b.select(*(by or []), F.lit(resolution).alias("resolution"), *((F.col(f"{a}_min") - padding).alias(f"{a}_min") for a in "xy"), *((F.col(f"{a}_max") + padding).alias(f"{a}_max") for a in "xy"))
    return limits.withColumns({"img_width": ((F.col("x_max") - F.col("x_min")) * F.col("resolution")).cast("int"), "img_height": ((F.col("y_max") - F.col("y_min")) * F.col("resolution")).cast("int")})


_IN_IMAGE = "px >= 0 and px < img_width and py >= 0 and py < img_height"


def splat(points: DataFrame, meta: DataFrame, radius: int = FLOOR.dot_radius, by: list[str] | None = None) -> DataFrame:
    """Pixels of discs around the points' pixels, inside the image."""
    own = by or []
    at = beside(points, meta, by).select(*own, *(v.alias(k) for k, v in g.to_pixel("x", "y", "x_min", "y_max", "resolution").items()), "img_width", "img_height")
    centre = at.where(_IN_IMAGE).distinct()
    disc = offsets(radius, lambda dx, dy: dx * dx + dy * dy <= radius * radius)
    return spread(centre, disc, "px", "py").where(_IN_IMAGE).select(*own, "px", "py").distinct()


def dilate(pixels: DataFrame, meta: DataFrame, size: int = FLOOR.close_size, by: list[str] | None = None) -> DataFrame:
    wide = spread(pixels, offsets(size // 2), "px", "py").distinct()
    return beside(wide, meta, by, "img_width", "img_height").where(_IN_IMAGE).select(*(by or []), "px", "py")


def erode(pixels: DataFrame, meta: DataFrame, size: int = FLOOR.close_size, by: list[str] | None = None) -> DataFrame:
    """Pixels whose whole neighbourhood inside the image is set."""
    r, own = size // 2, by or []
    votes = spread(pixels, offsets(r), "px", "py").groupBy(*own, "px", "py").agg(F.count("*").alias("n"))
    span = lambda p, n: F.least(F.col(p) + r, F.col(n) - 1) - F.greatest(F.col(p) - r, F.lit(0)) + 1
    full = span("px", "img_width") * span("py", "img_height")
    return beside(votes, meta, by, "img_width", "img_height").where(_IN_IMAGE).where(F.col("n") == full).select(*own, "px", "py")


def close(pixels: DataFrame, meta: DataFrame, size: int = FLOOR.close_size, by: list[str] | None = None) -> DataFrame:
    return erode(dilate(pixels, meta, size, by), meta, size, by)


def boundary(pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Set pixels with an unset neighbour to the left, right, above or below: the edge image of a mask."""
    own = by or []
    cross = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    inner = spread(pixels, cross, "px", "py").groupBy(*own, "px", "py").agg(F.count("*").alias("n")).where("n = 4")
    return pixels.join(inner.select(*own, "px", "py"), [*own, "px", "py"], "left_anti")


def components(pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., px, py, comp): 8-connected regions, named by their least pixel number (in their scan).

    Runs of set pixels along a row are the nodes, runs that touch in adjacent rows are linked. Each round hooks every
    region to the least region it touches, follows the hooks to their ends by doubling pointers, and keeps only links
    between regions that are still apart; so a region's height or windings cost rounds by their logarithm. Rounds are
    written tables. Repeated pixels stay repeated."""
    own = by or []
    number = (F.col("py").cast("long") * (1 << 31)) + F.col("px")
    line = Window.partitionBy(*own, "py").orderBy("px")
    # pixels of one run share the place of their row minus how many stand before them
    placed = pixels.select(*own, "px", "py").where("px is not null and py is not null").withColumn("shift", F.col("px").cast("long") - F.dense_rank().over(line))
    run = F.min(number).over(Window.partitionBy(*own, "py", "shift"))
    runs = durable(placed.withColumn("run", run).drop("shift"), "runs")
    below = runs.select(*own, "run", (F.col("py") + 1).alias("py"), F.explode(F.array(*(F.col("px") + dx for dx in (-1, 0, 1)))).alias("px"))
    met = below.withColumnRenamed("run", "a").join(runs.withColumnRenamed("run", "b").hint("merge"), [*own, "px", "py"])
    links = durable(met.select(*own, "a", "b").distinct(), "links")
    labels = None
    while links.take(1):
        both = links.unionByName(links.select(*own, F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(*own, F.col("a").alias("name")).agg(F.min("b").alias("least"))
        hooks = durable(hooks.select(*own, "name", F.least("name", "least").alias("to")), "hooks")
        while True:
            further = hooks.select(*own, F.col("name").alias("to"), F.col("to").alias("then"))
            after = durable(hooks.join(further.hint("merge"), [*own, "to"]).select(*own, "name", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")), "hooks")
            hooks = after.drop("moved")
            if not after.where("moved").take(1):
                break
        if labels is None:
            labels = hooks.select(*own, F.col("name").alias("run"), F.col("to").alias("comp"))
        else:
            to = hooks.select(*own, F.col("name").alias("comp"), "to")
            labels = durable(labels.join(to.hint("merge"), [*own, "comp"], "left").select(*own, "run", F.coalesce("to", "comp").alias("comp")), "labels")
        for end in ("a", "b"):
            links = links.join(hooks.select(*own, F.col("name").alias(end), "to").hint("merge"), [*own, end]).drop(end).withColumnRenamed("to", end)
        links = durable(links.where("a <> b").select(*own, "a", "b").distinct(), "links")
    if labels is None:  # no run touches another
        return runs.withColumnRenamed("run", "comp")
    named = runs.join(labels.hint("merge"), [*own, "run"], "left")
    return named.select(*own, "px", "py", F.coalesce("comp", "run").alias("comp"))


#: Directions of a pixel's sides, the pixel on the right hand: east along its top, south, west, north; y points down.
_SIDES = ((0, (0, -1), (0, 0)), (1, (1, 0), (1, 0)), (2, (0, 1), (1, 1)), (3, (-1, 0), (0, 1)))
_AHEAD = ((1, 0), (0, 1), (-1, 0), (0, -1))


def outlines(pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., ring, seq, x, y, inner): the corners of all regions' outlines in order, holes included.

    An outline runs along pixel sides with the region on its right hand; x and y are corners of pixels. A ring is named
    by its least side, seq counts the sides from there on, and only places where it turns are rows. inner says that it
    goes round a hole. Pixels that meet at a corner are one region.

    Every side knows the next; then pointers double, each side keeping the least side it has seen and how far that was.
    When no side sees a lesser one all rings are known: a round for each doubling of the longest ring, all
    rings in one job, and no ring is any task's alone. Repeated pixels count once."""
    own = by or []
    at = pixels.select(*own, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")).distinct()
    sides = []
    for d, (ox, oy), (cx, cy) in _SIDES:
        beyond = at.select(*own, (F.col("px") - ox).alias("px"), (F.col("py") - oy).alias("py"))
        sides.append(at.join(beyond, [*own, "px", "py"], "left_anti").select(*own, (F.col("px") + cx).alias("x"), (F.col("py") + cy).alias("y"), F.lit(d).alias("d")))
    every = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
    ends = [F.element_at(F.array(*(F.lit(a[k]) for a in _AHEAD)), F.col("d") + 1) for k in (0, 1)]
    number = (F.col("y") * (1 << 31) + F.col("x")) * 4 + F.col("d")
    every = durable(every.withColumns({"id": number, "to_x": F.col("x") + ends[0], "to_y": F.col("y") + ends[1]}), "sides")
    starts = every.groupBy(*own, F.col("x").alias("to_x"), F.col("y").alias("to_y")).agg(F.count("*").alias("n"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    # where two sides go on, the left one does: it leads to the pixel that meets this one at the corner
    left = (F.col("d") + 3) % 4
    then = F.when((F.col("n") > 1) & (F.col("d1") == left), F.col("d1")).otherwise(F.col("d0"))
    links = every.join(starts, [*own, "to_x", "to_y"]).withColumn("then", then)
    links = links.withColumn("next", (F.col("to_y") * (1 << 31) + F.col("to_x")) * 4 + F.col("then"))
    turns = links.where(F.col("then") != F.col("d")).select(*own, F.col("next").alias("id"))
    ring = durable(links.select(*own, "id", "next", F.col("id").alias("low"), F.lit(0).cast("long").alias("far")), "rings")
    reach = 1
    while True:
        ahead = ring.select(*own, F.col("id").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"), F.col("far").alias("far2"))
        less = F.col("low2") < F.col("low")
        after = ring.join(ahead, [*own, "next"]).select(*own, "id", F.col("next2").alias("next"), F.least("low", "low2").alias("low"), F.when(less, F.col("far2") + reach).otherwise(F.col("far")).alias("far"), less.alias("less"))
        after = durable(after, "rings")
        ring, reach = after.drop("less"), 2 * reach
        if not after.where("less").take(1):
            break
    placed = ring.select(*own, "id", F.col("low").alias("ring"), "far").join(every, [*own, "id"])
    # twice the area on the right hand: against the clock round a hole
    sizes = placed.groupBy(*own, "ring").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("to_y") - F.col("to_x") * F.col("y")).alias("area"))
    corners = placed.join(turns, [*own, "id"], "left_semi").join(sizes, [*own, "ring"])
    return corners.select(*own, "ring", ((F.col("n") - F.col("far")) % F.col("n")).alias("seq"), "x", "y", (F.col("area") < 0).alias("inner"))


#: The weights of the two gradients, and the tangent of 22.5 degrees in parts of 2^15.
SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))
TANGENT = 13573


def edge_image(image: DataFrame, width: int, height: int, low: int = 50, high: int = 150) -> DataFrame:
    """(px, py): the thin edges of a grey image(px, py, level), 0 where it has no row, by two limits.

    Gradients are weighted sums over each pixel's neighbourhood (outermost pixels stand for those beyond), their size is
    |gx| + |gy|. A pixel stays where that is above `low` and greatest across the edge, and where it is above `high` or
    linked to such a pixel by others that stay. Whole numbers throughout, so nothing depends on the order of a sum."""
    at = image.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1) & (F.col("level") != 0)).select("px", "py", F.col("level").cast("long").alias("level"))
    for c, n in (("px", width), ("py", height)):
        ends = F.concat(F.array(c), F.when(F.col(c) == 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")), F.when(F.col(c) == n - 1, F.array(F.lit(n))).otherwise(F.array().cast("array<int>")))
        at = at.withColumn(c, F.explode(ends))
    moves = F.array(*(F.struct(F.lit(i - 1).alias("dx"), F.lit(j - 1).alias("dy"), F.lit(SOBEL_X[j][i]).alias("wx"), F.lit(SOBEL_Y[j][i]).alias("wy")) for i in range(3) for j in range(3)))
    met = at.withColumn("m", F.explode(moves)).select((F.col("px") - F.col("m.dx")).alias("px"), (F.col("py") - F.col("m.dy")).alias("py"), (F.col("level") * F.col("m.wx")).alias("gx"), (F.col("level") * F.col("m.wy")).alias("gy"))
    inside = met.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
    sums = inside.groupBy("px", "py").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy")).withColumn("size", F.abs("gx") + F.abs("gy"))
    sums = durable(sums.where("size > 0"), "gradients")
    around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    votes = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in around))
    near = sums.withColumn("m", F.explode(votes)).groupBy((F.col("px") - F.col("m.dx")).alias("px"), (F.col("py") - F.col("m.dy")).alias("py")).agg(
        *(F.max(F.when((F.col("m.dx") == dx) & (F.col("m.dy") == dy), F.col("size"))).alias(f"n{k}") for k, (dx, dy) in enumerate(around)))
    size_at = {p: F.coalesce(f"n{k}", F.lit(0)) for k, p in enumerate(around)}
    strong = sums.where(F.col("size") > low).join(near, ["px", "py"], "left")
    x, y = F.abs("gx"), F.shiftleft(F.abs("gy"), 15)
    flat, s = x * TANGENT, F.col("size")
    same = F.col("gx") * F.col("gy") >= 0
    across = F.when(y < flat, (s > size_at[-1, 0]) & (s >= size_at[1, 0])).when(y > flat + F.shiftleft(x, 16), (s > size_at[0, -1]) & (s >= size_at[0, 1])).otherwise(
        F.when(same, (s > size_at[-1, -1]) & (s > size_at[1, 1])).otherwise((s > size_at[1, -1]) & (s > size_at[-1, 1])))
    thin = durable(strong.where(across).select("px", "py", "size"), "thin")
    named = components(thin.select("px", "py")).join(thin, ["px", "py"])
    kept = named.groupBy("comp").agg(F.max("size").alias("most")).where(F.col("most") > high)
    return named.join(kept.select("comp"), "comp", "left_semi").select("px", "py")
