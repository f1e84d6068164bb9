"""Several scans in one job, and files with more than one kind of row."""

import math
import random

import numpy as np

from stratagrid.operators import planning, raster
from stratagrid.plans import pipelines
from stratagrid.sources import images, scan_files


def two_rooms(spark):
    """Two rooms of different sizes and places, each with a wall that has one gap."""
    rows = []
    for scan, size, wall in (("a", 20, 9), ("b", 30, 14)):
        at = 5.0 if scan == "b" else 0.0
        for i in range(size):
            for j in range(size):
                if i in (0, size - 1) or j in (0, size - 1) or (i == wall and j != size // 2):
                    rows.append((scan, at + i * 0.1 + 0.05, at + j * 0.1 + 0.05, 1.0))
    return spark.createDataFrame(rows, "scan_id string, x double, y double, z double")


def test_documents_and_ratios_of_two_scans(spark, tmp_path):
    from stratagrid.config import GridConfig

    points = two_rooms(spark)
    ends = spark.createDataFrame([("a", 0.35, 0.35, 1.65, 1.65), ("b", 5.35, 5.35, 7.65, 7.65)], "scan_id string, start_x double, start_y double, goal_x double, goal_y double")
    planned = pipelines.plan_scan(points, ends, GridConfig(margin=0))
    stats = {r.scan_id: r for r in planned.statistics.collect()}
    assert stats.keys() == {"a", "b"} and all(r.success for r in stats.values())
    ratios = {r.scan_id: r for r in raster.occupancy_ratio(planned.occupied, planned.info, ["scan_id"]).collect()}
    n = {r.scan_id: r["count"] for r in planned.occupied.groupBy("scan_id").count().collect()}
    assert {s: r.n_occupied for s, r in ratios.items()} == n and ratios["a"].percent != ratios["b"].percent
    path = f"file://{tmp_path}/paths"
    scan_files.write_json(scan_files.path_document(planned.paths, planned.statistics, planned.info), path)
    got = {r.scan_id: r for r in scan_files.read_json(spark, path, "scan_id string, path array<array<double>>, grid_info struct<origin:array<double>, size:array<int>>", lines=True).collect()}
    info = {r.scan_id: r for r in planned.info.collect()}
    assert got.keys() == info.keys()
    for s, r in got.items():
        assert r.grid_info.origin == [info[s].x0, info[s].y0] and r.grid_info.size == [info[s].nx, info[s].ny] and len(r.path) == stats[s].path_length_grid


def test_requests_of_many_scans(spark):
    """Statuses, costs and whole paths, several requests for one scan, against plain search."""
    from tests.test_scans import best_first

    rng = random.Random(1)
    free = {s: {(x, y) for x in range(n) for y in range(n) if rng.random() > 0.3} | {(0, 0)} for s, n in (("a", 12), ("b", 20))}
    free["c"] = {(0, 0), (5, 5)}
    asked = [(s, 0, 0, rng.randrange(14), rng.randrange(14)) for s in "ab" for _ in range(4)] + [("c", 0, 0, 5, 5), ("c", 1, 1, 5, 5), ("a", 0, 0, 0, 0)]
    cells = spark.createDataFrame([(s, *c) for s, cs in free.items() for c in cs], "scan_id string, gx int, gy int")
    rows = planning.plan_paths(cells, spark.createDataFrame(asked + asked[:1], "scan_id string, sx int, sy int, tx int, ty int")).collect()
    for s, sx, sy, tx, ty in set(asked):
        own = sorted((r for r in rows if (r.scan_id, r.sx, r.sy, r.tx, r.ty) == (s, sx, sy, tx, ty)), key=lambda r: (r.seq is not None, r.seq))
        way, _, cost = best_first(free[s], (sx, sy), (tx, ty)) if {(sx, sy), (tx, ty)} <= free[s] else ([], 0, None)
        want = "blocked" if cost is None else "ok" if way else "no_path"
        assert own and {r.status for r in own} == {want}
        if want == "ok":
            steps = [(r.gx, r.gy) for r in own]
            assert math.isclose(own[0].path_cost_cells, cost, abs_tol=1e-9) and len(steps) == own[0].path_length_grid and [r.seq for r in own] == list(range(len(steps)))
            assert steps[0] == (sx, sy) and steps[-1] == (tx, ty) and set(steps) <= free[s]
            assert math.isclose(sum(math.dist(p, q) for p, q in zip(steps, steps[1:])), cost, abs_tol=1e-9) and all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(steps, steps[1:]))
        else:
            assert len(own) == 1 and own[0].seq is None


def test_images_of_two_scans(spark):
    rows = [(s, f, u, v, 10 * k + f, 0, 0) for k, s in enumerate("ab") for f in (0, 1) for u in range(3) for v in range(2)]
    pixels = spark.createDataFrame(rows, "scan_id string, frame_id int, u int, v int, r int, g int, b int")
    got = images.infer(pixels, lambda rgb: {"depth": rgb[:, :, 0], "conf": rgb[:, :, 0] * 0}).collect()
    assert sorted((r.scan_id, r.frame_id, r.u, r.v, r.depth) for r in got) == [(s, f, u, v, float(x)) for s, f, u, v, x, *_ in sorted(rows)]
    levels = pixels.withColumnRenamed("r", "level").select("scan_id", "frame_id", "u", "v", "level")
    drawn = {(r.scan_id, r.frame_id): images.decode_png(bytes(r.content)) for r in images.depth_images(levels, (3, 2)).collect()}
    assert {k: int(i[0, 0, 0]) for k, i in drawn.items()} == {("a", 0): 0, ("a", 1): 1, ("b", 0): 10, ("b", 1): 11}
    assert len(images.infer(pixels.drop("scan_id").where("r < 10"), lambda rgb: {"depth": rgb[:, :, 0], "conf": rgb[:, :, 0]}).collect()) == 12


def test_resize_between_pixels(spark):
    pixels = spark.createDataFrame([(u, v, float(u + 10 * v)) for u in range(4) for v in range(3)], "u int, v int, depth double")
    wide = {(r.u, r.v): r.depth for r in images.resize(pixels, (4, 3), (8, 3), ("depth",)).collect()}
    assert [wide[u, 0] for u in range(8)] == [0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3]
    assert {(r.u, r.v): r.depth for r in images.resize(pixels, (4, 3), (2, 3), ("depth",), nearest=True).collect()} == {(u, v): float(2 * u + 10 * v) for u in range(2) for v in range(3)}


def test_ply_of_points_and_faces(spark, tmp_path):
    rng = np.random.default_rng(2)
    places = rng.random((50, 3))
    v = spark.createDataFrame([(7 * i + 3, *map(float, p)) for i, p in enumerate(places)], "point_id long, x double, y double, z double").repartition(5)
    t = spark.createDataFrame([(k, 7 * k + 3, 7 * k + 10, 7 * k + 17) for k in range(40)], "face_id long, v0 long, v1 long, v2 long")
    path = f"file://{tmp_path}/mesh.ply"
    scan_files.write_ply(v, path, triangles=t)
    back = scan_files.read_ply(spark, path).orderBy("place").collect()
    assert [(r.x, r.y, r.z) for r in back] == [tuple(map(float, p)) for p in places]
    assert [r.vertex_indices for r in scan_files.read_ply(spark, path, "face").orderBy("place").collect()] == [[k, k + 1, k + 2] for k in range(40)]
    assert scan_files.read_ply(spark, path, "edge").count() == 0
    # one file, made elsewhere: 150 properties, a comment, lists before scalars
    names = [f"p{k}" for k in range(150)]
    lines = ["ply", "format ascii 1.0", "comment made elsewhere", "element vertex 2", *(f"property float {n}" for n in names), "element face 2", "property list uchar int vertex_indices", "property float area", "end_header"]
    lines += [" ".join(str(k + i) for k in range(150)) for i in range(2)] + ["3 0 1 1 0.5", "4 0 1 1 0 2.5"]
    (tmp_path / "wide.ply").write_text("\n".join(lines) + "\n")
    rows = scan_files.read_ply(spark, f"file://{tmp_path}/wide.ply").orderBy("place").collect()
    assert [r[n] for r in rows for n in ("p0", "p149")] == [0.0, 149.0, 1.0, 150.0] and len(rows[0]) == 151
    faces = scan_files.read_ply(spark, f"file://{tmp_path}/wide.ply", "face").orderBy("place").collect()
    assert [(r.vertex_indices, r.area) for r in faces] == [([0, 1, 1], 0.5), ([0, 1, 1, 0], 2.5)]


def test_outlines_of_many_regions(spark):
    """Areas from the ordered corners, holes, touching corners, many regions and a large one side by side."""
    big = {(x, y) for x in range(100, 180) for y in range(100, 160)} - {(x, y) for x in range(120, 140) for y in range(110, 130)}
    dots = {(2 * x, 2 * y) for x in range(30) for y in range(30)}
    touching = {(0, 200), (1, 201), (2, 200)}
    rows = [("s", *c) for c in big | dots | touching] + [("t", 0, 0), ("t", 0, 0), ("t", 1, 0)]
    df = spark.createDataFrame(rows, "scan_id string, px int, py int")
    rings = {}
    for r in raster.outlines(df, ["scan_id"]).collect():
        rings.setdefault((r.scan_id, r.ring, r.inner), []).append((r.seq, r.x, r.y))
    area = {}
    for k, ring in rings.items():
        way = [p[1:] for p in sorted(ring)]
        assert all((a == c) != (b == d) for (a, b), (c, d) in zip(way, way[1:] + way[:1]))
        area[k] = sum(a * d - c * b for (a, b), (c, d) in zip(way, way[1:] + way[:1])) // 2
    assert len(rings) == 900 + 2 + 1 + 1
    assert sorted(v for (s, _, inner), v in area.items() if s == "s" and not inner)[-2:] == [3, 80 * 60] and [v for (*_, inner), v in area.items() if inner] == [-400]
    assert [v for (s, *_), v in area.items() if s == "t"] == [2]


def test_edge_image_of_a_square(spark):
    square = spark.createDataFrame([(x, y, 255) for x in range(10, 20) for y in range(10, 20)], "px int, py int, level int")
    found = {(r.px, r.py) for r in raster.edge_image(square, 40, 40).collect()}
    for k in range(12, 18):  # a line on either side, across and down
        assert [y in (9, 10, 19, 20) for x, y in found if x == k] == [True] * 2 and [x in (9, 10, 19, 20) for x, y in found if y == k] == [True] * 2
    assert raster.edge_image(square.where("px < 0"), 40, 40).count() == 0
    faint = square.selectExpr("px", "py", "20 as level")
    assert raster.edge_image(faint, 40, 40, 50, 150).count() == 0 and raster.edge_image(faint, 40, 40, 10, 70).count() > 0


def test_floor_plans_of_two_scans(spark):
    """Each scan's plan and outline are those it has alone: a in the slice above its plane, b around its median height."""
    from stratagrid.config import FloorConfig

    low = two_rooms(spark).selectExpr("scan_id", "x", "y", "case scan_id when 'a' then z + 0.2 else z + 0.7 end as z")
    found = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 0.05), ("b", 1, 1.0, 0.0, 0.0, 3.0)], "scan_id string, plane_id int, a double, b double, c double, d double")
    config = FloorConfig(pixels_per_metre=10, least_points=5)
    both = pipelines.floor_plan(low, found, config, by=["scan_id"])
    rows = lambda df: sorted(map(tuple, df.select("px", "py").collect()))
    for scan in "ab":
        alone = pipelines.floor_plan(low.where(f"scan_id = '{scan}'"), found.where(f"scan_id = '{scan}'"), config)
        assert rows(alone.pixels) and rows(both.pixels.where(f"scan_id = '{scan}'")) == rows(alone.pixels)
        assert rows(both.outline.where(f"scan_id = '{scan}'")) == rows(alone.outline)


def test_regions_of_two_scans(spark):
    pixels = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 5, 5), ("b", 1, 0), ("b", 2, 0)], "scan_id string, px int, py int")
    got = {(r.scan_id, r.px, r.py): r.comp for r in raster.components(pixels, ["scan_id"]).collect()}
    assert got == {("a", 0, 0): 0, ("a", 1, 1): 0, ("a", 5, 5): 5 * (1 << 31) + 5, ("b", 1, 0): 1, ("b", 2, 0): 1}


def test_regions_cost_few_rounds(spark, monkeypatch):
    """A bar and a winding line as high as 120 rows, and a repeated pixel: rounds follow the logarithm of the height."""
    bar = [(0, y) for y in range(120)]
    winding = [(x, y) for y in range(0, 120, 2) for x in range(10, 20)] + [(19 if y % 4 == 1 else 10, y) for y in range(1, 119, 2)]
    written, plain = [], raster.durable

    def counted(df, name):
        written.append(name)
        assert len(written) <= 40, "a round for each row"
        return plain(df, name)

    monkeypatch.setattr(raster, "durable", counted)
    pixels = spark.createDataFrame([*bar, *winding, (0, 7), (2, 50)], "px int, py int")
    got = sorted(tuple(r) for r in raster.components(pixels).collect())
    lone = [(2, 50, 50 * (1 << 31) + 2)]
    assert got == sorted([(x, y, 0) for x, y in [*bar, (0, 7)]] + [(x, y, 10) for x, y in winding] + lone)


def test_no_scans_no_plans(spark):
    none = two_rooms(spark).limit(0)
    found = spark.createDataFrame([], "scan_id string, plane_id int, a double, b double, c double, d double")
    plan = pipelines.floor_plan(none, found, by=["scan_id"])
    assert plan.pixels.count() == 0 and plan.meta.count() == 0


def test_cost_fields_cross_tiles(spark, monkeypatch):
    """Costs of two random grids in small tiles are Dijkstra's; a long corridor takes a round a tile, not one a dozen cells."""
    import heapq

    rng = np.random.default_rng(6)
    free = {(s, x, y) for s in ("a", "b") for x in range(-9, 17) for y in range(-3, 23) if rng.random() < 0.6 or (x, y) == (0, 0)}
    starts = [("a", 0, 0), ("b", 0, 0), ("b", -9, 22), ("c", 0, 0)]
    want, todo = {}, [(0.0, s) for s in starts if s in free]
    while todo:
        cost, (s, x, y) = heapq.heappop(todo)
        if (s, x, y) in want:
            continue
        want[s, x, y] = cost
        todo_next = [(cost + c, (s, x + dx, y + dy)) for dx, dy, c in planning.STEPS if (s, x + dx, y + dy) in free]
        for n in todo_next:
            heapq.heappush(todo, n)
    kind = "scan_id string, gx int, gy int"
    got = {(r.scan_id, r.gx, r.gy): r.cost for r in planning.cost_fields(spark.createDataFrame(sorted(free), kind), spark.createDataFrame(starts, kind), side=5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    rounds, write = [], planning.durable
    monkeypatch.setattr(planning, "durable", lambda df, name: rounds.append(name) or write(df, name))
    corridor = spark.range(300).selectExpr("'a' AS scan_id", "int(id) AS gx", "0 AS gy")
    assert planning.cost_fields(corridor, corridor.where("gx = 0")).agg({"cost": "max"}).first()[0] == 299
    assert rounds.count("costs") <= 6


def test_points_of_grids_are_read_twice(spark, monkeypatch):
    """A grid's facts are a table before its cells are found, so the points are not read again for each use of them."""
    made, write = [], raster.durable
    monkeypatch.setattr(raster, "durable", lambda df, name: made.append(name) or write(df, name))
    points = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("a", 0.55, 0.35, 1.0), ("b", 3.0, 1.0, 1.0)], "scan_id string, x double, y double, z double")
    occ, info = raster.occupancy(points, margin=0, by=["scan_id"])
    assert made == ["grid"] and {(r.scan_id, r.gx, r.gy) for r in occ.collect()} == {("a", 0, 0), ("a", 5, 3), ("b", 0, 0)}
    assert {(r.scan_id, r.nx, r.ny) for r in info.collect()} == {("a", 6, 4), ("b", 1, 1)}


def test_grids_are_made_once(spark, monkeypatch):
    """Endpoints that are chosen on grids are planned on the same ones: the points are not made into grids again."""
    from stratagrid.config import GridConfig
    from stratagrid.plans.queries import QUERIES

    made, write = [], raster.durable
    monkeypatch.setattr(raster, "durable", lambda df, name: made.append(name) or write(df, name))
    assert {r.scan_id for r in QUERIES["s16_path_files"](spark, "/root/testdata/sf0.001").collect()} == {"0", "1", "2"}
    assert made == ["grid"]
    points, config = two_rooms(spark), GridConfig(margin=0)
    ends = spark.createDataFrame([("a", 0.35, 0.35, 1.65, 1.65)], "scan_id string, start_x double, start_y double, goal_x double, goal_y double")
    given = pipelines.plan_scan(points.limit(0), ends, config, pipelines.grids(points, config)).statistics.collect()
    assert given == pipelines.plan_scan(points, ends, config).statistics.collect() and given[0].success


#: The pixels of the paths of three scans over grids of all their points, by the SQL of the queries for grids, costs and paths.
OVERLAY = """WITH RECURSIVE {grids}, {ends}, {costs}, {field},
w(scan_id, gx, gy, back) AS (SELECT m.scan_id, tx, ty, 0 FROM m JOIN p ON p.scan_id = m.scan_id AND p.gx = tx AND p.gy = ty UNION ALL SELECT w.scan_id, p.b.x, p.b.y, back + 1 FROM w JOIN p ON p.scan_id = w.scan_id AND p.gx = w.gx AND p.gy = w.gy WHERE p.cost > 0),
k AS (SELECT min(x) - 0.5 AS x_min, max(y) + 0.5 AS y_max FROM s),
d AS (SELECT w.scan_id, back, CAST(trunc((gx * 0.1::DOUBLE + x0 - x_min) * 100) AS INT) AS px, CAST(trunc((y_max - (gy * 0.1::DOUBLE + y0)) * 100) AS INT) AS py FROM w JOIN i USING (scan_id), k),
l AS (SELECT a.scan_id, a.px, a.py, b.px - a.px AS dx, b.py - a.py AS dy, greatest(abs(b.px - a.px), abs(b.py - a.py), 1) AS n FROM d a JOIN d b ON b.scan_id = a.scan_id AND b.back = a.back - 1)
SELECT DISTINCT scan_id, CAST(round(px + t.k / n::DOUBLE * dx) AS INT) AS px, CAST(round(py + t.k / n::DOUBLE * dy) AS INT) AS py FROM l, range(100) t(k) WHERE t.k <= n"""


def test_overlay_is_of_all_points(spark, tmp_path):
    """Every point of a scan is in the grid that its drawn path keeps clear of, whatever its id."""
    import duckdb

    from stratagrid.plans import queries as q

    c = duckdb.connect()
    c.execute("CREATE VIEW events AS SELECT * FROM read_parquet('/root/testdata/sf0.001/events.parquet')")
    costs = q.SCAN_COSTS.replace("FROM f WHERE gx = 0 UNION", "FROM f JOIN m USING (scan_id) WHERE gx = sx AND gy = sy UNION")
    want = c.sql(OVERLAY.format(grids=q.SCAN_GRIDS.replace(" AND point_id % 3 = 0", ""), ends=q.SCAN_ENDS, costs=costs, field=q.SCAN_FIELD)).fetchall()
    got = [(r.scan_id, r.px, r.py) for r in q.QUERIES["r10_path_overlay"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want) and {s for s, _, _ in got} == {"0", "1", "2"}

    # two corners of one scan, of ids that 3 doesn't divide: a line from x = 0 to x = 0.4 on a plan that starts at x = -0.5
    events = [(388, 3, 0.0), (1163, 3, 45.0)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    drawn = q.QUERIES["r10_path_overlay"](spark, f"file://{tmp_path}").collect()
    assert {r.scan_id for r in drawn} == {"0"} and {min(r.px for r in drawn), max(r.px for r in drawn)} == {50, 90}
