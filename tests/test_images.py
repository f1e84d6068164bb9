"""PNG files, and several scans planned in one job."""

import numpy as np
import pytest

from stratagrid.plans import pipelines
from stratagrid.sources import images, rooms


def test_png_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    colour, grey = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8), rng.integers(0, 256, (4, 6), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(images.encode_png(colour))
    (tmp_path / "b.png").write_bytes(images.encode_png(grey))
    (tmp_path / "c.txt").write_text("no image")
    got = {(r["path"][-5:], r["u"], r["v"]): (r["r"], r["g"], r["b"]) for r in images.read_images(spark, str(tmp_path)).collect()}
    want = {("a.png", u, v): tuple(colour[v, u].tolist()) for v in range(5) for u in range(7)} | {("b.png", u, v): (int(grey[v, u]),) * 3 for v in range(4) for u in range(6)}
    assert got == want
    with pytest.raises(ValueError):
        images.decode_png(b"none")


def test_scans_side_by_side(spark):
    """Two rooms, one moved: each has its own grid, and the same path in cells."""
    from pyspark.sql import functions as F

    room = rooms.room(spark).select("x", "y", "z")
    both = room.withColumn("scan_id", F.lit("a")).unionByName(room.select((F.col("x") + 8).alias("x"), "y", "z").withColumn("scan_id", F.lit("b")))
    (sx, sy), (tx, ty) = rooms.ROOM_START, rooms.ROOM_GOAL
    ends = spark.createDataFrame([("a", sx, sy, tx, ty), ("b", sx + 8, sy, tx + 8, ty)], "scan_id string, start_x double, start_y double, goal_x double, goal_y double")
    got = {r["scan_id"]: (r["success"], round(r["path_cost_cells"], 3)) for r in pipelines.plan_scan(both, ends).statistics.collect()}
    assert got["a"] == (True, 104.853) and got["b"][0] and abs(got["b"][1] - 104.853) < 2
