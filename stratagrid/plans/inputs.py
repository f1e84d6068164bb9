"""The driver's tables in the roles of scans, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rooms import ROOM, room


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cloud(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a point cloud of bags of points (no ids)."""
    return read(spark, d, "lineitem").select((F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 20000).alias("y"), (F.col("l_discount") * 25).alias("z"), (F.col("l_tax") * 12.5).alias("conf"))


CLOUD = "(SELECT l_quantity / 10 AS x, l_extendedprice / 20000 AS y, l_discount * 25 AS z, l_tax * 12.5::DOUBLE AS conf FROM lineitem)"


def identified(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as a small cloud of points with ids."""
    e = F.col("embedding")
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), *(e[i].cast("double").alias(a) for i, a in enumerate("xyz")))


IDENTIFIED = "(SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as depth pixels of 25 frames; frames whose number is a multiple of five have no confidences."""
    frame = F.col("l_suppkey") % 25
    return read(spark, d, "lineitem").select(frame.cast("int").alias("frame_id"), (F.col("l_partkey") % 64).cast("int").alias("u"), (F.col("l_orderkey") % 48).cast("int").alias("v"), (F.col("l_quantity") / 5).alias("depth"), F.when(frame % 5 != 0, F.col("l_tax") * 12.5).alias("conf"))


PIXELS = """(SELECT CAST(l_suppkey % 25 AS INT) AS frame_id, CAST(l_partkey % 64 AS INT) AS u, CAST(l_orderkey % 48 AS INT) AS v, l_quantity / 5 AS depth,
    CASE WHEN l_suppkey % 25 % 5 <> 0 THEN l_tax * 12.5::DOUBLE END AS conf FROM lineitem)"""

#: Turns about the vertical with exact cosine and sine.
TURNS = ((1.0, 0.0), (0.6, 0.8), (0.8, 0.6), (0.0, 1.0))


def _turn(k: str, which: int) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN CAST({t[which]} AS DOUBLE)" for i, t in enumerate(TURNS)) + " END"


def _pose(k: str) -> str:
    c, s, z, one = _turn(k, 0), _turn(k, 1), "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)"
    return ", ".join(f"{e} AS {n}" for n, e in zip((f"r{i}{j}" for i in range(3) for j in range(3)), (c, f"-({s})", z, s, c, z, z, z, one)))


#: nation as the poses of 25 frames; events as the trajectory of each user. The same text in both engines.
POSES = f"(SELECT n_nationkey AS frame_id, {_pose('n_nationkey % 4')}, n_nationkey / CAST(10 AS DOUBLE) AS tx, n_regionkey / CAST(4 AS DOUBLE) AS ty, CAST(0.5 AS DOUBLE) AS tz, CAST(50 AS DOUBLE) AS fx, CAST(60 AS DOUBLE) AS fy, CAST(32 AS DOUBLE) AS cx, CAST(24 AS DOUBLE) AS cy FROM nation)"
WALKS = f"""(SELECT CAST(user_id AS VARCHAR(20)) AS scan_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_id, {_pose('event_id % 4')},
    value / CAST(1000 AS DOUBLE) AS tx, (event_id % 17) / CAST(100 AS DOUBLE) AS ty, CAST(0 AS DOUBLE) AS tz FROM events)"""


def views(spark: SparkSession, d: str, text: str, *names: str) -> DataFrame:
    """A relation of SQL text over the driver's tables."""
    for n in names:
        text = text.replace(f"FROM {n})", f"FROM parquet.`{d}/{n}.parquet`)")
    return spark.sql(f"SELECT * FROM {text}")


def poses(spark: SparkSession, d: str) -> DataFrame:
    return views(spark, d, POSES, "nation")


def walks(spark: SparkSession, d: str) -> DataFrame:
    return views(spark, d, WALKS, "events")


def _line(i: str, a: tuple) -> str:
    return f"{a[0]}::DOUBLE + ({i}) * ({a[1]}::DOUBLE - {a[0]}::DOUBLE) / {a[2] - 1}::DOUBLE" if a[2] > 1 else f"{a[0]}::DOUBLE"


ROOM_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{n}' AS part, {_line(f'i // {y[2] * z[2]}', x)} AS x, {_line(f'(i // {z[2]}) % {y[2]}', y)} AS y, {_line(f'i % {z[2]}', z)} AS z FROM range({x[2] * y[2] * z[2]}) t(i)"
    for n, x, y, z in ROOM) + ")"
__all__ = ["CLOUD", "IDENTIFIED", "PIXELS", "POSES", "ROOM_SQL", "WALKS", "cloud", "identified", "pixels", "poses", "read", "room", "walks"]


#: events as several scans with ids: five level planes, and a point in eleven at any height.
SCANS = "(SELECT CAST(user_id % 3 AS VARCHAR) AS scan_id, event_id AS point_id, value / 100::DOUBLE AS x, (event_id % 97) / 10.0::DOUBLE AS y, CASE WHEN event_id % 11 = 0 THEN value / 80::DOUBLE ELSE (event_id % 5) / 4.0::DOUBLE END AS z FROM events)"


def scans(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    z = F.when(e % 11 == 0, F.col("value") / F.lit(80.0)).otherwise((e % 5) / F.lit(4.0))
    return read(spark, d, "events").select((F.col("user_id") % 3).cast("string").alias("scan_id"), e.alias("point_id"), (F.col("value") / F.lit(100.0)).alias("x"), ((e % 97) / F.lit(10.0)).alias("y"), z.alias("z"))
