"""Incremental versions of the scan operators for streams of pixels, poses and status rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import SCAN
from ..functions import geometry as g
from ..iterate import shared_dir
from ..operators import raster


def voxel_counts(points: DataFrame, size: float = SCAN.voxel, time: str | None = None, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Points per voxel of a fixed lattice (origin 0); with a time column, per window and with late rows
    dropped after the watermark."""
    cells = [F.floor(F.col(a) / g.real(size)).alias(f"v{a}") for a in "xyz"]
    keys = cells
    if time:
        points = points.withWatermark(time, late)
        keys = [F.window(time, window), *cells]
    return points.groupBy(*keys).agg(F.count("*").alias("n_points"))


def latest_status(log: DataFrame) -> DataFrame:
    """The last status of each session so far (output mode complete or update)."""
    return log.groupBy("session_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


_POSE = list(g.POSE)
_FRAME = "frame_id long, " + ", ".join(f"{c} double" for c in _POSE)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Keyframes(StatefulProcessor):
    """State of a scan: the number that comes next, the last kept pose and the timer of those that wait; frames that came before their turn."""

    def __init__(self, kind: str, least_move: float, least_turn: float, patience_ms: int, idle_ms: int) -> None:
        self.kind, self.least_move, self.least_turn = kind, least_move, least_turn
        self.patience_ms, self.idle_ms = patience_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "next_id long, kept boolean, due long, " + ", ".join(f"{c} double" for c in _POSE), self.idle_ms)
        self.waiting = handle.getListState("waiting", _FRAME, self.idle_ms)

    def moved(self, a: tuple, b: tuple) -> bool:
        cosine = (sum(x * y for x, y in zip(a[:9], b[:9], strict=True)) - 1.0) / 2.0
        turn = math.degrees(math.acos(max(-1.0, min(1.0, cosine)))) if not math.isnan(cosine) else math.nan
        return math.dist(a[9:], b[9:]) > self.least_move or turn > self.least_turn

    def take(self, key: tuple, rows: list[tuple], now_ms: int | None) -> Iterator[pd.DataFrame]:
        """Takes the frames whose turn it is (all, where now_ms is none) in order; the others wait on, until a timer.

        Each call of the state is a round trip to the JVM, so whether frames wait is read off the last state's timer."""
        state = self.last.get() or (0, False, 0, *[0.0] * len(_POSE))
        turn, due, pose = state[0], state[2], tuple(state[3:]) if state[1] else None
        kept, wait = [], []
        for frame, *now in sorted([*(tuple(r) for r in self.waiting.get()), *rows] if due else rows):
            if frame < turn:
                continue  # late or repeated
            if frame > turn and now_ms is not None:
                wait.append((frame, *now))
                continue
            turn = frame + 1
            if pose is None or self.moved(pose, tuple(now)):
                pose = tuple(now)
                kept.append((key[0], frame, *now))
        if wait:
            self.waiting.put(wait)
            if not due:
                due = now_ms + self.patience_ms
                self.handle.registerTimer(due)
        elif due:
            self.waiting.clear()
            if now_ms is not None:
                self.handle.deleteTimer(due)
            due = 0
        self.last.update((turn, pose is not None, due, *(pose or [0.0] * len(_POSE))))
        if kept:
            yield pd.DataFrame(kept, columns=[self.kind, "frame_id", *_POSE])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = []
        for part in rows:
            places = zip(part["frame_id"].tolist(), *(part[c].astype(float).tolist() for c in _POSE), strict=True)
            found += [(int(r[0]), *r[1:]) for r in places if not pd.isna(r[0])]
        yield from self.take(key, found, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The frames before those that wait are given up."""
        yield from self.take(key, [], None)

    def close(self) -> None:
        pass


def keyframes(poses: DataFrame, least_move: float = SCAN.keyframe_translation, least_turn: float = SCAN.keyframe_rotation, patience_ms: int = 600_000, idle_ms: int = 86_400_000, scan: str = "scan_id") -> DataFrame:
    """(scan, frame_id, r00 ... tz): keyframes by movement and turn as frames arrive, those that the batch operator keeps.

    A frame's fate depends on all before it, so frames are taken in the order of their numbers, from 0 on: one that comes
    early waits in the scan's state, across micro-batches, until those before it are there. After patience_ms of processing
    time the missing ones are given up; what then still comes of them, and a number that comes twice, is left out. A scan
    without news for idle_ms is forgotten. A frame without a number is left out, one without a whole pose is never moved
    to. The session's state store has to be RocksDB (`settings`)."""
    kind = poses.schema[scan].dataType.simpleString()
    own = poses.select(scan, F.col("frame_id").cast("long").alias("frame_id"), *(F.col(c).cast("double").alias(c) for c in _POSE))
    return own.groupBy(scan).transformWithStateInPandas(
        _Keyframes(scan, least_move, least_turn, patience_ms, idle_ms), f"{scan} {kind}, {_FRAME}", "append", "processingTime")


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB and take no empty micro-batches, of which timers of processing
    time would ask for more and more, so that one that takes what is available would not end. The session's own
    settings come back afterwards."""
    asked = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def voxel_means(points: DataFrame, origin: DataFrame, size: float = SCAN.voxel, values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The mean and number of each voxel's points so far (output mode update); origin is the row (x0, y0, z0) of least coordinates.

    The same voxels as the batch operator's, whose origin is that of its points; a stream has to be told. Sums are kept
    for each voxel that was met, so the state grows with the space that was seen, not with the points."""
    cells = {f"v{a}": F.floor((F.col(a) - (F.col(f"{a}0") - g.real(size / 2))) / g.real(size)) for a in "xyz"}
    return points.crossJoin(F.broadcast(origin)).withColumns(cells).groupBy(*cells).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n_points"))


def occupied_cells(points: DataFrame, info: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each grid cell when the first point falls into it (output mode append), for the grid or grids of info."""
    return raster.cells_of(points, info, by).dropDuplicates([*(by or []), "gx", "gy"])


def _where(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def appended(stream: DataFrame, name: str) -> DataFrame:
    """All rows that a stream in append mode gives for what its source holds now, by way of a table in the shared folder."""
    spark, path = stream.sparkSession, _where(stream.sparkSession, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows")  # also where nothing arrives
    with settings(spark):
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def latest(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The last row of each key of a stream in update mode for what its source holds now.

    Each micro-batch replaces its own folder, so one that is repeated after a loss counts once."""
    spark, path = stream.sparkSession, _where(stream.sparkSession, name)

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    put(spark.createDataFrame([], stream.schema), -1)  # also where nothing arrives
    with settings(spark):
        stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
