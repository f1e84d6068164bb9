"""Default parameters of the scan pipeline. Fixed values, so that results equal those of the pipeline this follows."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScanConfig:
    """Frames, depth pixels and their fusion into one cloud."""

    sampling_fps: int = 2
    least_frames: int = 3
    batch: int = 3
    depth_clip: float = 10.0
    depth_truncation: float = 8.0
    confidence: float = 0.5
    voxel: float = 0.02
    keyframe_translation: float = 0.08
    keyframe_rotation: float = 4.0
    icp_distance: float = 0.05
    outlier_neighbours: int = 20
    outlier_ratio: float = 1.5
    radius_neighbours: int = 12
    normal_radius: float = 0.1
    normal_neighbours: int = 30
    low_movement: float = 0.1


@dataclass(frozen=True)
class PlaneConfig:
    distance: float = 0.05
    iterations: int = 1000
    least_points: int = 500
    most_planes: int = 10


@dataclass(frozen=True)
class FloorConfig:
    height: float = 1.2
    half_height: float = 0.1
    fallback_half_height: float = 0.2
    least_points: int = 100
    padding: float = 0.5
    pixels_per_metre: int = 100
    dot_radius: int = 2
    close_size: int = 5


@dataclass(frozen=True)
class GridConfig:
    resolution: float = 0.1
    height: float = 1.0
    half_height: float = 0.3
    margin: int = 2


@dataclass(frozen=True)
class MeshConfig:
    edge_angle: float = 30.0
    density_quantile: float = 0.01
    smoothing_rounds: int = 3


@dataclass(frozen=True)
class WireframeScan(ScanConfig):
    """The standalone wireframe keeps every frame and uses a finer voxel."""

    voxel: float = 0.015
    outlier_ratio: float = 2.0


SCAN, PLANES, FLOOR, GRID, MESH = ScanConfig(), PlaneConfig(), FloorConfig(), GridConfig(), MeshConfig()
